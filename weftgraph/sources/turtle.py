"""Turtle files read in splits, although statements, strings and prefixes reach over lines and splits.

The first pass goes over the lines of each split for each of the three states that a line can begin in (outside of a long
string, or in one of either kind): the state after the split, whether a statement ends in it, and its directives. A few
values a split are composed on the driver, in the order of the splits, which gives each split the state, the prefixes and
the base that it begins with. The second pass parses the statements that a split holds whole; what lies before its first
end of a statement and after its last goes by a shuffle to the other pieces of the same statement, and is parsed there.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import save
from .terms import BNODE, IRI, LANG_STRING, LITERAL, RDF_TYPE, XSD

_RDF = RDF_TYPE[: -len("type")]
NORMAL, DOUBLE, SINGLE = 0, 1, 2
_ENDS = {DOUBLE: re.compile(r'(?:[^"\\]|\\.|"(?!""))*?"""', re.DOTALL), SINGLE: re.compile(r"(?:[^'\\]|\\.|'(?!''))*?'''", re.DOTALL)}
_PIECE = re.compile(r"\"\"\"|'''|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|<[^<>\s]*>|#.*|\S", re.DOTALL)
_DIRECTIVE = re.compile(r"\s*(?:@prefix\b|@base\b|prefix\s|base\s)", re.IGNORECASE)
_LOCAL = r"(?:[\w:\-%\u00B7]|\\[_~.\-!$&'()*+,;=/?#@%]|\.+(?=[\w:\-%\\\u00B7]))"
_TOKEN = re.compile(
    rf"""(?P<skip>\s+|\#[^\n]*)
    |(?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<iri><(?:[^\x00-\x20<>"{{}}|^`\\]|\\u[0-9A-Fa-f]{{4}}|\\U[0-9A-Fa-f]{{8}})*>)
    |(?P<bnode>_:\w(?:[\w\-\u00B7]|\.+(?=[\w\-\u00B7]))*)
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<double>[+-]?(?:\d+\.?\d*|\.\d+)[eE][+-]?\d+)
    |(?P<decimal>[+-]?\d*\.\d+)
    |(?P<integer>[+-]?\d+)
    |(?P<name>(?:[^\W\d_](?:[\w\-\u00B7]|\.+(?=[\w\-\u00B7]))*)?:{_LOCAL}*)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>\^\^|[.;,\[\]()])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_TRIPLE = "struct<kind: tinyint, lex: string, dt: string, lang: string>"
_ROWS = f"fault string, s {_TRIPLE}, p string, o {_TRIPLE}"


def unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[3] is None:
            return chr(int(m[1] or m[2], 16))
        return _PLAIN[m[3]]

    return _ESCAPE.sub(one, text) if "\\" in text else text


def after_line(line: str, state: int) -> tuple[int, bool]:
    """The state at the end of a line that begins in one, and whether a statement ends with the line."""
    at = 0
    if state != NORMAL:
        closed = _ENDS[state].match(line)
        if not closed:
            return state, False
        at = closed.end()
    elif '"' not in line and "'" not in line and "#" not in line:
        return NORMAL, line.rstrip().endswith(".")
    last = ""
    while True:
        m = _PIECE.search(line, at)
        if not m:
            return NORMAL, last == "."
        at = m.end()
        if m[0] in ('"""', "'''"):
            state = DOUBLE if m[0] == '"""' else SINGLE
            closed = _ENDS[state].match(line, at)
            if not closed:
                return state, False
            at = closed.end()
        if not m[0].startswith("#"):
            last = m[0]


class Statements:
    """A small reader of statements: triples of them under prefixes and a base, which directives change as they come."""

    def __init__(self, prefixes: dict[str, str], base: str, label: str):
        self.prefixes, self.base, self.label, self.made = dict(prefixes), base, label, 0
        self.triples: list[tuple] = []

    def read(self, text: str) -> tuple[list[tuple], str | None]:
        """The triples of the text's statements; and the text from the first faulty one on."""
        out: list[tuple] = []
        self.text, self.at, self.kind, self.token = text, 0, "", ""
        begin = 0
        try:
            self.next()
            while self.kind:
                self.triples = []
                self.statement()
                out += self.triples
                begin = self.at - len(self.token)
        except (ValueError, KeyError, IndexError, RecursionError):
            return out, text[begin:].strip()
        return out, None

    def next(self) -> str:
        """Goes on to the next token; the one it leaves."""
        old = self.token
        while True:
            if self.at >= len(self.text):
                self.kind = self.token = ""
                return old
            m = _TOKEN.match(self.text, self.at)
            if not m:
                raise ValueError(self.text[self.at :])
            self.at = m.end()
            if m.lastgroup != "skip":
                self.kind, self.token = str(m.lastgroup), m[0]
                return old

    def expect(self, token: str) -> None:
        if self.token != token:
            raise ValueError(self.token)
        self.next()

    def fresh(self) -> tuple:
        self.made += 1
        return BNODE, f"{self.label}-{self.made}", None, None

    def resolved(self, token: str) -> str:
        iri = unescaped(token[1:-1])
        return iri if not self.base or re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", iri) else urljoin(self.base, iri)

    def statement(self) -> None:
        low = self.token.lower()
        if self.kind == "at" or self.kind == "word" and low in ("prefix", "base"):
            self.next()
            if low.endswith("prefix"):
                name = self.next()
                if not name.endswith(":"):
                    raise ValueError(name)
                self.prefixes[name[:-1]] = self.iri()
            elif low.endswith("base"):
                self.base = self.iri()
            else:
                raise ValueError(low)
            if low.startswith("@"):
                self.expect(".")
            return
        alone = self.token == "["
        subject = self.node()
        if not alone or self.token != ".":
            self.predicates(subject)
        self.expect(".")

    def iri(self) -> str:
        if self.kind == "iri":
            return self.resolved(self.next())
        if self.kind == "name":
            prefix, _, local = self.next().partition(":")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise ValueError(self.token)

    def predicates(self, subject: tuple) -> None:
        while True:
            if self.token == "a" and self.kind == "word":
                self.next()
                verb = RDF_TYPE
            else:
                verb = self.iri()
            while True:
                o = self.object()
                self.triples.append((subject, verb, o))
                if self.token != ",":
                    break
                self.next()
            if self.token != ";":
                return
            while self.token == ";":
                self.next()
            if self.token in (".", "]", ""):
                return

    def node(self) -> tuple:
        """A subject, or an object that is no literal."""
        if self.kind in ("iri", "name"):
            return IRI, self.iri(), None, None
        if self.kind == "bnode":
            return BNODE, f"{self.label.partition('-')[0]}.{self.next()[2:]}", None, None
        if self.token == "[":
            self.next()
            made = self.fresh()
            if self.token != "]":
                self.predicates(made)
            self.expect("]")
            return made
        self.expect("(")
        items = []
        while self.token != ")":
            items.append(self.object())
        self.next()
        rest: tuple = (IRI, _RDF + "nil", None, None)
        for x in reversed(items):
            cell = self.fresh()
            self.triples += [(cell, _RDF + "first", x), (cell, _RDF + "rest", rest)]
            rest = cell
        return rest

    def object(self) -> tuple:
        if self.kind in ("integer", "decimal", "double"):
            kind = self.kind
            return LITERAL, self.next(), XSD + kind, None
        if self.kind == "word" and self.token in ("true", "false"):
            return LITERAL, self.next(), XSD + "boolean", None
        if self.kind != "string":
            return self.node()
        token = self.next()
        n = 3 if token[:3] in ('"""', "'''") else 1
        lex = unescaped(token[n:-n])
        if self.kind == "at":
            return LITERAL, lex, LANG_STRING, self.next()[1:].lower()
        if self.token == "^^":
            self.next()
            return LITERAL, lex, self.iri(), None
        return LITERAL, lex, XSD + "string", None


@dataclass
class Turtle:
    """quads: (g, s, p, o) without repeats, g null. faults: (fault), the text of what could not be read."""

    quads: DataFrame
    faults: DataFrame


def _named(file: str) -> str:
    return "f" + hashlib.sha256(file.encode()).hexdigest()[:12]


def read_turtle(spark: SparkSession, path: str, base: str = "") -> Turtle:
    """The statements of Turtle files. Each file has prefixes, a base and labels of blank nodes of its own.

    Directives stand on one line each. A faulty statement is a fault from where it begins to the end of its last line,
    and gives no triples; the statements before and after it are read. Line ends in long strings become \\n. An empty
    file has no rows.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    line, ahead = cloudpickle.dumps(after_line), _DIRECTIVE

    def survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        after = cloudpickle.loads(line)
        at: tuple | None = None
        states, ends, found = [0, 1, 2], [False] * 3, []

        def done() -> pd.DataFrame:
            return pd.DataFrame({"file": [at[0]], "block": [at[1]], "states": [list(states)], "ends": [list(ends)], "directives": [json.dumps(found)]})

        for pdf in batches:
            for value, file, block in zip(pdf["value"], pdf["file"], pdf["block"], strict=True):
                if at != (file, block):
                    if at is not None:
                        yield done()
                    at, states, ends, found = (file, block), [0, 1, 2], [False] * 3, []
                if ahead.match(value):
                    found.append((value, [s == 0 for s in states]))
                known: dict[int, tuple[int, bool]] = {}
                for k, s in enumerate(states):
                    if s not in known:
                        known[s] = after(value, s)
                    states[k], end = known[s]
                    ends[k] |= end
        if at is not None:
            yield done()

    surveyed = lines.mapInPandas(survey, "file string, block long, states array<int>, ends array<boolean>, directives string")
    begins: dict[tuple, tuple] = {}  # of each split: state, the split where the statement at its begin began, prefixes, base
    now, file = (NORMAL, -1, {}, base), None
    for r in sorted(surveyed.collect(), key=lambda r: (r["file"], r["block"])):  # a row for each split
        if r["file"] != file:
            file, now = r["file"], (NORMAL, -1, {}, base)
        state, chain, prefixes, root = now
        begins[file, r["block"]] = (state, chain, prefixes, root)
        reader = Statements(prefixes, root, "")
        for text, normal in json.loads(r["directives"]):
            if normal[state]:
                reader.read(text)
        now = (r["states"][state], r["block"] if r["ends"][state] else chain, reader.prefixes, reader.base)
    work = spark.sparkContext.broadcast(cloudpickle.dumps((begins, after_line, Statements, _named)))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begins, after, reader_of, named = cloudpickle.loads(work.value)
        rows: list[tuple] = []
        at: tuple | None = None
        state, held, reader, first, chain, number = 0, [], None, True, -1, 0

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["file", "chain", "block", "text", "env", "fault", "s", "p", "o"])
            rows.clear()
            return out

        def flush(last: bool) -> None:
            """Lines that were held: a piece of a statement of several splits, or statements."""
            text = "\n".join(held)
            held.clear()
            if first or last:
                if text.strip() or not last:
                    rows.append((at[0], chain, at[1], text, json.dumps([reader.prefixes, reader.base]), None, None, None, None))
                return
            reader.label = f"{named(at[0])}-{at[1]}-{number}"
            triples, fault = reader.read(text)
            rows.extend((None, None, None, None, None, None, *t) for t in triples)
            if fault:
                rows.append((None, None, None, None, None, fault, None, None, None))

        for pdf in batches:
            for value, file, block in zip(pdf["value"], pdf["file"], pdf["block"], strict=True):
                if at != (file, block):
                    if at is not None:
                        flush(True)
                    at = (file, block)
                    state, chain, prefixes, root = begins[at]
                    reader, first, number = reader_of(prefixes, root, ""), True, 0
                    if chain == -1 and state == 0 and all(k[0] != file or k[1] >= block for k in begins):
                        first = False  # a file's first split begins with a statement
                held.append(value)
                number += 1
                state, end = after(value, state)
                if end:
                    flush(False)
                    first, chain = False, block
            if len(rows) > 5000:
                yield frame()
        if at is not None:
            flush(True)
        yield frame()

    pieces = save(lines.mapInPandas(parse, f"file string, chain long, block long, text string, env string, {_ROWS}"), "turtle")

    def across(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """A statement of several splits; its first piece has the prefixes."""
        _, _, reader_of, named = cloudpickle.loads(work.value)
        pdf = pdf.sort_values("block")
        prefixes, root = json.loads(pdf["env"].iloc[0])
        reader = reader_of(prefixes, root, f"{named(key[0])}-{key[1]}-x")
        triples, fault = reader.read("\n".join(pdf["text"]))
        return pd.DataFrame([(None, *t) for t in triples] + ([(fault, None, None, None)] if fault else []), columns=["fault", "s", "p", "o"])

    joined = pieces.where("file IS NOT NULL").groupBy("file", "chain").applyInPandas(across, _ROWS)
    rows = save(pieces.where("file IS NULL").select("fault", "s", "p", "o").unionByName(joined), "statements")
    quads = rows.where("fault IS NULL").select(F.lit(None).cast("string").alias("g"), "s", "p", "o").distinct()
    return Turtle(quads, rows.where("fault IS NOT NULL").select("fault"))


def turtle_text(subject: Column, *pairs: tuple[str, Column]) -> Column:
    """A statement on several lines: a subject and (predicate, object) pairs, all of them tokens of Turtle."""
    lines = [F.concat(F.lit(f"    {p} "), o) for p, o in pairs]
    return F.concat(subject, F.lit("\n"), F.concat_ws(" ;\n", *lines), F.lit(" ."))


def write_turtle(statements: DataFrame, path: str, prefixes: dict[str, str]) -> None:
    """Files of the statements, the only column; each file begins with the prefixes."""
    head = "\n".join(f"@prefix {p}: <{iri}> ." for p, iri in prefixes.items())

    def headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [head]})
        yield from batches

    statements.toDF("value").mapInPandas(headed, "value string").write.text(path)
