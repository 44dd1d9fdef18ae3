"""The generative operator: a model's answers bind variables of solutions.

A prompt with placeholders {?x} is asked once for each different text that the solutions give it, a prompt
without any once at all. Answers are written to the shared folder before they are used, so that a plan that is
evaluated again asks nothing again; records of earlier runs can be replayed.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import save
from ..sources.graph import Graph
from ..sources.terms import LITERAL, literal
from .patterns import Solutions
from .similarity import DEFAULT_THETA, jaccard, labels, nearest, texts_of

_PLACE = re.compile(r"\{\?(\w+)\}")
_ROWS = "array<array<string>>"
_ANSWERS = f"prompt string, key string, ok boolean, raw string, rows {_ROWS}, tokens int, tokens_out int, seconds double, together int"


@dataclass
class Mock:
    """Answers by the first of rules (part of a prompt, answer) whose part occurs, else default."""

    rules: Sequence[tuple[str, str]] = ()
    default: str = "[]"
    name: str = "mock"
    temperature: float = 0.0
    max_tokens: int = 1000

    def complete(self, prompts: list[str], outputs: Sequence[str]) -> list[str | None]:
        return [each_alone(p, outputs, lambda x: next((a for part, a in self.rules if part in x), self.default)) for p in prompts]


@dataclass
class Echo:
    """Answers with the text between two marks of the prompt, changed by a rule: for tests whose answers SQL can
    state."""

    start: str = "["
    end: str = "]"
    how: str = "same"  # same, upper, lower, reversed, none
    name: str = "echo"
    temperature: float = 0.0
    max_tokens: int = 1000
    several: str | None = None  # what separates several answers in the text

    def complete(self, prompts: list[str], outputs: Sequence[str]) -> list[str | None]:
        return [each_alone(p, outputs, lambda x: self.answer(x, outputs)) for p in prompts]

    def answer(self, prompt: str, outputs: Sequence[str]) -> str:
        text = self.text(prompt)
        parts = [text] if self.several is None else [x for x in text.split(self.several) if x]
        return json.dumps([x if len(outputs) == 1 else dict.fromkeys(outputs, x) for x in parts])

    def text(self, prompt: str) -> str:
        text = prompt.partition(self.start)[2].partition(self.end)[0]
        return {"same": text, "upper": text.upper(), "lower": text.lower(), "reversed": text[::-1], "none": ""}[self.how]


@dataclass
class ChatCompletions:
    """A service with the widespread /chat/completions interface; a request that fails is sent again if the service
    was busy or out of reach, and is no answer in the end."""

    base: str
    model: str
    key: str | None = None
    timeout: float = 30.0
    temperature: float = 0.0
    max_tokens: int = 1000
    name: str = "http"
    retries: int = 2
    wait: float = 1.0  # seconds before the first retry; twice as many before each next

    def complete(self, prompts: list[str], outputs: Sequence[str]) -> list[str | None]:
        import urllib.request

        out: list[str | None] = []
        for p in prompts:
            body = {"model": self.model, "messages": [{"role": "user", "content": p}], "temperature": self.temperature, "max_tokens": self.max_tokens}
            request = urllib.request.Request(f"{self.base}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.key}"} if self.key else {})})
            answer = None
            for k in range(self.retries + 1):
                try:
                    with urllib.request.urlopen(request, timeout=self.timeout) as r:
                        answer = json.load(r)["choices"][0]["message"]["content"]
                    break
                except Exception as e:  # noqa: BLE001 - any failure is no answer
                    if 400 <= getattr(e, "code", 0) < 500 and e.code != 429:
                        break
                    time.sleep(self.wait * 2**k if k < self.retries else 0)
            out.append(answer)
        return out


PROVIDERS = {"mock": Mock, "echo": Echo, "http": ChatCompletions}


def provider_named(name: str, **settings):
    """A provider by its name in PROVIDERS, to which callers may add their own."""
    if name not in PROVIDERS:
        raise ValueError(f"no provider {name}; there are {sorted(PROVIDERS)}")
    return PROVIDERS[name](**settings)


@dataclass
class Options:
    theta: float = DEFAULT_THETA
    records: DataFrame | None = None  # (key, raw) of earlier answers
    replay_only: bool = False  # a prompt without a record is an error
    fail_on_error: bool = False
    batch: int = 32  # prompts that a provider gets at once
    together: int = 1  # different prompts in one request
    plausible: bool = False  # leave out rows with a value that looks like code or garbage
    candidates: Sequence[str] = field(default_factory=tuple)  # texts that answers should be among
    most_candidates: int = 500
    tag: str | None = None  # of the jobs that ask the model; spark.interruptTag(tag) cancels them

    def __post_init__(self):
        if not 0 <= self.theta <= 1:
            raise ValueError("theta must be from 0 to 1")


def format_hint(outputs: Sequence[str]) -> str:
    """How the model is asked to answer."""
    if len(outputs) == 1:
        return '\nAnswer with a JSON array of strings, for example ["a", "b"]. Answer [] if there is nothing.'
    shape = ", ".join(f'"{o}": "..."' for o in outputs)
    return f"\nAnswer with a JSON array of objects, for example [{{{shape}}}]. Answer [] if there is nothing."


def _text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _balanced(text: str, at: int) -> int:
    """Where the bracket at a place of the text is closed; the text's end if it is not."""
    depth, quoted, k = 0, False, at
    while k < len(text):
        c = text[k]
        if quoted and c == "\\":
            k += 1
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "[{":
            depth += 1
        elif not quoted and c in "]}":
            depth -= 1
            if not depth:
                return k + 1
        k += 1
    return len(text)


def _values(text: str) -> list:
    """JSON arrays and objects that occur in a text, in order; small faults are mended."""
    fenced = re.findall(r"```(?:\w+)?\s*\n?(.*?)```", text, re.DOTALL)
    text = "\n".join(fenced) if fenced else text
    decoder, found, at = json.JSONDecoder(), [], 0
    while (m := re.search(r"[\[{]", text[at:])) is not None:
        at += m.start()
        piece = text[at : _balanced(text, at)]
        for attempt in (piece, re.sub(r"([}\]\"])\s*(?=[{\[])", r"\1,", re.sub(r"//[^\n\"]*(?=\n|$)", "", piece))):
            try:
                value, end = decoder.raw_decode(attempt)
            except ValueError:
                continue
            found.append(value)
            at += end if attempt == piece else len(piece)
            break
        else:
            if text[at] == "[" and not found:  # cut off: what was whole before the end
                for stop in range(len(text), at, -1):
                    if text[stop - 1] in ']}"0123456789el':
                        try:
                            found.append(json.loads(text[at:stop].rstrip().rstrip(",") + "]"))
                            return found
                        except ValueError:
                            continue
            at += 1
    return found


def parse_answer(raw: str | None, outputs: Sequence[str]) -> list[list[str | None]]:
    """Rows of values for the outputs; empty values are None, and rows without any are left out."""
    if raw is None or not raw.strip():
        return []
    values = _values(raw)
    arrays = [v for v in values if isinstance(v, list)]
    items = [x for a in arrays for x in a] if arrays else [v for v in values if isinstance(v, dict)]
    if not values:
        items = [raw.strip()]
    rows: list[list[str | None]] = []
    for item in items:
        if isinstance(item, dict):
            row = [_text(item.get(o)) for o in outputs]
            if len(outputs) == 1 and outputs[0] not in item:
                other = next((item[k] for k in ("entity", "value", "result", "name") if k in item), next(iter(item.values())) if len(item) == 1 else None)
                row = [_text(other)]
        elif isinstance(item, list) and len(outputs) > 1:
            row = [_text(x) for x in item[: len(outputs)]] + [""] * (len(outputs) - len(item))
        else:
            row = [_text(item)] + [""] * (len(outputs) - 1)
        row = [x if x.strip() and x != "[]" else None for x in row]
        if any(row) and row not in rows:
            rows.append(row)
    return rows


def in_one(prompts: Sequence[str], outputs: Sequence[str], choices: str = "") -> str:
    """One request for several prompts. Each stands under a mark, made from all of them so that none can hold it, and its
    number."""
    mark = hashlib.sha256("\0".join(prompts).encode()).hexdigest()[:16]
    fields = ", ".join(f'"{o}"' for o in outputs)
    rule = f'Answer each prompt below on its own; each begins after a line "{mark} number". Answer with one JSON array for all. Each row of an answer is an object in it with the number of its prompt as "prompt_id" and {fields}; a prompt without an answer has one object with "prompt_id" alone.'
    return rule + choices + "".join(f"\n{mark} {k}\n{p}" for k, p in enumerate(prompts))


def each_alone(request: str, outputs: Sequence[str], answer: Callable[[str], str | None]) -> str | None:
    """How a test provider answers a request: each of its prompts by answer, joined as in_one asks for."""
    found = re.match(r'Answer each prompt below on its own; each begins after a line "([0-9a-f]{16}) number"', request)
    if not found:
        return answer(request)
    objects: list[dict] = []
    for k, prompt in enumerate(re.split(rf"\n{found[1]} \d+\n", request)[1:]):
        rows = parse_answer(answer(prompt), outputs)
        objects += [{"prompt_id": k, **{o: v for o, v in zip(outputs, r, strict=True) if v is not None}} for r in rows] or [{"prompt_id": k}]
    return json.dumps(objects, ensure_ascii=False)


def taken_apart(raw: str | None, n: int) -> list[str | None]:
    """The answers to n prompts of one request, each with all its objects; None for a prompt that has none, and for all
    if the answer cannot be read."""
    found: dict[str, list[dict]] = {}
    for v in _values(raw or ""):
        for x in v if isinstance(v, list) else [v]:
            if isinstance(x, dict) and "prompt_id" in x:
                row = {k: y for k, y in x.items() if k != "prompt_id"}
                found.setdefault(str(x["prompt_id"]), []).extend([row] if row else [])
    return [json.dumps(found[str(k)], ensure_ascii=False) if str(k) in found else None for k in range(n)]


LONGEST_LOOP = 12  # times that a short piece may follow itself in a plausible value


def _is_code(text: str) -> bool:
    """Whether a text is a program: it can be parsed as one, and calls, defines, imports, assigns or returns something."""
    try:
        nodes = list(ast.walk(ast.parse(text)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return any(isinstance(x, (ast.Call, ast.FunctionDef, ast.ClassDef, ast.Lambda, ast.Import, ast.ImportFrom, ast.Assign, ast.Return)) for x in nodes)


def plausible(value: str | None) -> bool:
    """Whether a value reads like an answer: letters and digits are half of it at least, it begins like a text and does not end like a statement, and it is
    no JSON container, no program (also line by line), and no endless loop of one piece."""
    text = (value or "").strip()
    if not text:
        return True
    if 2 * sum(map(str.isalnum, text)) < sum(not c.isspace() for c in text) or text[0] in ",;:.!?)]}>|=/" or text[-1] in ";{}":
        return False
    if text[0] in "[{":
        try:
            return not isinstance(json.loads(text), (dict, list))
        except ValueError:
            pass
    if re.search(rf"(.{{1,20}}?)\1{{{LONGEST_LOOP},}}", text, re.DOTALL):
        return False
    return not any(_is_code(x.strip()) for x in [text, *text.splitlines()] if x.strip())


def record_key(provider, prompt: str, outputs: Sequence[str]) -> str:
    sha = hashlib.sha256(prompt.encode()).hexdigest()
    return f"{provider.name}:{getattr(provider, 'model', '')}:{sha}:{provider.temperature}:{provider.max_tokens}:{','.join(outputs)}"


def placeholders(prompt: str) -> list[str]:
    return list(dict.fromkeys(_PLACE.findall(prompt)))


def resolved(prompt: str) -> Column:
    """The prompt with each placeholder's term: a literal's form, an IRI, a blank node's label. Null if one is
    unbound. Values are put in at once, so that a value with braces is left as it is."""
    parts: list[Column] = []
    for k, x in enumerate(_PLACE.split(prompt)):
        parts.append(F.col(f"{x}.lex") if k % 2 else F.lit(x))
    return F.concat(*parts)


def ask_model(prompts: DataFrame, provider, outputs: Sequence[str], options: Options) -> DataFrame:
    """(prompt, key, ok, raw, rows, tokens) of distinct prompts, each asked once; written before use."""
    choices = "\nChoose from: " + "; ".join(sorted(set(options.candidates))[: options.most_candidates]) if options.candidates else ""
    hint = choices + format_hint(outputs)
    names, size, together, strict = list(outputs), options.batch, options.together, options.plausible
    work = cloudpickle.dumps((provider, parse_answer, record_key, in_one, taken_apart, plausible))

    def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider, parse, key, joined, apart, plausible = cloudpickle.loads(work)
        for pdf in batches:
            for i in range(0, len(pdf), size):
                asked = pdf["prompt"].iloc[i : i + size].tolist()
                known = pdf["known"].iloc[i : i + size].tolist() if "known" in pdf else [None] * len(asked)
                new = [p for p, k in zip(asked, known, strict=True) if k is None]
                began = time.perf_counter()
                groups = [new[k : k + together] for k in range(0, len(new), together)]
                replies = provider.complete([g[0] + hint if len(g) == 1 else joined(g, names, choices) for g in groups], names) if new else []
                got = iter([a for g, r in zip(groups, replies, strict=True) for a in ([r] if len(g) == 1 else apart(r, len(g)))])
                each = (time.perf_counter() - began) / max(1, len(new))
                raws = [k if k is not None else next(got) for k in known]
                rows = [[x for x in parse(r, names) if not strict or all(map(plausible, x))] for r in raws]
                yield pd.DataFrame({"prompt": asked, "key": [key(provider, p, names) for p in asked], "ok": [r is not None for r in raws], "raw": raws, "rows": rows, "tokens": [-(-len(p) // 4) for p in asked], "tokens_out": [-(-len(r or "") // 4) for r in raws], "seconds": [each if k is None else 0.0 for k in known], "together": [min(together, len(new)) if k is None else 0 for k in known]})

    todo = prompts.select("prompt").where("prompt IS NOT NULL").distinct()
    if options.records is not None:
        prefix, suffix = record_key(provider, "", names).split(hashlib.sha256(b"").hexdigest())
        todo = todo.withColumn("key", F.concat(F.lit(prefix), F.sha2("prompt", 256), F.lit(suffix))).join(options.records.select("key", F.col("raw").alias("known")), "key", "left").drop("key")
        if options.replay_only and todo.where("known IS NULL").limit(1).count():
            raise LookupError("a prompt has no record")
    spark = prompts.sparkSession
    if options.tag:
        spark.addTag(options.tag)
    try:
        out = save(todo.mapInPandas(answers, _ANSWERS), "answers")
    finally:
        if options.tag:
            spark.removeTag(options.tag)
    if options.fail_on_error and out.where("NOT ok").limit(1).count():
        raise RuntimeError("the model failed to answer")
    return out


@dataclass
class Generated:
    solutions: Solutions
    answers: DataFrame

    def calls(self) -> int:
        """Different prompts that were asked; Options.together of them share a request."""
        return self.answers.count()

    def metrics(self) -> DataFrame:
        """(n_prompts, n_failed, n_rows, tokens, tokens_out, seconds) of all answers; answers has them for each prompt."""
        return self.answers.agg(F.count("*").alias("n_prompts"), F.count_if(~F.col("ok")).alias("n_failed"), F.sum(F.size("rows")).alias("n_rows"), F.sum("tokens").alias("tokens"), F.sum("tokens_out").alias("tokens_out"), F.sum("seconds").alias("seconds"))

    def records(self) -> DataFrame:
        """What Options.records takes: the answers that were given."""
        return self.answers.where("ok").select("key", "raw")


def generate(sol: Solutions, prompt: str, outputs: Sequence[str], provider, options: Options | None = None, graph: Graph | None = None) -> Generated:
    """Solutions extended by the rows of the answers to their prompts.

    Solutions with an unbound placeholder, without an answer or with an empty one are dropped. An empty value of
    some outputs is unbound. An output that a solution binds already keeps its term, if a text of it is as similar
    as options.theta to the answer, else the row goes.
    """
    options = options or Options()
    names = [o.lstrip("?") for o in outputs]
    missing = [p for p in placeholders(prompt) if p not in sol.variables]
    if missing:
        raise ValueError(f"the prompt names variables that no pattern binds: {missing}")
    if placeholders(prompt):
        asked = sol.df.withColumn("__prompt", resolved(prompt)).where("__prompt IS NOT NULL")
    else:
        asked = sol.df.withColumn("__prompt", F.lit(prompt))
    known = asked.select(F.col("__prompt").alias("prompt")) if placeholders(prompt) else sol.df.sparkSession.createDataFrame([(prompt,)], "prompt string")
    answers = ask_model(known, provider, names, options)
    rows = answers.where("ok").select(F.col("prompt").alias("__prompt"), F.explode("rows").alias("__row"))
    df = asked.join(rows, "__prompt").drop("__prompt")
    maybe = set(sol.maybe)
    for k, v in enumerate(names):
        value = F.get("__row", F.lit(k))
        if v in sol.variables:
            if graph is None:
                text = F.col(f"{v}.lex")
                df = df.where(value.isNotNull() & (jaccard(text, value) >= options.theta))
            else:
                table = labels(graph)
                named = texts_of(df.select(F.col(v).alias("term")).distinct(), table).groupBy("term").agg(F.collect_set("label").alias("__texts"))
                df = df.join(named.withColumnRenamed("term", v), v).where(value.isNotNull() & _any_similar(value, options.theta)).drop("__texts")
        else:
            df = df.withColumn(v, literal(value))
            if len(names) > 1:
                maybe.add(v)
    df = df.drop("__row").select(*sol.variables, *[v for v in names if v not in sol.variables])
    made = frozenset(v for v in names if v not in sol.variables)
    return Generated(Solutions(df, frozenset(maybe), sol.generated | made, {**{v: options.theta for v in made}, **sol.thetas}), answers)


def _any_similar(value: Column, theta: float) -> Column:
    return F.exists("__texts", lambda t: jaccard(t, value) >= theta)


def candidate_labels(graph: Graph, predicate: str, mode: str = "object", most: int = 500) -> list[str]:
    """Labels of a relation's objects, subjects or both, in order, for Options.candidates; a fixed number at most."""
    rows = graph.of(predicate)
    parts = [rows.select(F.col(c).alias("term")) for c in {"object": ["o"], "subject": ["s"], "all": ["s", "o"]}[mode]]
    terms = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    found = texts_of(terms.distinct(), labels(graph)).select("label").distinct().orderBy("label").limit(most)
    return [r[0] for r in found.collect()]


def ground(sol: Solutions, variable: str, values: DataFrame, entities: DataFrame, theta: float = 0.8) -> Solutions:
    """Maps a generated variable's literals to the nearest entity by their embeddings, if at least theta.

    values: (value, q, v) texts with an id and a vector; entities: (term, id, v).
    """
    name = variable.lstrip("?")
    found = nearest(values.select("q", "v"), entities.select("id", "v"), 1, theta)
    mapped = found.join(values.select("q", "value"), "q").join(entities.select("id", "term"), "id").select("value", "term")
    df = sol.df.withColumn("value", F.col(f"{name}.lex")).join(mapped, "value", "left")
    term = F.when((F.col(f"{name}.kind") == LITERAL) & F.col("term").isNotNull(), F.col("term")).otherwise(F.col(name))
    return sol.with_(df.withColumn(name, term).drop("value", "term").select(*sol.variables))
