"""Chat formatting: whole conversations as one text, with the tokens and characters that a loss is taken on.

A turn is <|im_start|>role<|im_sep|>text<|im_end|>. Inside roles and texts each "<|" gets a backslash after the
"<", and "<\\|" one more, so that no text can hold a control string and each can be read back. The control strings
are tokens of their own, so no token reaches across the edge of a text. A conversation is encoded once, with
offsets, and the sorted spans of assistant texts are intersected with the sorted spans of tokens by binary search.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import Shared, map_columns

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(SEP)}(.*?){re.escape(END)}", re.DOTALL)
_FIELDS = "formatted string, n_turns long, n_tokens long, loss_tokens array<struct<first: int, last: int>>, loss_spans array<struct<start: int, end: int>>"


def escape(text: str) -> str:
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans in it of the texts by the role that is learned."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == learn and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


class Encoder:
    """A tokenizers JSON with the control strings as special tokens and offsets that cover every character."""

    def __init__(self, json_text: str):
        self.json_text = json_text
        self.tokenizer = None

    def __getstate__(self) -> dict:
        return {"json_text": self.json_text, "tokenizer": None}

    def offsets(self, text: str) -> np.ndarray:
        if self.tokenizer is None:
            from tokenizers import AddedToken, Tokenizer, processors

            self.tokenizer = Tokenizer.from_str(self.json_text)
            self.tokenizer.post_processor = processors.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)
            self.tokenizer.add_special_tokens([AddedToken(t, normalized=False, special=True) for t in (START, SEP, END)])
        found = self.tokenizer.encode(text, add_special_tokens=False).offsets
        return np.array(found, dtype=np.int64).reshape(-1, 2)


def mask(tokens: np.ndarray, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Ranges of tokens that meet the spans, and the characters that both cover."""
    starts, ends = tokens[:, 0], tokens[:, 1]
    ranges, covered = [], []
    for a, b in spans:
        first, last = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        if first >= last:
            continue
        ranges.append((first, last))
        begin = None
        for s, e in zip(np.maximum(starts[first:last], a).tolist(), np.minimum(ends[first:last], b).tolist(), strict=True):
            if begin is None:
                begin, end = s, e
            elif s > end:
                covered.append((begin, end))
                begin, end = s, e
            else:
                end = max(end, e)
        covered.append((begin, end))
    return ranges, covered


def format_conversations(turns: DataFrame, tokenizer_json: str, learn: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: conv_id, formatted, n_turns, n_tokens, loss_tokens (ranges of token places) and
    loss_spans (ranges of characters of formatted).

    Turns are in order of turn, then role and text; a null turn comes first. Null roles and texts are empty.
    Repeated rows are turns of their own. A null conv_id is a conversation. Other columns are ignored.
    tokenizer_json: the content of a byte-level tokenizers file; it is broadcast. The rows of a conversation meet
    in one task, as its text is one value of the result.
    """
    picked = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("t"), F.coalesce(F.col(role_col), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    whole = picked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("t", "r", "x"))).alias("turns"))
    shared = Shared(turns.sparkSession, Encoder(tokenizer_json))

    def make(columns: list[pa.Array]) -> list[list]:
        out: list[list] = [[], [], [], [], []]
        for roles, texts in zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True):
            formatted, spans = render(list(zip(roles, texts, strict=True)), learn)
            tokens = shared.value.offsets(formatted)
            ranges, covered = mask(tokens, spans)
            for c, v in zip(out, (formatted, len(roles), len(tokens), [{"first": a, "last": b} for a, b in ranges], [{"start": a, "end": b} for a, b in covered]), strict=True):
                c.append(v)
        return out

    return map_columns(whole, [F.transform("turns", lambda t: t["r"]), F.transform("turns", lambda t: t["x"])], make, _FIELDS, ["conv_id"])
