"""Token counts under a unigram vocabulary, without making the tokens.

Count-only Viterbi: an Aho-Corasick automaton lists the vocabulary's pieces that end at each character, and
dynamic programming carries, for the best way to that place, its score and its number of pieces. Ties follow the
tokenizers library: a way replaces another only if its score is greater, and pieces that start earlier are tried
first. A character that no piece covers alone costs the least score less ten and counts its UTF-8 bytes (byte
fallback), or one for a run of such characters where the vocabulary has no byte pieces.

Text is cut before each mark of a space, as the tokenizers library's Metaspace does, so that equal words share
one result; a worker keeps the results of a bounded number of words.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import Shared, map_columns

MARK = "▁"
_WORD = re.compile(f"{MARK}[^{MARK}]*|^[^{MARK}]+")
KEPT_WORDS = 400_000
UNKNOWN_PENALTY = 10.0


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool, kept: int = KEPT_WORDS):
        self.vocabulary, self.byte_fallback, self.kept = vocabulary, byte_fallback, kept
        self.automaton = ahocorasick.Automaton()
        scores: dict[str, float] = {}
        for piece, score in vocabulary:
            if piece:
                scores[piece] = score
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}

    def __reduce__(self):
        return UnigramCounter, (self.vocabulary, self.byte_fallback, self.kept)

    def pieces(self, word: str) -> int:
        n = len(word)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done = 0
        covered = False  # has a piece of one character ended at the place that is being filled
        best: float | None = None
        fallback = self.byte_fallback

        def close(end: int) -> None:
            nonlocal best, covered
            if not covered:
                s = score[end - 1] + self.unknown
                if best is None or s > best:
                    best = s
                    count[end] = count[end - 1] + (len(word[end - 1].encode("utf-8", "surrogatepass")) if fallback else not unknown[end - 1])
                    unknown[end] = True
            score[end] = best
            best, covered = None, False

        for last, (size, piece) in self.automaton.iter(word):
            end = last + 1
            while done < last:
                done += 1
                close(done)
            s = score[end - size] + piece
            if best is None or s > best:
                best, count[end] = s, count[end - size] + 1
            if size == 1:
                covered = True
        while done < n:
            done += 1
            close(done)
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", MARK)
        if not text.startswith(MARK):
            text = MARK + text
        total, cache = 0, self.cache
        for word in _WORD.findall(text):
            n = cache.get(word)
            if n is None:
                if len(cache) >= self.kept:
                    cache.clear()
                n = self.pieces(word)
                if len(word) < 64:
                    cache[word] = n
            total += n
        return total


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all by default) of each row of docs, and n_tokens (long).

    Null and empty texts have none. A column named n_tokens is replaced; rows stay as they are, repeated ones
    too. The vocabulary (tens of thousands of pieces) is broadcast.
    """
    shared = Shared(docs.sparkSession, UnigramCounter(vocabulary, byte_fallback))

    def make(columns: list[pa.Array]) -> list:
        count = shared.value.count
        return [[count(t) for t in columns[0].to_pylist()]]

    return map_columns(docs, [F.col(text_col)], make, "n_tokens long", keep)


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces with their scores, and whether there is byte fallback, of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain], any(model.is_byte(i) for i in ids)
