"""Substring dedup: passages that repeat within and across documents, long paragraphs exactly or nearly, any run of
words exactly.

Paragraphs are lines of at least min_words words, and the blocks of shorter lines between them that have as many.
Each gets a MinHash signature of its distinct word shingles; bands of it are hashed, and paragraphs that share a band
are candidates. With 14 bands of 4 rows a pair at the threshold of 0.8 is a candidate with a probability of 0.9994, so
that bands lose next to none; the exact Jaccard of the shingle sets decides. Equal sets are one class from the start.
Of each component of linked classes the first paragraph (by doc_id, then place) stays, the others are removed.

Runs of words pay no heed to lines. All windows of min_words words are hashed; a window is sought again only if its
least hash of min_words / 2 words, its key, may be elsewhere. Equal windows have equal keys, so that none is lost; a key
stays the same over many windows, so that the filter takes about one in thirteen of them. Windows that may repeat are
counted exactly by their hash. The first place of each stays; neighbours with the same fate are one passage. Where the
first place meets a removed paragraph, what stays is the first of the passages that would go for it and hold it all, so
that nothing goes for a text that goes itself.
The windows of a key meet in one task, which settles them as arrays, table by table in the order of keys. Windows of a key
with many rows are dealt out by text: they are counted with partial sums, and meet the counts by part.
Band keys and keys of windows are written once for both passes of the filter, so that texts are taken apart four times.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow_text import _MULT, SPACES, Chunk, U, chunks, digest, mix, powers
from .set_links import odd_sketch, set_components
from .sketch import sift, twice_filter
from .staging import Staging, small_batches

BANDS, ROWS = 14, 4
CROWD = 2_000  # rows of windows with one key that one task takes
PIECE = 1 << 18  # bytes of text that are taken apart at once: their arrays fit a processor's cache better than larger ones
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_LINES = np.ones(256, dtype=bool)
_LINES[10] = False
_ROWS = "uid long, word long, para_no int, start_char long, n_chars long, n_words int, id binary, m int, toks array<struct<tok: bigint, pos: int>>, n int, odd array<bigint>, hashes array<bigint>, window struct<{}>"
_WINDOWS = "key: bigint, salt: int, pos: int, h: array<bigint>, start_char: array<bigint>, n_chars: array<int>, para_no: array<int>"
_PIECES = "pos int, next int, para_no int, start_char long, end_char long, places long, lo int, hi int, removed boolean"
_TOKS = pa.list_(pa.struct([("tok", pa.int64()), ("pos", pa.int32())]))
_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_PARAGRAPH = {"word": pa.int64(), "para_no": pa.int32(), "start_char": pa.int64(), "n_chars": pa.int64(), "n_words": pa.int32(), "id": pa.binary(), "m": pa.int32(), "toks": _TOKS, "n": pa.int32(), "odd": _LONGS, "hashes": _LONGS}
_WINDOW = pa.struct([("key", pa.int64()), ("salt", pa.int32()), ("pos", pa.int32()), ("h", _LONGS), ("start_char", _LONGS), ("n_chars", _INTS), ("para_no", _INTS)])


def band_keys(grams: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Band keys of the sets grams[begin:end], a row for each; none is empty."""
    every = np.append(grams, U(0))
    edges = np.stack([begin, end], axis=1).ravel()
    out = np.zeros((len(begin), BANDS), dtype=U)
    for b in range(BANDS):
        for j in range(ROWS):
            out[:, b] += mix(np.minimum.reduceat(every * _FACTORS[b * ROWS + j], edges)[::2]) * _MULT[j]
        out[:, b] = mix(out[:, b] + U(b))
    return out


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys of sets that are not empty, a row for each."""
    ends = np.cumsum([len(x) for x in sets])
    return band_keys(np.concatenate(sets), ends - [len(x) for x in sets], ends)


class Words:
    """The words of a chunk: byte starts and ends, bounds of the texts among them, hashes."""

    def __init__(self, c: Chunk):
        self.c = c
        self.starts, self.ends, self.bounds = c.spans(~SPACES)
        self.hashes = c.hashes(self.starts, self.ends)

    def paragraphs(self, min_words: int) -> tuple | None:
        """Rows, places of their first lines, starts and counts of characters, first words and the ends of words."""
        c = self.c
        p_starts, p_ends, p_bounds = c.spans(_LINES)
        if not len(p_starts):
            return None
        first, last = np.searchsorted(self.starts, p_starts), np.searchsorted(self.starts, p_ends)
        line = last - first >= min_words
        text_of = np.repeat(np.arange(c.n), np.diff(p_bounds))
        new = line.copy()
        new[1:] |= line[:-1] | (text_of[1:] != text_of[:-1])
        new[0] = True
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(new)) - 1
        long = last[end] - first[begin] >= min_words
        begin, end = begin[long], end[long]
        if not len(begin):
            return None
        text_of, first, last = text_of[begin], first[begin], last[end]
        points = c.code_points()
        start = points[p_starts[begin]] - points[c.offsets[text_of]]
        return text_of + c.first, begin - p_bounds[text_of], start, points[p_ends[end]] - points[p_starts[begin]], first, last

    def grams(self, size: int) -> np.ndarray:
        """A hash of each run of size words."""
        n = len(self.hashes)
        if n < size:
            return np.zeros(0, dtype=U)
        p, inverse = powers(n)
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum(self.hashes * p[:n], out=sums[1:])
        return mix((sums[size:] - sums[:-size]) * inverse[: n - size + 1] + U(size))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places among the words where a window of size words of one text starts, and keys of these windows."""
        text_end = np.repeat(self.bounds[1:], np.diff(self.bounds))
        at = np.flatnonzero(np.arange(len(text_end)) + size <= text_end)
        if not len(at):
            return at, np.zeros(0, dtype=U)
        part = (size + 1) // 2
        low, width, step = self.grams(part), size - part + 1, 1
        while 2 * step <= width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < width:
            low = np.minimum(low[: step - width], low[width - step :])
        return at, low[at]

    def window_keys(self, size: int) -> np.ndarray:
        """The keys, once for each run of them in a text, and again after every size windows of a run."""
        at, key = self.windows(size)
        text_of = np.searchsorted(self.bounds, at, "right")
        new = np.ones(len(at), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (text_of[1:] != text_of[:-1])
        k = np.arange(len(at))
        return key[(k - np.maximum.accumulate(np.where(new, k, 0))) % size == 0]


def word_chunks(column: pa.Array) -> Iterator[Words]:
    for c in chunks(column, PIECE):
        yield Words(c)


def repeated_paragraphs(docs: DataFrame, percent: int = 80, min_words: int = 50, k: int = 5, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """A row for each long paragraph that repeats, exactly or nearly, and for each other passage that repeats word for
    word: doc_id, para_no (the place of its first line among the text's lines that are not empty), start_char, n_chars,
    n_words, class_doc_id and class_para_no (where what stays is), class_size, removed.

    Every word of a run of at least min_words words that is found elsewhere, or again in its text without overlap,
    lies in a row, whatever the lines are. A passage within a paragraph's row has no row of its own unless it is removed
    and the paragraph stays. Rows of one text may overlap. class_size of a passage is the most places that a window
    of it has. What a removed row names as its keeper meets no removed paragraph. Null and empty texts and those of fewer words have no rows. A paragraph that repeats within one document,
    or in repeated rows of it, counts as often; ties of doc_id and place keep one. A null doc_id sorts first. Other
    columns are ignored. An empty table gives an empty result. crowd: of a key with more rows of windows a task takes
    about so many; it has no effect on the rows of the result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    staging = Staging(spark)
    if min_words < k:
        raise ValueError("a paragraph needs as many words as a shingle")
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("uid"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_chunks(batch.column(0)):
                found = words.paragraphs(min_words)
                made = [band_keys(words.grams(k), found[-2], found[-1] - k + 1).ravel()] if found else []
                yield pa.RecordBatch.from_pydict({"keys": pa.array([np.concatenate([*made, words.window_keys(min_words)]).tobytes()], pa.binary())})

    def read(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for raw in batch.column(0).to_pylist():
            yield np.frombuffer(raw, dtype=U)

    count = (docs.select(F.sum(F.length("text")).alias("n")).first()[0] or 0) // 6  # about how many words
    written = staging.save(docs.select("text").mapInArrow(keys, "keys binary"), "keys")
    again = sift(written, read, count * BANDS // min_words + 4 * count // min_words + 1)
    staging.drop(written)

    def suspected(words: Words, found: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Band keys, whether another paragraph may have them, which paragraphs have one that may, and their sets."""
        grams, first, last = words.grams(k), *found[-2:]
        every = band_keys(grams, first, last - k + 1)
        hit = again.test(every.ravel()).reshape(every.shape)
        at = np.flatnonzero(hit.any(axis=1))
        return every, hit, at, [np.unique(grams[a : b - k + 1]) for a, b in zip(first[at].tolist(), last[at].tolist(), strict=True)]

    def shared(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for words in word_chunks(batch.column(0)):
            found = words.paragraphs(min_words)
            if found:
                yield from suspected(words, found)[-1]

    held = twice_filter(docs.select("text"), shared, count // 2)  # shingles that two suspects may hold

    crowd = max(1, crowd, 4 * again.typical)  # counts are by cell, which on a large corpus many keys share

    def window_rows(words: Words, doc_id: pa.Array, uid: pa.Array, dealt: bool) -> dict[str, pa.Array]:
        """Windows of the keys that are dealt out, or of the others; salt is the part, by text, that a row falls to."""
        at, key = words.windows(min_words)
        some = np.flatnonzero(again.test(key))
        rows_of = again.counts(key[some])
        mine = (rows_of > crowd) == dealt
        at, key, rows_of = at[some[mine]], key[some[mine]], rows_of[mine]
        if not len(at):
            return {}
        h, c = words.grams(min_words)[at], words.c
        text = np.searchsorted(words.bounds, at, "right") - 1
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1]) | (key[1:] != key[:-1])
        new = np.flatnonzero(new)
        row = pa.array(text[new] + c.first)
        uid = uid.take(row)
        salt = mix(uid.to_numpy().astype(U)) % (rows_of[new] // crowd + 1).astype(U)
        p_starts, _, p_bounds = c.spans(_LINES)
        line = np.searchsorted(p_starts, words.starts[at], "right") - 1
        points = c.code_points()
        start = points[words.starts[at]]
        lists = pa.array(np.append(new, len(at)), pa.int32())
        each = [pa.array(h.view(np.int64)), pa.array(start - points[c.offsets[text]], pa.int64()), pa.array(points[words.ends[at + min_words - 1]] - start, pa.int32()), pa.array(line - p_bounds[text], pa.int32())]
        made = [doc_id.take(row), pa.array(key[new].view(np.int64)), pa.array(salt.astype(np.int32)), uid, pa.array((at - words.bounds[text])[new], pa.int32()), *(pa.ListArray.from_arrays(lists, x) for x in each)]
        return dict(zip(["doc_id", "key", "salt", "uid", "pos", "h", "start_char", "n_chars", "para_no"], made, strict=True))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of paragraphs, and of windows that are dealt out, which have no id."""
        for batch in batches:
            doc_id, _, uid = batch.columns
            for words in word_chunks(batch.column(1)):
                dealt = window_rows(words, doc_id, uid, True)
                if dealt:
                    n = len(dealt["uid"])
                    window = pa.StructArray.from_arrays([dealt[f.name] for f in _WINDOW], fields=list(_WINDOW))
                    yield pa.RecordBatch.from_arrays([dealt["doc_id"], dealt["uid"], *(pa.nulls(n, t) for t in _PARAGRAPH.values()), window], names=["doc_id", "uid", *_PARAGRAPH, "window"])
                found = words.paragraphs(min_words)
                if not found:
                    continue
                row, place, start, n_chars, first, last = found
                every, hit, at, sets = suspected(words, found)
                m = np.array([np.count_nonzero(held.test(x)) for x in sets], dtype=np.int64)
                some = np.flatnonzero(100 * m >= percent * np.array([len(x) for x in sets], dtype=np.int64))
                at, m, sets = at[some], m[some], [sets[i] for i in some.tolist()]
                values = [
                    (first - words.bounds[row - words.c.first])[at], place[at], start[at], n_chars[at], (last - first)[at],
                    [bytes.fromhex(digest(x)) for x in sets], m, [[{"tok": t, "pos": 0} for t in every[i][hit[i]].view(np.int64).tolist()] for i in at.tolist()],
                    [len(x) for x in sets], [odd_sketch(x) for x in sets], [x.view(np.int64) for x in sets],
                ]
                of = pa.array(row[at])
                columns = [pa.array(v, t) for v, t in zip(values, _PARAGRAPH.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_id.take(of), uid.take(of), *columns, pa.nulls(len(at), _WINDOW)], names=["doc_id", "uid", *_PARAGRAPH, "window"])
        again.forget()
        held.forget()

    def other_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_chunks(batch.column(1)):
                made = window_rows(words, batch.column(0), batch.column(2), False)
                if made:
                    yield pa.RecordBatch.from_pydict(made)
        again.forget()

    texts = docs.select("doc_id", "text", "uid")
    every = staging.save(texts.mapInArrow(suspects, f"doc_id {kind}, {_ROWS.format(_WINDOWS)}"), "paragraphs")
    rows = every.where("id IS NOT NULL").drop("window")
    crowded = staging.save(every.where("id IS NULL").select("doc_id", "uid", "window.*"), "crowded")
    members = staging.save(rows.select("id", "n", "m", "toks", "odd").dropDuplicates(["id"]), "members")
    comps = set_components(members, rows.select("id", "hashes"), staging, percent, positional=False)
    staging.drop(members)
    placed = rows.select("doc_id", "uid", "word", "para_no", "start_char", "n_chars", "n_words", "id").join(comps, "id", "left").withColumn("c", F.coalesce("component", "id"))
    first = placed.groupBy("c").agg(F.min(F.struct("doc_id", "para_no")).alias("keep"), F.count("*").alias("class_size"))
    out = placed.join(first.where("class_size > 1"), "c")
    here = F.struct("doc_id", "para_no")
    columns = ["uid", "doc_id", "para_no", "start_char", "n_chars", "n_words", F.col("keep.doc_id").alias("class_doc_id"), F.col("keep.para_no").alias("class_para_no"), "class_size", "removed"]
    out = staging.save(out.withColumn("removed", ~here.eqNullSafe(F.col("keep"))).select("word", *columns), "repeated")
    staging.drop(every)
    windows = texts.mapInArrow(other_windows, f"doc_id {kind}, key bigint, salt int, uid bigint, {_WINDOWS.split(', ', 2)[2]}".replace(":", ""))
    lines = out.select(F.col("uid").alias("u"), F.col("start_char").alias("s"), (F.col("start_char") + F.col("n_chars")).alias("e"), F.col("removed").alias("gone"))
    inside = (F.col("uid") == F.col("u")) & (F.col("start_char") >= F.col("s")) & (F.col("start_char") + F.col("n_chars") <= F.col("e")) & (F.col("gone") | ~F.col("removed"))
    found = staging.save(_passages(windows, crowded, min_words).join(lines, inside, "left_anti"), "passages")
    staging.drop(crowded)
    return out.drop("word").unionByName(_that_stay(found, out.where("removed"), min_words, staging).select(*columns)).drop("uid")


def _that_stay(found: DataFrame, paragraphs: DataFrame, size: int, staging: Staging) -> DataFrame:
    """Passages, where none is removed for a place that meets a removed paragraph: of those that were, the first that
    holds the same words or more and meets none stays, and the others go for it; without such a one they stay. lo and hi:
    the first and last of the windows that a passage was removed for; where these are not in step with its own, as in
    periodic text, it stays."""
    gone = paragraphs.select(F.col("uid").alias("u"), F.col("word").alias("w"), (F.col("word") + F.col("n_words")).alias("x"))
    begin, end = F.col("lo"), F.col("hi") + size
    in_step = (F.col("keep.pos") == F.col("lo")) & (F.col("hi") - F.col("lo") == F.col("n_words") - size)
    open_ = found.where("removed").join(gone, (F.col("keep.uid") == F.col("u")) & (begin < F.col("x")) & (end > F.col("w")), "left_semi")
    open_ = staging.save(open_.withColumns({"of": F.col("keep.uid"), "begin": begin, "end": end, "here": F.struct("doc_id", "pos", "uid", "para_no")}), "open")
    # what may stay meets no removed paragraph either; for each stretch of the place at hand the first by (doc_id, place)
    whole = open_.where(in_step).join(gone, (F.col("uid") == F.col("u")) & (F.col("pos") < F.col("x")) & (F.col("pos") + F.col("n_words") > F.col("w")), "left_anti")
    held = whole.groupBy(F.col("of").alias("o"), F.col("begin").alias("b"), F.col("end").alias("e")).agg(F.min("here").alias("h"))
    within = open_.select("of", "begin", "end").distinct().join(held, (F.col("of") == F.col("o")) & (F.col("b") <= F.col("begin")) & (F.col("e") >= F.col("end")))
    best = within.groupBy("of", "begin", "end").agg(F.min(F.struct("h", "b")).alias("v"))
    moved = open_.join(best, ["of", "begin", "end"], "left")
    stays = F.col("v").isNull() | ~in_step | F.col("here").eqNullSafe(F.col("v.h"))
    there = F.struct(F.col("v.h.doc_id").alias("doc_id"), (F.col("v.h.pos") + F.col("begin") - F.col("v.b")).cast("int").alias("pos"), F.col("v.h.uid").alias("uid"), F.col("v.h.para_no").alias("para_no"))
    moved = moved.withColumns({"removed": ~stays, "keep": F.when(stays, F.col("here")).otherwise(there)})
    rest = found.join(open_.select("uid", "pos"), ["uid", "pos"], "left_anti")
    return rest.unionByName(moved.select(*found.columns))


def _passages(windows: DataFrame, crowded: DataFrame, size: int) -> DataFrame:
    """Of windows that may repeat, in rows of neighbours with one key: those that do, joined where neighbours stay, or
    go for the same text. Equal windows have one key, so that its partition settles them; those of crowded keys are
    counted with partial sums and meet their counts in the parts where they are."""
    counts = {"places": F.count("*"), "first": F.min(F.struct("doc_id", "pos", "uid", "para_no")), "low": F.min("uid"), "high": F.max("uid"), "begin": F.min("pos"), "end": F.max("pos")}
    repeats = (F.col("low") != F.col("high")) | (F.col("end") - F.col("begin") >= size)
    kind = windows.schema["doc_id"].dataType.simpleString()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches):
            found = repeated_windows(rows, size)
            if found:
                yield found

    # a key's rows are in the order of doc_id, whatever its type
    seen = windows.drop("salt").repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(settle, f"uid long, doc_id {kind}, first struct<doc_id: {kind}, pos: int, uid: bigint, para_no: int>, {_PIECES}")
    totals = _each(crowded).groupBy("key", "h").agg(*(c.alias(n) for n, c in counts.items()), F.collect_set("salt").alias("salts")).where(repeats)
    met = _each(crowded).join(totals.select("key", "h", F.explode("salts").alias("salt"), "places", "first"), ["key", "salt", "h"])
    return _joined(seen.unionByName(_joined(_fates(met, size), ["key", "uid"]).drop("key")), ["uid"]).select(
        "uid", "doc_id", "pos", "lo", "hi", "para_no", "start_char", (F.col("end_char") - F.col("start_char")).alias("n_chars"), (F.col("next") - 1 - F.col("pos") + size).cast("int").alias("n_words"), F.col("first").alias("keep"), F.col("places").alias("class_size"), "removed"
    )


def whole_keys(batches: Iterator[pa.RecordBatch], least: int = 4096) -> Iterator[pa.Table]:
    """Rows in the order of key as tables of about so many rows, or of one key that has more, each with all rows of its keys."""
    held: list[pa.RecordBatch] = []
    n, enough = 0, least
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < enough:
            continue
        rows = pa.Table.from_batches(held)
        key = rows["key"].to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield rows.slice(0, cut)
            held, n = rows.slice(cut).to_batches(), n - cut
        enough = max(least, 2 * n)
    if n:
        yield pa.Table.from_batches(held)


def repeated_windows(rows: pa.Table, size: int) -> pa.RecordBatch | None:
    """Of windows in rows of neighbours, in the order of key and doc_id, with all rows of their keys: those that repeat,
    as _fates and _joined by key and uid give them."""
    rows = rows.combine_chunks()
    column = {c: rows[c].chunk(0) for c in rows.column_names}
    offsets = column["h"].offsets.to_numpy()
    n = np.diff(offsets)
    h = column["h"].flatten().to_numpy()
    order = np.argsort(h, kind="stable")
    twins = h[order[1:]] == h[order[:-1]]
    twin = np.zeros(len(h), dtype=bool)
    twin[order[1:]] = twins
    twin[order[:-1]] |= twins
    some = np.flatnonzero(twin)
    if not len(some):
        return None
    new_key = np.append(True, np.diff(column["key"].to_numpy()) != 0)
    ids = column["doc_id"].to_pylist()
    differ = np.array([True, *(a != b and (a == a or b == b) for a, b in zip(ids[:-1], ids[1:], strict=True))])
    row = np.repeat(np.arange(len(n)), n)[some]
    key, doc, uid = np.cumsum(new_key)[row], np.cumsum(new_key | differ)[row], column["uid"].to_numpy()[row]
    pos = column["pos"].to_numpy()[row] + (some - (offsets[:-1] - offsets[0])[row])
    h, start, n_chars, para_no = (column[c].flatten().to_numpy()[some] for c in ("h", "start_char", "n_chars", "para_no"))

    order = np.lexsort((uid, pos, doc, h))  # the first place of each window first
    new = np.append(True, (h[order[1:]] != h[order[:-1]]) | (key[order[1:]] != key[order[:-1]]))
    begin = np.flatnonzero(new)
    places = np.diff(np.append(begin, len(order)))
    least, most = ([f.reduceat(x[order], begin) for x in (uid, pos)] for f in (np.minimum, np.maximum))
    group = np.repeat(np.arange(len(begin)), places)
    kept = ((least[0] != most[0]) | (most[1] - least[1] >= size))[group]
    if not kept.any():
        return None
    at, first, places = order[kept], order[begin][group[kept]], places[group[kept]]
    back = np.lexsort((pos[at], uid[at], key[at]))
    at, first, places = at[back], first[back], places[back]
    gone = np.where(uid[first] == uid[at], pos[at] - pos[first] >= size, (doc[first] != doc[at]) | (pos[first] != pos[at]))
    new = np.append(True, (key[at[1:]] != key[at[:-1]]) | (uid[at[1:]] != uid[at[:-1]]) | (pos[at[1:]] != pos[at[:-1]] + 1) | (gone[1:] != gone[:-1]) | (uid[first[1:]] != uid[first[:-1]]))
    begin = np.flatnonzero(new)
    low = lambda x: np.minimum.reduceat(x, begin)
    high = lambda x: np.maximum.reduceat(x, begin)
    here, there = at[begin], first[begin]
    of, to = pa.array(row[here]), pa.array(row[there])
    keep = pa.StructArray.from_arrays([column["doc_id"].take(to), pa.array(pos[there], pa.int32()), pa.array(uid[there]), pa.array(para_no[there], pa.int32())], names=["doc_id", "pos", "uid", "para_no"])
    return pa.RecordBatch.from_pydict({
        "uid": pa.array(uid[here]), "doc_id": column["doc_id"].take(of), "first": keep, "pos": pa.array(pos[here], pa.int32()), "next": pa.array(high(pos[at]) + 1, pa.int32()), "para_no": pa.array(low(para_no[at]), pa.int32()),
        "start_char": pa.array(low(start[at])), "end_char": pa.array(high((start + n_chars)[at])), "places": pa.array(high(places)), "lo": pa.array(low(pos[first]), pa.int32()), "hi": pa.array(high(pos[first]), pa.int32()), "removed": pa.array(gone[begin]),
    })


def _each(windows: DataFrame) -> DataFrame:
    """A row for each window of rows of neighbours."""
    w = F.posexplode(F.arrays_zip("h", "start_char", "n_chars", "para_no")).alias("j", "w")
    return windows.select("key", "salt", "uid", "doc_id", "pos", w).select("key", "salt", "uid", "doc_id", (F.col("pos") + F.col("j")).alias("pos"), "w.*")


def _fates(seen: DataFrame, size: int) -> DataFrame:
    """Windows that repeat, as pieces of one window each that stay or go."""
    gone = F.when(F.col("first.uid") == F.col("uid"), F.col("pos") - F.col("first.pos") >= size).otherwise(~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.pos") == F.col("pos"))))
    return seen.select("key", "uid", "doc_id", "pos", (F.col("pos") + 1).alias("next"), "para_no", "start_char", (F.col("start_char") + F.col("n_chars")).alias("end_char"), "places", "first", F.col("first.pos").alias("lo"), F.col("first.pos").alias("hi"), gone.alias("removed"))


def _joined(pieces: DataFrame, by: list[str]) -> DataFrame:
    along = W.partitionBy(*by).orderBy("pos")
    before = lambda c: F.lag(c).over(along)
    on = (before("next") == F.col("pos")) & (before("removed") == F.col("removed")) & (before("first.uid") == F.col("first.uid"))
    runs = pieces.withColumn("new", (~F.coalesce(on, F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    begin = F.min(F.struct("pos", "first"))
    return runs.groupBy(*by, "run").agg(
        F.first("doc_id").alias("doc_id"), F.min("pos").alias("pos"), F.max("next").alias("next"), F.min("para_no").alias("para_no"), F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"),
        F.max("places").alias("places"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), begin["first"].alias("first"), F.first("removed").alias("removed"),
    ).drop("run")
