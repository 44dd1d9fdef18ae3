"""Decontamination, line dedup, n-gram join, paragraph dedup and token counts against plain versions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, line_dedup, ngram_join, paragraph_dedup, token_count

SCHEMA = "doc_id long, text string, id string, key string, tok int, n_words string, hits string"
WS = "\t\n\x0b\x0c\r "
LOWER = {c: c + 32 for c in range(65, 91)}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, "z", "w") for i, t in rows], SCHEMA).repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def random_rows(seed, n=60):
    r = random.Random(seed)
    vocabulary = ["der", "é", "Aa", "aa", "x1", "日本", "the", "of", "zz", "q"]
    base = [[r.choice(vocabulary) + str(r.randrange(40)) for _ in range(r.randrange(20, 90))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = "new" + str(r.randrange(1000))
        rows.append((i, r.choice([" ", "  ", "\n", " \t"]).join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one"), (n + 4, "One"), (n + 5, "a b c"), (n + 6, rows[0][1]), (n + 7, rows[0][1].upper()), (n + 8, "long " * 30000)]
    rows += [rows[3], rows[3], (None, "one")]
    return rows


def sets_of(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_components(spark, seed):
    rows = random_rows(seed)
    got = sorted(map(tuple, ngram_join.ngram_components(frame(spark, rows)).collect()), key=repr)
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    want = [(i, len(sets[a]), least.get(find(a)) if sets[a] else i) for a, (i, _) in enumerate(rows)]
    assert got == sorted(want, key=repr)


def test_ngram_empty_table(spark):
    assert ngram_join.ngram_components(frame(spark, [])).count() == 0


def test_lines(spark):
    long = "A line of more than twenty characters"
    rows = [(1, f"{long}\nshort"), (2, f"  {long.upper()}\t\nother"), (3, f"{long}\n\n{long}\r"), (4, None), (5, ""), (6, "short\nshort\n"), (7, "short"), (8, "é" * 19 + "\n" + "é" * 20), (9, "é" * 20), (10, "É" * 20), (11, "é" * 20 + " "), (12, "é" * 20)]
    rows += [(2, f"again {long}"), (None, long), (1, f"{long}\nshort"), (None, "é" * 20)]
    got = line_dedup.dedup_lines(frame(spark, rows)).select("doc_id", "text", "n_lines", "n_dropped", "id").collect()
    key = lambda x: x.strip(WS).translate(LOWER)
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    rank = lambda i: (i is not None, i or 0)
    gone = {(k, i) for k, ids in held.items() if len(k) >= 20 and len(ids) >= 3 for i in ids if i != max(ids, key=rank)}
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if (key(x), i) not in gone]
        want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept), "x"))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block_words", [2_000_000, 15])
def test_contamination(spark, block_words):
    r = random.Random(5)
    vocabulary = ["a", "b", "c", "d"]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(n))) for k, n in enumerate([12, 10, 9, 3, 1, 0, 25])]
    items = [(k, t if k != 4 else "Rare!") for k, t in items] + [(7, None), (8, items[0][1].upper()), (None, "b b")]
    rows = [(i, r.choice([" ", ", ", "\n"]).join(r.choice(vocabulary) for _ in range(r.randrange(0, 60)))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "x " + items[1][1] + " y"), (43, "the RARE é-thing"), rows[2], (None, items[6][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(frame(spark, rows), bench, keep=["doc_id", "n_words", "hits"], block_words=block_words)
    got = sorted(map(tuple, decontaminate.report(found).collect()), key=repr)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for k, t in items:
        w = split(t)
        n = min(10, len(w))
        if n and k is not None:
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(k)
    want = []
    for i, t in rows:
        w, hit, ids = split(t), set(), set()
        for a in range(len(w)):
            for n in {len(x) for x in windows}:
                owners = windows.get(tuple(w[a : a + n])) if a + n <= len(w) else None
                if owners:
                    hit |= set(range(a, a + n))
                    ids |= owners
        want.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want, key=repr)


def test_contamination_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.find_contamination(frame(spark, [(1, "a b")]), bench)
    assert [r["hits"] for r in found.collect()] == [[]] and "id" in found.columns
    assert decontaminate.find_contamination(frame(spark, []), bench).count() == 0


def test_wu_manber_skips():
    p = decontaminate.build([(1, "a b c d e f g h i j k l")])[0]
    looked = []

    class Words(list):
        def __getitem__(self, i):
            looked.append(i)
            return super().__getitem__(i)

    p.search(Words([b"z"] * 1000), set(), set())
    assert len(looked) < 300


def test_paragraphs(spark):
    r = random.Random(9)
    para = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    passage, other = para(60), para(70)
    edited = passage.split()
    edited[30] = "changed"
    rows = [(1, f"{para(55)}\n{passage}"), (2, f"\n{passage.upper()}\n{para(80)}"), (3, f"x\n{' '.join(edited)}\ny"), (4, f"{other}\n\n{other}"), (5, "short line\n" * 40), (6, None), (7, ""), (8, para(51)), (9, " ".join(passage.split()[:49])), (10, para(40000))]
    rows += [rows[7]]
    got = paragraph_dedup.repeated_paragraphs(frame(spark, rows)).collect()
    by = {(x["doc_id"], x["para_no"]): x for x in got}
    assert len(got) == 7 and set(by) == {(1, 1), (2, 0), (3, 1), (4, 0), (4, 1), (8, 0)}
    assert {(x["class_doc_id"], x["class_para_no"]) for x in got if x["doc_id"] in (1, 2, 3)} == {(1, 1)}
    assert [by[k]["removed"] for k in ((1, 1), (2, 0), (3, 1), (4, 0), (4, 1))] == [False, True, True, False, True]
    text = dict(rows)[3]
    x = by[3, 1]
    assert text[x["start_char"] : x["start_char"] + x["n_chars"]] == " ".join(edited) and x["n_words"] == 60
    assert paragraph_dedup.repeated_paragraphs(frame(spark, [])).count() == 0


def test_band_recall():
    import numpy as np

    from weftgraph.llm.paragraph_dedup import bands

    g = np.random.default_rng(4)
    met = 0
    for _ in range(400):
        shared = g.integers(0, 2**63, 160, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        a, b = (np.unique(np.concatenate([shared, g.integers(0, 2**63, 20, dtype=np.uint64)])) for _ in range(2))
        x = bands([a, b])
        met += bool((x[0] == x[1]).any())
    assert met >= 398


@pytest.mark.parametrize("fallback", [True, False])
def test_token_counts_as_the_library(spark, fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces, has_bytes = token_count.read_vocabulary("/opt/tokenizers/piece_bpe_32k.model")
    assert has_bytes
    if not fallback:
        pieces = [(p, s) for p, s in pieces if not p.isascii() or p.isalpha()]
    least = min(s for _, s in pieces)
    extra = [("<unk>", least), *((f"<0x{i:02X}>", least) for i in range(256))] if fallback else [("<unk>", least)]
    library = Tokenizer(models.Unigram(extra + pieces, unk_id=0, byte_fallback=fallback))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    r = random.Random(2)
    texts = ["", "a", "  a  b ", "▁▁x", "日本語 テスト\nnew\tline", "😀😀 zzź", "<0x41>", "x" * 3000, "\U0001f680\U0001f680\U0001f680 é́"]
    texts += ["".join(r.choice("abcdefghi éß日😀\n.") for _ in range(r.randrange(200))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (3, "▁▁x")]
    got = token_count.count_tokens(frame(spark, rows), pieces, fallback).select("doc_id", "n_tokens", "id").collect()
    want = [(i, len(library.encode(t or "", add_special_tokens=False).ids), "x") for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_ties_prefer_earlier_starts():
    c = token_count.UnigramCounter([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)], False)
    assert c.count("ab") == 2  # ▁a + b comes before ▁ + ab and ▁ + a + b, at the same score


def test_columns_replaced(spark):
    out = token_count.count_tokens(frame(spark, [(1, "a b")]).withColumn("n_tokens", F.lit("old")), [("▁", -1.0), ("a", -1.0)], True)
    assert dict(out.dtypes)["n_tokens"] == "bigint" and out.count() == 1


def test_passages_across_lines_and_within_them(spark):
    """Every word of a run of 50 words that is found elsewhere lies in a row; what stays still holds every run."""
    r = random.Random(3)
    para = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    passage, inner = para(69), para(51)
    split = lambda w, n: " ".join(w[:n]) + "\n" + " ".join(w[n:])
    edited = [*passage[:35], "changed", *passage[36:]]
    rows = [(1, split(passage, 23)), (2, split(passage, 23)), (3, split(passage, 40)), (4, " ".join(para(60) + inner + para(200))), (5, " ".join(para(20) + inner) + "\n" + " ".join(para(80)))]
    rows += [(6, " ".join(para(7) + inner[:49] + para(7))), (7, split(edited, 23)), (8, " ".join(para(30)) + "\n\n" + " ".join(passage[:55])), (9, "tick " * 99), (10, "tock " * 160), (None, " ".join(inner[:50]))]
    got = paragraph_dedup.repeated_paragraphs(frame(spark, rows)).collect()
    dealt = paragraph_dedup.repeated_paragraphs(frame(spark, rows), crowd=1).collect()
    assert sorted(map(repr, dealt)) == sorted(map(repr, got))  # however windows are dealt out
    text, held = dict(rows), {i: words(t) for i, t in rows}
    places = {}
    for i, w in held.items():
        for p in range(len(w) - 49):
            places.setdefault(tuple(w[p : p + 50]), []).append((i, p))
    want = {i: set() for i in held}
    for at in places.values():
        if len({i for i, _ in at}) > 1 or at[-1][1] - at[0][1] >= 50:
            for i, p in at:
                want[i] |= set(range(p, p + 50))
    covered, left = {i: set() for i in held}, {i: set(range(len(w))) for i, w in held.items()}
    for x in got:
        t = text[x["doc_id"]]
        a = len(words(t[: x["start_char"]]))
        inside = set(range(a, a + x["n_words"]))
        assert len(words(t[x["start_char"] : x["start_char"] + x["n_chars"]])) == x["n_words"] >= 50
        covered[x["doc_id"]] |= inside
        if x["removed"]:
            left[x["doc_id"]] -= inside
    assert all(want[i] <= covered[i] for i in held)
    assert {i for i, c in covered.items() if c} == {1, 2, 3, 4, 5, 7, 8, 10, None}
    assert covered[7] == set(range(69)) and covered[4] == set(range(60, 111)) and covered[5] == set(range(20, 71))
    kept = " ".join(" ".join(held[i][p] for p in sorted(left[i])) for i in held)
    assert " ".join(passage) in kept and " ".join(inner[:50]) in kept and len(left[10]) == 50


def test_texts_are_taken_apart_four_times(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    rows = [(i, " ".join(f"w{r.randrange(50)}" for _ in range(120))) for i in range(30)] + [(30, None)]
    rows += [(31, rows[0][1]), (31, rows[1][1] + " x")]
    folder, plain = str(tmp_path), paragraph_dedup.word_chunks

    def noted(column):
        with open(f"{folder}/{random.SystemRandom().getrandbits(60)}", "w") as f:
            f.write(str(len(column)))
        yield from plain(column)

    monkeypatch.setattr(paragraph_dedup, "word_chunks", noted)
    got = paragraph_dedup.repeated_paragraphs(frame(spark, rows)).collect()
    assert {x["doc_id"] for x in got} == {0, 1, 31} and sum(x["removed"] for x in got) == 2
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == 4 * len(rows)


def test_keys_stay_whole_and_windows_repeat_by_any_id():
    import pyarrow as pa

    keys = [1, 1, 1, 1, 1, 2, 3, 3]
    rows = pa.table({"key": keys, "uid": [4, 5, 6, 7, 8, 9, 10, 11], "doc_id": [None, None, "b", "b", "c", "c", "a", "b"], "pos": [0, 3, 60, 0, 1, 5, 7, 7], "h": [[5, 6], [6], [5], [5, 9], [], [5], [7], [7, 8]]})
    for c in ("start_char", "n_chars", "para_no"):
        rows = rows.append_column(c, rows["h"])
    tables = list(paragraph_dedup.whole_keys(rows.to_batches(max_chunksize=2), 3))
    assert [t["key"].to_pylist() for t in tables] == [[1] * 5 + [2], [3, 3]]
    found = [x for t in tables for x in paragraph_dedup.repeated_windows(t, 50).to_pylist()]
    want = [(4, 0, 2, False, 4, 3), (5, 3, 4, True, 4, 2), (6, 60, 61, True, 4, 3), (7, 0, 1, True, 4, 3), (10, 7, 8, False, 10, 2), (11, 7, 8, True, 10, 2)]
    assert [(x["uid"], x["pos"], x["next"], x["removed"], x["first"]["uid"], x["places"]) for x in found] == want


def test_ids_of_any_type_and_clashing_names(spark):
    long = "A line of more than twenty characters"
    rows = [(f"d{i}", f"{long}\nown words of number {i}", 7, "x") for i in range(4)] + [("d9", None, 7, None), (None, "", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, __text int, __keys string").withColumn("__row", F.lit("r"))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert [got[f"d{i}"]["n_dropped"] for i in range(4)] == [1, 1, 1, 0] and got["d0"]["__text"] == 7 and got["d0"]["__row"] == "r" and got["d9"]["text"] == ""
    bench = spark.createDataFrame([("q1", "own words of"), ("q2", "none")], "item_id string, text string")
    found = {r["doc_id"]: r for r in decontaminate.find_contamination(docs, bench).collect()}
    assert found["d0"]["items"] == ["q1"] and found["d0"]["__text"] == 7 and found["d9"]["items"] == []
    same = spark.createDataFrame([("b", "one two three four five six"), ("a", "One two three four five SIX"), ("c", None)], "doc_id string, text string")
    assert sorted(map(tuple, ngram_join.ngram_components(same).collect())) == [("a", 2, "a"), ("b", 2, "a"), ("c", 0, "c")]


def test_filters_take_what_they_need_and_leave_the_workers(spark):
    import numpy as np
    import pyarrow as pa

    from weftgraph.llm.sketch import sift

    # 4,000 arrays of 49 hashes of their own and one that the next array holds, too
    arrays = spark.range(0, 4000, 1, 4).repartition(4)

    def hashes(batch):
        for i in batch.column(0).to_pylist():
            yield np.append(np.arange(i * 100, i * 100 + 49, dtype=np.uint64), np.uint64(10**9 + i // 2))

    known = sift(arrays, hashes, 200_000, per_cell=8)
    assert known.first.bits == 20 and known.second.bits < 20

    def run(batches):
        missed = passed = 0
        for batch in batches:
            for u in hashes(batch):
                found = known.test(u)
                missed, passed = missed + (not found[-1]), passed + int(found[:-1].sum())
        known.forget()
        kept = sum("_value" in vars(f) for f in (known.first.sent, known.second.sent, known.sent))
        yield pa.RecordBatch.from_pydict({"missed": [missed], "passed": [passed], "kept": [kept]})

    for _ in range(2):  # workers read them again
        got = arrays.mapInArrow(run, "missed long, passed long, kept long").groupBy().sum().first()
        assert got[0] == 0 and got[1] < 0.03 * 49 * 4000 and got[2] == 0
    known.release()


def test_odd_sketches_bound_the_difference():
    import numpy as np

    from weftgraph.llm.set_links import odd_sketch

    g = np.random.default_rng(8)
    for n in (1, 7, 60, 1000):
        u = np.unique(g.integers(0, 2**63, n, dtype=np.uint64))
        v = np.unique(np.concatenate([u[: max(1, n * 3 // 4)], g.integers(0, 2**63, n // 4, dtype=np.uint64)]))
        x, y = odd_sketch(u), odd_sketch(v)
        if len(x) != len(y):
            continue
        apart = sum(((int(p) ^ int(q)) & (2**64 - 1)).bit_count() for p, q in zip(x, y, strict=True))
        assert apart <= len(set(u.tolist()) ^ set(v.tolist()))


def remaining(rows, got):
    """The words that stay of each text, by doc_id."""
    text = dict(rows)
    left = {i: set(range(len(words(t)))) for i, t in text.items()}
    for x in got:
        if x["removed"]:
            a = len(words(text[x["doc_id"]][: x["start_char"]]))
            left[x["doc_id"]] -= set(range(a, a + x["n_words"]))
    return {i: [words(t)[p] for p in sorted(left[i])] for i, t in text.items()}


def test_what_a_removed_row_is_kept_for_stays(spark):
    """Near copies that hold passages of other documents, in all orders: no word of a passage goes everywhere."""
    r = random.Random(8)
    block = lambda n, k: [f"{n}_{j}" for j in range(k)]
    head, tail, x, y = block("head", 220), block("tail", 300), block("x", 52), block("y", 52)
    rows = [(0, " ".join(head + x + tail)), (1, " ".join(head + y + tail)), (2, " ".join(block("a", 60) + y + block("b", 60)))]
    got = paragraph_dedup.repeated_paragraphs(frame(spark, rows)).collect()
    left = remaining(rows, got)
    assert " ".join(y) in " ".join(left[2]) and len(left[1]) == 0 and len(left[0]) == 572
    blocks = [block(f"p{n}", r.randrange(52, 70)) for n in range(12)]
    big = [block(f"big{n}", 420) for n in range(3)]
    rows = []
    for i in range(40):
        parts = [list(b) for b in r.sample(blocks, r.randrange(1, 4))]
        if r.random() < 0.6:
            near = list(r.choice(big))
            at = r.randrange(len(near) - 60)
            near[at : at + r.choice((0, 3))] = r.choice((["new"], parts[0][:1]))
            if r.random() < 0.5:
                near[200:200] = parts.pop()
            parts.append(near)
        r.shuffle(parts)
        text = ""
        for p in parts:
            text += " ".join(p) + r.choice((" ", "\n", "\nshort line\n"))
        rows.append((i, text))
    got = paragraph_dedup.repeated_paragraphs(frame(spark, rows)).collect()
    stays = {w for ws in remaining(rows, got).values() for w in ws}
    held = {w for _, t in rows for w in words(t) if w[0] == "p"}  # a near copy that is kept may lack words of the others
    assert held <= stays, sorted(held - stays)
    gone = {(x["doc_id"], x["para_no"]) for x in got if x["removed"] and x["class_para_no"] is not None}
    assert gone
