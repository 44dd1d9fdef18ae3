"""Periodic runs against all lags of each text, one by one."""

import hashlib
import random
import re
import time
import zlib

from weftgraph.llm import queries
from weftgraph.llm.periodic_runs import collapse_runs, find_runs, kept_words


def plain_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_all_lags():
    rng = random.Random(5)
    cases = [list("a" * n) for n in (0, 11, 12, 13, 200)] + [list("ab" * 40), list("aaaaaaab" * 12), (list("abcdefg") * 2 + list("abcdef")) * 3, list("a" * 30 + "b" + "a" * 30), (list("a" * 9) + ["b"]) * 20 + ["c"] + (list("a" * 9) + ["b"]) * 20]
    fib = ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    cases.append(list(fib[-1]))
    for _ in range(250):
        alphabet = "abcdefghijklmnop"[: rng.randint(1, 16)]
        words = []
        while len(words) < rng.randint(5, 160):
            unit = [rng.choice(alphabet) for _ in range(rng.randint(1, 20))]
            words += (unit * rng.randint(1, 5))[: rng.randint(1, 70)]
        cases.append(words)
    for words in cases:
        for least in (12, 7):
            assert find_runs(words, least) == plain_runs(words, least), (least, words)
        runs = plain_runs(words)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert [i for i, k in enumerate(kept_words(len(words), runs).tolist()) if not k] == sorted(dropped)


def test_long_periodic_texts_take_no_pairs_of_all():
    began = time.perf_counter()
    n = 60_000
    assert find_runs(["x"] * n) == [(0, n, 1)]
    unit = [f"w{k}" for k in range(97)]
    assert find_runs(unit * (n // 97)) == [(0, 97 * (n // 97), 97)]
    two = (["x"] * 40 + ["y"]) * (n // 41)
    assert len(find_runs(two)) == n // 41 + 1
    assert time.perf_counter() - began < 60


def test_edges(spark):
    schema = "doc_id string, text string, runs int, __row int, text2 string"
    empty = collapse_runs(spark.createDataFrame([], schema))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "__row", "text2", "n_words", "runs", "collapsed"]
    texts = [None, "", " \t\n ", "é " * 30, "a\x0bb\x0c" * 10, "a\u00a0b " * 12 + "A\u00a0b", "one"]
    rows = [(str(k), t, 1, 2, "z") for k, t in enumerate(texts)] + [(None, "one", 1, 2, "z")] * 2
    got = {r["doc_id"]: r for r in collapse_runs(spark.createDataFrame(rows, schema)).collect()}
    assert [got[str(k)]["n_words"] for k in range(7)] == [0, 0, 0, 30, 20, 13, 1] and got[None]["collapsed"] == "one"
    assert [got[str(k)]["collapsed"] for k in range(7)] == ["", "", "", "é", "a b", "a\u00a0b A\u00a0b", "one"]
    assert [tuple(r) for r in got["5"]["runs"]] == [(0, 12, 1)] and got["0"]["text"] is None


def test_query_equals_all_lags(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words[:3000]) if n <= 3000 else find_runs(words)
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want[r["doc_id"]] = (len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, sf).collect()}
    assert got == want and sum(x[0] > 0 for x in want.values()) > 10
