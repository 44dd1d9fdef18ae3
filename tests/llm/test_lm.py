"""The language model's arithmetic, its base scores against a plain count, and the edges of its input."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from weftgraph.llm import attention_lm as lm
from weftgraph.llm import queries
from weftgraph.llm.staging import Staging

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def ranks():
    return lm.read_ranks(f"{queries.TOKENIZERS}/byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(2)
    n = np.floor(1e5 / np.arange(1, 5001) ** 1.2).astype(np.int64)
    rng.shuffle(n)
    outputs = lm.Outputs(n, rng.random(5000) < 0.5)
    w = lm.first_weights(outputs, 3)
    w["out"] = (w["out"] * 8).astype(np.float32)
    return outputs, w


def test_each_id_is_scored_once_with_its_context():
    lengths = np.array([1, 32, 33, 100, 1])
    scored, inputs = lm.windows(lengths)
    assert sorted(scored[scored >= 0].tolist()) == list(range(167))
    begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
    for row, before in zip(scored.tolist(), inputs.tolist(), strict=True):
        for j, at in enumerate(row):
            if at >= 0:
                seen = [p for p in before[: lm.CONTEXT + j + 1] if p >= 0]
                assert seen == list(range(max(begin[at], row[0] - lm.CONTEXT - 1), at))


def test_probabilities_add_up_and_see_no_later_id(made):
    outputs, w = made
    scorer = lm.Scorer(w, outputs, 4999)
    rng = np.random.default_rng(4)
    text = rng.integers(0, 5000, 40)
    every = np.concatenate([np.append(text, i) for i in range(5000)])
    last = scorer.log_probabilities(every, np.full(5000, 41)).reshape(5000, 41)
    assert abs(np.exp(last[:, -1]).sum() - 1) < 1e-3
    assert np.abs(last[:, :-1] - last[0, :-1]).max() < 1e-4  # what follows changes nothing
    alone = scorer.log_probabilities(text, np.array([40]))
    assert np.abs(alone - last[0, :-1]).max() < 1e-4


def test_gradients_are_those_of_the_scores(made):
    outputs, w = made
    ids = np.random.default_rng(5).integers(0, 5000, 90)
    lengths = np.array([50, 40])
    scored, inputs = lm.windows(lengths)
    rows = np.append(outputs.row[ids], outputs.row[4999])
    targets = np.append(ids, -1)[scored]
    loss = lambda w: -(lm.Scorer(w, outputs, 4999).log_probabilities(ids, lengths) - outputs.share[ids]).mean()
    g, value = lm.gradients(w, rows[inputs], targets, outputs)
    assert abs(value - loss(w)) < 1e-4
    for k in w:
        step = g[k] / max(1e-9, float(np.abs(g[k]).max())) * 0.005
        up, down = ({**w, k: w[k] + s * step} for s in (1, -1))
        foreseen = float((g[k] * step).sum())
        assert abs((loss(up) - loss(down)) / 2 - foreseen) < 0.01 * foreseen + 1e-4, k


def test_training_lowers_the_loss(made):
    outputs, w = made
    ids = np.tile(np.arange(100), 40)
    scored, inputs = lm.windows(np.array([len(ids)]))
    rows = np.append(outputs.row[ids], outputs.row[4999])
    new = lm.train(w, rows[inputs], np.append(ids, -1)[scored], outputs, 60, 1, 0.01)
    mean = lambda w: lm.Scorer(w, outputs, 4999).log_probabilities(ids, np.array([len(ids)])).mean()
    assert mean(new) > mean(w) + 2


def test_steps_are_taken_by_the_rows_that_occur(made, monkeypatch):
    outputs, w = made
    ids = np.random.default_rng(6).integers(0, 300, 4000)
    scored, inputs = lm.windows(np.array([len(ids)]))
    rows = np.append(outputs.row[ids], outputs.row[4999])[inputs]
    sizes, plain = [], lm.gradients
    monkeypatch.setattr(lm, "gradients", lambda w, *rest: (sizes.append(len(w["embed"])), plain(w, *rest))[1])
    new = lm.train(w, rows, np.append(ids, -1)[scored], outputs, 5, 1, 0.01)
    seen = np.unique(rows)
    assert set(sizes) == {len(seen)} and new["embed"].shape == w["embed"].shape
    moved = np.flatnonzero((new["embed"] != w["embed"]).any(axis=1))
    assert set(moved.tolist()) <= set(seen.tolist()) and len(moved) > 0.9 * len(seen)


def test_large_logits_have_finite_gradients(made):
    outputs, w = made
    ids = np.random.default_rng(7).integers(0, 5000, 64)
    scored, inputs = lm.windows(np.array([64]))
    rows = np.append(outputs.row[ids], outputs.row[4999])[inputs]
    for shift in (500, -500):  # the same for all outputs, so that nothing changes
        far = {**w, "bias": w["bias"] + np.float32(shift), "group_bias": w["group_bias"] + np.float32(shift)}
        (g, loss), (f, far_loss) = lm.gradients(w, rows, ids[scored], outputs), lm.gradients(far, rows, ids[scored], outputs)
        assert abs(loss - far_loss) < 1e-3 and all(np.abs(g[k] - f[k]).max() < 1e-3 for k in g)


def test_base_scores_with_rare_words_joined(spark, sf, ranks, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    words = {r["doc_id"]: WORD.findall((r["text"] or "").translate(LOWER)) for r in rows}
    learn = {d for d in words if zlib.crc32(str(d).encode()) % 10}
    c, n_ends = Counter(w for d in learn for w in words[d]), len(learn)
    total = sum(c.values()) + n_ends
    log = lambda k: math.log10((k + 0.1) / (total + 0.1 * (len(c) + 2)))
    monkeypatch.setattr(lm, "LEAST_TOKENS", 20_000)
    for top in (lm.TOP_WORDS, 500, 0):
        monkeypatch.setattr(lm, "TOP_WORDS", top)
        got = queries.op11_lm_scores(spark, sf).collect()
        assert len(got) == len(rows)
        for r in got:
            ws = words[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] not in learn, len(ws) + 1, sum(w in c for w in ws) + 1, total)
            assert abs(r["base_score"] - sum(log(c[w]) for w in ws) - log(n_ends)) < 1e-6 * len(ws) + 1e-9
            assert math.isfinite(r["score"]) and r["score"] < 0


def test_edges(spark, ranks, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_TOKENS", 4_000)
    schema = "doc_id string, text string, uid int, __row int, score string, rare int"
    staging = Staging(spark)
    empty = spark.createDataFrame([], schema)
    model = lm.fit(empty, ranks, staging)
    rows = [("a", None, 1, 2, "s", 3), ("b", "", 1, 2, "s", 3), ("c", " \n\t ", 1, 2, "s", 3), (None, "The the É", 1, 2, "s", 3), (None, "The the É", 1, 2, "s", 3), ("d", "x" * 50_000 + " " + "wort " * 30_000, 1, 2, "s", 3)]
    docs = spark.createDataFrame(rows, schema)
    assert model.score(empty, staging).count() == 0
    blind = {r["doc_id"]: r for r in model.score(docs, staging).collect()}
    assert blind["a"]["n_known"] == 0 and blind["a"]["base_score"] == 0 and blind["a"]["train_tokens"] == 0
    model = lm.fit(docs, ranks, staging)
    out = model.score(docs, staging)
    assert out.columns == ["doc_id", "text", "uid", "__row", "rare", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = out.collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 1, 4, 4, 30_002] and all(r["n_tokens"] == r["n_known"] for r in got)
    same = [r for r in got if r["doc_id"] is None]
    assert abs(same[0]["score"] - same[1]["score"]) < 1e-6 and (same[0]["uid"], same[0]["__row"], same[0]["rare"]) == (1, 2, 3)
    by = {r["doc_id"]: r for r in got}
    assert abs(by["a"]["score"] - by["b"]["score"]) < 1e-6 and abs(by["b"]["score"] - by["c"]["score"]) < 1e-6
    assert by["d"]["score"] > blind["d"]["score"]


def test_every_training_text_is_trained_on(spark, ranks, monkeypatch, tmp_path):
    rows = [(i, " ".join(f"w{i * j % 97} x" for j in range(5 * i))) for i in range(60)] + [(60, None), (61, "y " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    monkeypatch.setattr(lm, "LEAST_TOKENS", 2_000)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 8_000)
    folder, batch = str(tmp_path), lm.BATCH

    def noted(w, inputs, ids, outputs, steps, seed, rate):
        assert steps * batch >= len(ids)
        np.save(f"{folder}/{seed}-{np.random.default_rng().integers(1 << 60)}", ids[ids >= 0])
        return w

    monkeypatch.setattr(lm, "train", noted)
    lm.fit(docs, ranks, Staging(spark))
    subwords = lm.Subwords(ranks)
    want = Counter(x for _, t in rows for ids in [*subwords.ids([w.encode() for w in WORD.findall(t or "")]), [subwords.end]] for x in ids)
    found = [np.load(f) for f in tmp_path.glob("*.npy")]
    assert len(found) > 3 and Counter(np.concatenate(found).tolist()) == want  # each id once, in some shard and round
