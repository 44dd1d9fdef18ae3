"""Scores of a causal self-attention language model over subword ids, and of a unigram base over words.

Counts of words are gathered from all training texts; the subword ids of each different word, times its count, give the
frequencies of ids. The frequent ids are outputs of their own, the others share outputs by kind (whether they begin a
word) and frequency, within which the counts of all training texts decide. The model, one layer of attention with
relative places and a small feed-forward layer, is trained in numpy on every id of every training text: these are dealt to shards
and rounds, each task trains from the same weights on its own shard, the weights are averaged by Spark, and so on for all
rounds.

A text's ids are scored in windows of SCORED ids with CONTEXT ids before them, so that each id is scored once, and with at
least so much context; windows go through attention in batches under one causal mask. As embeddings carry no places,
keys, values and queries are looked up by id.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrow_text import SPACES, Chunk, U, chunks
from .columns import Shared, packed, unpacked
from .staging import Staging, small_batches

SCORED, CONTEXT = 32, 16
DIM, HEADS, HIDDEN = 24, 1, 48  # a second head costs a quarter more and gains 2 % of the logarithm
NEARER = 0.5  # by how much less a place counts at first than the next one, as a logarithm
SINGLE, BANDS = 2048, 4  # ids that are outputs of their own; shared outputs of each kind
SMALL, N_SMALL, LARGE = 16, 8, 256  # outputs of a group: of the first groups of a kind, how many these are, and of the others
NEARBY = 24  # windows whose attention weights fit a processor's cache
KNOWN_IDS = 8192  # ids with an embedding of their own, the most frequent ones; rarer ones have that of their output
TOP_WORDS = 1 << 19  # words whose counts are broadcast, the most frequent; counts of others are joined
LEAST_TOKENS = 3_000_000  # ids that the weights are trained on at least; shorter corpora are gone through again
SHARD_TOKENS = 2_000_000  # ids of a shard in all rounds
ROUNDS = 3
BATCH = 64  # windows of a training step
LEARNING = 0.01
ADDED = 0.1
PIECE = 4096  # ids of a row of training ids
_FLUSH = 400_000  # different words that a counting task holds
_SEEN = 200_000  # rare words whose ids a scoring task remembers
#: Fixed value: the word pattern that the byte-level vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Subwords:
    """Ids of words, lower-cased by ASCII and with the blank before them; end is the id after the last."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.pattern, self.end = ranks, pattern, max(ranks.values()) + 1
        self.encoding = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "encoding": None}

    def ids(self, words: list[bytes]) -> list[list[int]]:
        if self.encoding is None:
            import tiktoken

            self.encoding = tiktoken.Encoding("subwords", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        encode = self.encoding.encode_ordinary
        return [encode(" " + w.lower().decode("utf-8", "replace")) for w in words]

    def begins(self) -> np.ndarray:
        """Of each id, whether it begins with a blank; the end does."""
        out = np.zeros(self.end + 1, dtype=bool)
        out[[i for b, i in self.ranks.items() if b.startswith(b" ")]] = True
        out[self.end] = True
        return out


def _lists(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array and the places where each begins, the last one's end included."""
    offsets = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return np.fromiter((i for r in rows for i in r), dtype=np.int32, count=int(offsets[-1])), offsets


def taken(ids: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists with the numbers which, one after the other, and where each begins."""
    sizes = (offsets[1:] - offsets[:-1])[which]
    at = np.zeros(len(which) + 1, dtype=np.int64)
    np.cumsum(sizes, out=at[1:])
    return ids[np.repeat(offsets[which] - at[:-1], sizes) + np.arange(at[-1])], at


# ---- counts


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, word, c): how often each word of the only column occurs, A-Z as a-z; words are told apart by 64-bit hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"h": pa.array(np.fromiter(held, dtype=U, count=len(held)).view(np.int64)), "word": pa.array([w for w, _ in held.values()], pa.binary()), "c": pa.array([c for _, c in held.values()], pa.int64())})
            held.clear()
            return made

        for batch in batches:
            for c in chunks(batch.column(0)):
                starts, ends, _ = c.spans(~SPACES)
                if not len(starts):
                    continue
                h, first, n = np.unique(c.hashes(starts, ends), return_index=True, return_counts=True)
                raw = c.data.tobytes()
                for x, s, e, k in zip(h.tolist(), starts[first].tolist(), ends[first].tolist(), n.tolist(), strict=True):
                    old = held.get(x)
                    if old is None:
                        held[x] = [raw[s:e].lower(), k]
                    else:
                        old[1] += k
                if len(held) >= _FLUSH:
                    yield out()
        if held:
            yield out()

    each = texts.mapInArrow(count, "h bigint, word binary, c bigint")
    return each.groupBy("h").agg(F.first("word").alias("word"), F.sum("c").alias("c"))


def id_counts(counts: DataFrame, subwords: Shared) -> DataFrame:
    """(id, n) from the ids of each different word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(subwords.value.end + 1, dtype=np.int64)
        for batch in batches:
            ids, offsets = _lists(subwords.value.ids(batch.column(0).to_pylist()))
            np.add.at(total, ids, np.repeat(batch.column(1).to_numpy(), np.diff(offsets)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(some, pa.int32()), "n": pa.array(total[some])})

    return counts.select("word", "c").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


class Outputs:
    """What the model tells apart: of each id its embedding row, its output, and the logarithm of its share of that.

    Outputs are chosen in two steps, their group and their place in it. A group has outputs of one kind and of about
    one frequency; the frequent ones have few, so that few exponentials are taken for most ids."""

    def __init__(self, n: np.ndarray, begins: np.ndarray):
        order = np.argsort(-n, kind="stable")
        size = len(n)
        place = np.empty(size, dtype=np.int64)
        place[order] = np.arange(size)
        band = np.minimum(BANDS - 1, np.floor(np.log2(np.maximum(1, place / SINGLE))).astype(np.int64))
        output = np.where(place < SINGLE, place, SINGLE + 2 * band + begins)
        n_outputs = SINGLE + 2 * BANDS
        smooth = n + ADDED
        mass = np.bincount(output, weights=smooth, minlength=n_outputs) + 1e-3
        self.share = (np.log(smooth) - np.log(mass[output])).astype(np.float32)
        self.row = np.where(place < KNOWN_IDS, place, KNOWN_IDS + output).astype(np.int32)
        self.n_rows = KNOWN_IDS + n_outputs
        kind = np.append(begins[order[:SINGLE]], np.arange(2 * BANDS) % 2 == 1) if size >= SINGLE else np.append(np.append(begins[order], np.zeros(SINGLE - size, bool)), np.arange(2 * BANDS) % 2 == 1)
        group = np.zeros(n_outputs, dtype=np.int32)
        member = np.zeros(n_outputs, dtype=np.int32)
        self.sizes: list[int] = []
        for k in (False, True):
            mine = np.flatnonzero(kind == k)
            mine = mine[np.argsort(-mass[mine], kind="stable")]
            at = 0
            while at < len(mine):
                part = mine[at : at + (SMALL if at < SMALL * N_SMALL else LARGE)]
                group[part], member[part] = len(self.sizes), np.arange(len(part))
                self.sizes.append(len(part))
                at += len(part)
        self.n_groups = len(self.sizes)
        first = np.concatenate([[0], np.cumsum(self.sizes)])
        column = first[group] + member  # outputs of a group side by side
        self.columns = [(int(first[g]), int(first[g + 1])) for g in range(self.n_groups)]
        self.group, self.column = group[output], column[output].astype(np.int32)
        of_group = np.bincount(group, weights=mass, minlength=self.n_groups)
        self.group_prior = np.log(of_group / of_group.sum()).astype(np.float32)
        self.prior = np.zeros(n_outputs, dtype=np.float32)
        self.prior[column] = np.log(mass / of_group[group])


# ---- the model


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of so many ids in one array: the places of the ids that each window scores, -1 after a text's end, and the
    places of the ids before them, -1 before a text's begin."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    n = -(-lengths // SCORED)
    text = np.repeat(np.arange(len(lengths)), n)
    first = np.cumsum(n) - n
    start = begins[text] + SCORED * (np.arange(len(text)) - first[text])
    scored = start[:, None] + np.arange(SCORED)
    scored[scored >= ends[text][:, None]] = -1
    inputs = start[:, None] + np.arange(-CONTEXT - 1, SCORED - 1)
    inputs[(inputs < begins[text][:, None]) | (inputs >= ends[text][:, None])] = -1
    return scored, inputs


_DISTANCE = (CONTEXT + np.arange(SCORED))[:, None] - np.arange(CONTEXT + SCORED)[None, :]
_SEEN_BY = _DISTANCE >= 0
_AWAY = np.maximum(_DISTANCE, 0)


def first_weights(outputs: Outputs, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    part = DIM // HEADS
    return {
        "embed": normal(outputs.n_rows, DIM, scale=0.3), "q": normal(HEADS, DIM, part, scale=DIM**-0.5), "k": normal(HEADS, DIM, part, scale=DIM**-0.5), "v": normal(HEADS, DIM, part, scale=DIM**-0.5),
        "near": np.stack([-NEARER / 8**h * np.arange(CONTEXT + SCORED, dtype=np.float32) for h in range(HEADS)]),
        "o": normal(DIM, DIM, scale=DIM**-0.5), "w1": normal(DIM, HIDDEN, scale=DIM**-0.5), "b1": np.zeros(HIDDEN, np.float32), "w2": normal(HIDDEN, DIM, scale=HIDDEN**-0.5),
        "group": normal(DIM, outputs.n_groups, scale=0.1), "group_bias": outputs.group_prior.copy(), "out": normal(DIM, len(outputs.prior), scale=0.1), "bias": outputs.prior.copy(),
    }


def _chosen(flat: np.ndarray, weights: np.ndarray, bias: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the softmax of flat @ weights + bias at want, and the softmax less one there."""
    z = flat @ weights
    z += bias
    here = np.arange(len(want))
    found = z[here, want]
    np.exp(z, out=z)
    total = z @ np.ones(len(bias), np.float32)
    if not (np.isfinite(total).all() and total.min() > 0):  # far from zero: once more, less the largest
        z = flat @ weights
        z += bias
        most = z.max(axis=1)
        found = found - most
        z -= most[:, None]
        np.exp(z, out=z)
        total = z.sum(axis=1)
    z /= total[:, None]
    z[here, want] -= 1
    return found - np.log(total), z


def gradients(w: dict[str, np.ndarray], inputs: np.ndarray, ids: np.ndarray, outputs: Outputs) -> tuple[dict[str, np.ndarray], float]:
    """Gradients of the mean negative logarithm over ids (-1 for none), and its value."""
    part, g = DIM // HEADS, {}
    count = len(inputs)
    x = w["embed"].take(inputs.ravel(), axis=0)  # rows of all windows one below the other, as products of whole tables are faster
    xq = x.reshape(count, -1, DIM)[:, CONTEXT:].reshape(-1, DIM)
    root = np.float32(part**-0.5)
    kept = []
    o = np.empty((count, SCORED, DIM), dtype=np.float32)
    for h in range(HEADS):
        q, k, v = ((t @ w[c][h]).reshape(count, -1, part) for t, c in ((xq, "q"), (x, "k"), (x, "v")))
        q *= root
        a = q @ k.transpose(0, 2, 1)
        a += np.where(_SEEN_BY, w["near"][h][_AWAY], np.float32(-1e9))
        a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(axis=2, keepdims=True)
        o[:, :, h * part : (h + 1) * part] = a @ v
        kept.append((q, k, v, a))
    o2 = o.reshape(-1, DIM)
    h1 = o2 @ w["o"]
    h1 += xq
    u = h1 @ w["w1"]
    u += w["b1"]
    np.maximum(u, 0, out=u)
    h2 = u @ w["w2"]
    h2 += h1
    want = ids.ravel()
    some = np.flatnonzero(want >= 0)
    some = some[np.argsort(outputs.group[want[some]], kind="stable")]
    want = want[some]
    flat, group, column = h2.take(some, axis=0), outputs.group[want], outputs.column[want]
    found, p = _chosen(flat, w["group"], w["group_bias"], group)
    g["group"], g["group_bias"] = flat.T @ p, p.sum(axis=0)
    back = p @ w["group"].T
    g["out"], g["bias"] = np.zeros_like(w["out"]), np.zeros_like(w["bias"])
    at = np.searchsorted(group, np.arange(outputs.n_groups + 1))
    for k in np.flatnonzero(np.diff(at)).tolist():
        r, (c, e) = slice(at[k], at[k + 1]), outputs.columns[k]
        more, p = _chosen(flat[r], w["out"][:, c:e], w["bias"][c:e], column[r] - c)
        found[r] += more
        g["out"][:, c:e], g["bias"][c:e] = flat[r].T @ p, p.sum(axis=0)
        back[r] += p @ w["out"][:, c:e].T
    loss = float(-found.mean())
    for k in ("group", "group_bias", "out", "bias"):
        g[k] /= len(want)
    d2 = np.zeros_like(h2)
    back /= np.float32(len(want))
    d2[some] = back
    g["w2"] = u.T @ d2
    du = d2 @ w["w2"].T
    du *= u > 0
    g["w1"], g["b1"] = h1.T @ du, du.sum(axis=0)
    d1 = du @ w["w1"].T
    d1 += d2
    g["o"] = o2.T @ d1
    do, dx = (d1 @ w["o"].T).reshape(o.shape), np.zeros_like(x)
    dxq = d1
    for c in ("q", "k", "v", "near"):
        g[c] = np.zeros_like(w[c])
    for h, (q, k, v, a) in enumerate(kept):
        mine = slice(h * part, (h + 1) * part)
        dm = do[:, :, mine]
        dv = (a.transpose(0, 2, 1) @ dm).reshape(-1, part)
        ds = dm @ v.transpose(0, 2, 1)
        ds -= (dm * o[:, :, mine]).sum(axis=2, keepdims=True)  # the mean of a row by its weights
        ds *= a
        g["near"][h] = np.bincount(_AWAY.ravel(), weights=ds.sum(axis=0).ravel(), minlength=CONTEXT + SCORED)
        dk = (ds.transpose(0, 2, 1) @ q).reshape(-1, part)
        dq = (ds @ k).reshape(-1, part)
        dq *= root
        g["q"][h], g["k"][h], g["v"][h] = xq.T @ dq, x.T @ dk, x.T @ dv
        dxq += dq @ w["q"][h].T
        dx += dk @ w["k"][h].T
        dx += dv @ w["v"][h].T
    dx.reshape(count, -1, DIM)[:, CONTEXT:] += dxq.reshape(count, SCORED, DIM)
    rows, by = inputs.ravel(), np.argsort(inputs.ravel(), kind="stable")
    ordered = rows[by]
    new = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    g["embed"] = np.zeros_like(w["embed"])
    g["embed"][ordered[new]] = np.add.reduceat(dx.take(by, axis=0), new, axis=0)
    return g, loss


def train(w: dict[str, np.ndarray], inputs: np.ndarray, ids: np.ndarray, outputs: Outputs, steps: int, seed: int, rate: float) -> dict[str, np.ndarray]:
    """Weights after so many steps of Adam on batches of windows, gone through in a seeded order again and again.

    Embedding rows that inputs do not name have no gradient; they stay as they are and take no part in the steps."""
    used = np.bincount(inputs.ravel(), minlength=len(w["embed"])) > 0
    whole, inputs = w["embed"].astype(np.float32), (np.cumsum(used) - 1)[inputs]
    w = {k: (v[used] if k == "embed" else v).astype(np.float32) for k, v in w.items()}
    m, s, free = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(3))
    rng, order = np.random.default_rng(seed), np.zeros(0, dtype=np.int64)
    for t in range(1, steps + 1):
        while len(order) < BATCH:
            order = np.append(order, rng.permutation(len(inputs)))
        at, order = order[:BATCH], order[BATCH:]
        g, _ = gradients(w, inputs[at], ids[at], outputs)
        now = rate * min(1.0, t / 20) * (1 - 0.9 * t / steps)
        root = (1 - 0.99**t) ** 0.5
        ratio, least = np.float32(now * root / (1 - 0.9**t)), np.float32(1e-8 * root)
        for k, x in g.items():
            x, buf = x.astype(np.float32, copy=False), free[k]
            m[k] *= np.float32(0.9)
            m[k] += np.multiply(x, np.float32(0.1), out=buf)
            s[k] *= np.float32(0.99)
            np.multiply(x, x, out=buf)
            buf *= np.float32(0.01)
            s[k] += buf
            np.sqrt(s[k], out=buf)
            buf += least
            np.divide(m[k], buf, out=buf)
            buf *= ratio
            w[k] -= buf
    whole[used] = w["embed"]
    return {**w, "embed": whole}


class Scorer:
    """A trained model ready to score: keys, values and queries of each embedding row looked up."""

    def __init__(self, w: dict[str, np.ndarray], outputs: Outputs, end: int):
        self.w, self.outputs, self.end = w, outputs, end
        part = DIM // HEADS
        self.q = [np.ascontiguousarray(w["embed"] @ w["q"][h] * np.float32(part**-0.5)) for h in range(HEADS)]
        self.k = [np.ascontiguousarray(w["embed"] @ w["k"][h]) for h in range(HEADS)]
        one = np.ones((len(w["embed"]), 1), np.float32)  # sums the attention's weights up
        self.v = [np.ascontiguousarray(np.concatenate([w["embed"] @ w["v"][h], one], axis=1)) for h in range(HEADS)]
        self.near = [np.where(_SEEN_BY, np.exp(w["near"][h] - w["near"][h].max())[_AWAY], 0).astype(np.float32) for h in range(HEADS)]
        self.out = [np.ascontiguousarray(w["out"][:, c:e]) for c, e in outputs.columns]
        self.bias = [w["bias"][c:e] for c, e in outputs.columns]

    def log_probabilities(self, ids: np.ndarray, lengths: np.ndarray, batch: int = 192) -> np.ndarray:
        """Natural logarithm of the probability of each id, given those before it in its text."""
        o, w = self.outputs, self.w
        rows, group, column = np.append(o.row[ids], o.row[self.end]), o.group[ids], o.column[ids]
        scored, inputs = windows(lengths)
        out = o.share[ids].astype(np.float64)
        for b in range(0, len(scored), batch):
            x = rows[inputs[b : b + batch]]
            xq = np.ascontiguousarray(x[:, CONTEXT:])
            mixed = np.empty((*xq.shape, DIM), dtype=np.float32)
            for i in range(0, len(x), NEARBY):
                here, there = xq[i : i + NEARBY], x[i : i + NEARBY]
                for h in range(HEADS):
                    a = self.q[h].take(here, axis=0) @ self.k[h].take(there, axis=0).transpose(0, 2, 1)
                    np.exp(a, out=a)
                    a *= self.near[h]
                    part = a @ self.v[h].take(there, axis=0)
                    np.divide(part[:, :, :-1], part[:, :, -1:], out=mixed[i : i + NEARBY, :, h * (DIM // HEADS) : (h + 1) * (DIM // HEADS)])
            at = scored[b : b + batch].ravel()
            some = np.flatnonzero(at >= 0)
            some = some[np.argsort(group[at[some]], kind="stable")]
            at = at[some]
            h1 = mixed.reshape(-1, DIM).take(some, axis=0) @ w["o"]
            h1 += w["embed"].take(xq.ravel()[some], axis=0)
            u = h1 @ w["w1"]
            u += w["b1"]
            np.maximum(u, 0, out=u)
            h1 += u @ w["w2"]
            found = self._logs(h1, w["group"], w["group_bias"], group[at])
            ends = np.searchsorted(group[at], np.arange(o.n_groups + 1)).tolist()
            for k in range(o.n_groups):
                if ends[k] < ends[k + 1]:
                    r = slice(ends[k], ends[k + 1])
                    found[r] += self._logs(h1[r], self.out[k], self.bias[k], column[at[r]] - o.columns[k][0])
            out[at] += found
        return out

    @staticmethod
    def _logs(rows: np.ndarray, weights: np.ndarray, bias: np.ndarray, want: np.ndarray) -> np.ndarray:
        z = rows @ weights
        z += bias
        found = z[np.arange(len(want)), want]
        total = np.exp(z) @ np.ones(len(bias), np.float32)
        if not (np.isfinite(total).all() and total.min() > 0):  # far from zero: once more, less the largest
            most = z.max(axis=1)
            return found - most - np.log(np.exp(z - most[:, None]).sum(axis=1))
        return found - np.log(total)


# ---- training and scoring of tables


class Words:
    """Frequent words by hash: the logarithm of their counts, and their ids; ids of other words are found as needed."""

    def __init__(self, h: np.ndarray, words: list[bytes], c: np.ndarray, subwords: Subwords):
        order = np.argsort(h)
        self.h, self.subwords = h[order], subwords
        self.log_count = np.log10(c[order] + ADDED)
        self.ids, self.offsets = _lists(subwords.ids([words[i] for i in order.tolist()]))
        self.seen: dict[int, list[int]] = {}

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where among the frequent words each hash is, -1 if it is none of theirs."""
        at = np.minimum(np.searchsorted(self.h, h), max(0, len(self.h) - 1))
        return np.where(self.h[at] == h, at, -1) if len(self.h) else np.full(len(h), -1)

    def lists(self, c: Chunk, h: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words with the hashes h, which lie at such bytes of a chunk; at is places(h). Last, those of the end."""
        rare = np.flatnonzero(at < 0).tolist()
        keys = h[rare].tolist()
        new = [i for i, k in zip(rare, keys, strict=True) if k not in self.seen]
        if new:
            if len(self.seen) > _SEEN:
                self.seen.clear()
                new = rare
            raw = c.data
            found = self.subwords.ids([raw[s:e].tobytes() for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            self.seen.update(zip(h[new].tolist(), found, strict=True))
        more, more_at = _lists([*(self.seen[k] for k in keys), [self.subwords.end]])
        every = np.concatenate([self.ids, more])
        begin = np.append(self.offsets[:-1], more_at[:-1] + len(self.ids))
        size = np.append(np.diff(self.offsets), np.diff(more_at))
        pick = at.copy()
        pick[rare] = len(self.h) + np.arange(len(rare))
        pick = np.append(pick, len(begin) - 1)
        size, begin = size[pick], begin[pick]
        offsets = np.append(0, np.cumsum(size))
        return every[np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])], offsets


def _sequences(c: Chunk, words: Words) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Ids of the chunk's texts, an end after each, and how many each has; and what is known of its different words."""
    starts, ends, bounds = c.spans(~SPACES)
    h, first, inverse = np.unique(c.hashes(starts, ends), return_index=True, return_inverse=True)
    at = words.places(h)
    ids, offsets = words.lists(c, h, at, starts[first], ends[first])
    with_ends = np.insert(inverse, bounds[1:], len(h))
    flat, begin = taken(ids, offsets, with_ends)
    last = bounds[1:] + np.arange(1, c.n + 1)  # words and ends of the texts so far
    return flat, np.diff(begin[np.append(0, last)]), (h, at, inverse, bounds)


class LanguageModel:
    """Word counts and trained weights. counts: the rows of word_counts that are not broadcast; total and different: tokens
    and different ones of the training texts; ends: how many those are."""

    def __init__(self, words: Words, counts: DataFrame, total: int, different: int, ends: int, outputs: Outputs, weights: dict[str, np.ndarray], subwords: Subwords):
        self.words, self.counts, self.total, self.different, self.ends = words, counts, total, different, ends
        self.outputs, self.weights, self.subwords = outputs, weights, subwords

    def score(self, docs: DataFrame, staging: Staging, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
        """The columns keep (all by default) of each row, n_tokens, n_known, train_tokens, base_score and score, both
        logarithms to base 10 of a text's probability.

        Tokens are words without ASCII white space, A-Z as a-z, and an end; a null, empty or blank text is an end alone.
        Every row of the input has a row; repeated ones are alike. An empty table gives an empty one; columns with the names
        of what is added are replaced. Without training texts all tokens are unknown and the weights those before training.
        """
        spark = docs.sparkSession
        small_batches(spark)
        added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
        names = [c for c in (docs.columns if keep is None else keep) if c not in added]
        picked = docs.select(packed(names), F.monotonically_increasing_id().alias("uid"), F.col(f"`{text_col}`").cast("string").alias("text"))
        shared = Shared(spark, (self.words, Scorer(self.weights, self.outputs, self.subwords.end)))
        end_log = float(np.log10(self.ends + ADDED))
        new = StructType.fromDDL("n_tokens bigint, n_known bigint, frequent double, score double, rare array<struct<h: bigint, n: int>>")
        rare_kind = pa.struct([("h", pa.int64()), ("n", pa.int32())])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, scorer = shared.value
            ends_known = 1 if end_log > -1 else 0
            for batch in batches:
                for c in chunks(batch.column(2)):
                    flat, sizes, (h, at, inverse, bounds) = _sequences(c, words)
                    logs = scorer.log_probabilities(flat, sizes) / np.log(10)
                    sums = np.add.reduceat(logs, np.cumsum(sizes) - sizes)
                    place = at[inverse]
                    known = place >= 0
                    text = np.repeat(np.arange(c.n), np.diff(bounds))
                    frequent = np.bincount(text[known], weights=words.log_count[place[known]], minlength=c.n)
                    n_known = np.bincount(text[known], minlength=c.n)
                    # different rare words of each text, and how often it has them
                    pair, times = np.unique(text[~known] * np.int64(len(h) + 1) + inverse[~known], return_counts=True)
                    of, which = pair // (len(h) + 1), pair % (len(h) + 1)
                    lists = pa.array(np.searchsorted(of, np.arange(c.n + 1)), pa.int32())
                    rare = pa.StructArray.from_arrays([pa.array(h[which].view(np.int64)), pa.array(times.astype(np.int32))], fields=list(rare_kind))
                    rows = batch.slice(c.first, c.n)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0), rows.column(1), pa.array(np.diff(bounds) + 1), pa.array(n_known + ends_known), pa.array(frequent + end_log), pa.array(sums), pa.ListArray.from_arrays(lists, rare)],
                        names=["__row", "uid", *new.names],
                    )

        scored = staging.save(picked.mapInArrow(score, StructType([*picked.schema.fields[:2], *new.fields])), "scored")
        shared.release()
        rare = scored.select("uid", F.explode("rare").alias("r")).select("uid", F.col("r.h").alias("h"), F.col("r.n").alias("n"))
        # a rare word without a count has the logarithm -1, one with a count has more
        more = rare.join(self.counts.select("h", "c"), "h").groupBy("uid").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.log10(F.col("c") + ADDED) + 1)).alias("gain"))
        unseen = F.aggregate("rare", F.lit(0).cast("bigint"), lambda s, r: s + r["n"])
        met = scored.select("__row", "uid", "n_tokens", "n_known", "score", (F.col("frequent") - unseen).alias("base")).join(more, "uid", "left")
        spread = float(np.log10(self.total + ADDED * (self.different + 1)))
        out = met.withColumns({
            "n_known": F.col("n_known") + F.coalesce("m", F.lit(0)), "train_tokens": F.lit(self.total).cast("bigint"),
            "base_score": F.col("base") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * spread,
        })
        return unpacked(out, names, added)


def fit(docs: DataFrame, ranks: dict[bytes, int], staging: Staging, text_col: str = "text", id_col: str = "doc_id", seed: int = 11) -> LanguageModel:
    """A model of all rows of docs: counts of all their words, and weights trained on all their ids, a window in one round
    (in each, if they have LEAST_TOKENS at most)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ends = rows.count()
    counts = staging.save(word_counts(rows.select("text")), "counts")
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, different = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    subwords = Subwords(ranks)
    shared = Shared(spark, subwords)
    n = np.zeros(subwords.end + 1, dtype=np.int64)
    for r in id_counts(counts, shared).collect():  # as many as the vocabulary has
        n[r["id"]] = r["n"]
    n[subwords.end] = ends
    outputs = Outputs(n, subwords.begins())

    # frequent words: as many steps of frequency, from above, as hold TOP_WORDS words at most
    step = F.floor(8 * F.log2("c"))
    steps = sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"])
    held, least = 0, None
    for r in steps:
        held += r["count"]
        if held > TOP_WORDS:
            break
        least = r["step"]
    top = counts.where(step >= least) if least is not None else counts.limit(0)
    top = top.select("h", "word", "c").toArrow()
    words = Words(top["h"].to_numpy().view(U), top["word"].to_pylist(), top["c"].to_numpy(), subwords)
    rare = counts.where(step < least) if least is not None else counts

    known = Shared(spark, words)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                flat, sizes, _ = _sequences(c, known.value)
                out, key, at = [], [], 0
                for k, m in zip(batch.column(0).slice(c.first, c.n).to_pylist(), sizes.tolist(), strict=True):
                    cut = [flat[i : min(i + PIECE, at + m)] for i in range(at, at + m, PIECE)]
                    out += cut
                    key += [f"{k}/{j}" for j in range(len(cut))]
                    at += m
                n_windows = [-(-len(x) // SCORED) for x in out]
                yield pa.RecordBatch.from_pydict({"key": pa.array(key, pa.string()), "ids": pa.array(out, pa.list_(pa.int32())), "n_windows": pa.array(n_windows, pa.int32())})

    dealt = staging.save(rows.mapInArrow(pieces, "key string, ids array<int>, n_windows int"), "pieces")
    room = SCORED * (dealt.agg(F.sum("n_windows")).first()[0] or 0)  # ids if all windows were full
    n_shards = max(1, -(-room // SHARD_TOKENS))
    cell = F.pmod(F.xxhash64("key", "ids", F.lit(seed)), F.lit(n_shards * ROUNDS))
    drawn = dealt.select("key", "ids", (cell % n_shards).alias("shard"), F.floor(cell / n_shards).alias("round"))
    weights = first_weights(outputs, seed)
    shapes = {k: v.shape for k, v in weights.items()}
    least_steps = int(LEAST_TOKENS / (n_shards * BATCH * SCORED * ROUNDS))
    for r in range(ROUNDS):
        start = Shared(spark, (weights, outputs, subwords.end))

        def shard(table: pa.Table) -> pa.Table:
            weights, outputs, end = start.value
            table = table.sort_by([("key", "ascending")])  # the same order whoever has sent the rows
            lists = table["ids"].combine_chunks()
            lengths = np.diff(lists.offsets.to_numpy())
            ids = lists.flatten().to_numpy().astype(np.int64)
            scored, inputs = windows(lengths)
            rows = np.append(outputs.row[ids], outputs.row[end])
            steps = max(least_steps, -(-len(scored) // BATCH))  # each window once at least
            new = train(weights, rows[inputs], np.append(ids, -1)[scored], outputs, steps, seed + r, LEARNING * 0.6**r)
            flat = np.concatenate([new[k].ravel() for k in weights]).astype(np.float64)
            return pa.table({"at": pa.array(np.arange(len(flat)), pa.int32()), "total": flat * len(ids), "n": pa.array(np.full(len(flat), len(ids)), pa.int64())})

        mine = drawn.where(F.col("round") == r) if room > LEAST_TOKENS else drawn
        each = mine.groupBy("shard").applyInArrow(shard, "at int, total double, n bigint")
        mean = each.groupBy("at").agg((F.sum("total") / F.sum("n")).alias("v")).toArrow().sort_by([("at", "ascending")])  # as many rows as weights
        if len(mean):
            flat, at = mean["v"].to_numpy().astype(np.float32), 0
            for k, shape in shapes.items():
                size = int(np.prod(shape))
                weights[k], at = flat[at : at + size].reshape(shape), at + size
        start.release()
    for s in (shared, known):
        s.release()
    staging.drop(dealt)
    return LanguageModel(words, rare, total, different, ends, outputs, weights, subwords)
