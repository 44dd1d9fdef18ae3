"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features of a whole text: densities and strengths of a lexicon that is learned from labelled texts, how near
its words stand to words of the second person, capitals, punctuation, and signs of obfuscation (digits or symbols
inside words, stretched letters, words spelled letter by letter). Labels are used to learn only; language,
source and id are no inputs.

The lexicon holds words and word beginnings that toxic texts have more often. Lexicon weights for the texts that
the trees are fitted on come from the other half of them (by a hash of the text, so that copies stay together);
the trees so learn how far words that were seen rarely can be trusted. Texts to be scored get weights from all
labelled texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import Shared, map_columns, set_aside
from .staging import Staging, small_batches

MAX_TRAINING_ROWS = 200_000  # labelled texts that the model is fitted on, the first by a hash of their text
MIN_TOXIC = 3  # toxic texts that must hold a term of the lexicon
MIN_WEIGHT = 0.7  # and how much likelier, as a logarithm, it must make a text toxic
_TOKEN = re.compile(r"[^\s.,;:!?\"()\[\]{}<>…«»„“”]+")
_INNER = re.compile(r"[^\W\d_][\d@$*#!|+]+[^\W\d_]|[^\W\d_][@$*#|]", re.UNICODE)
_STRETCHED = re.compile(r"(.)\1\1", re.DOTALL)
_STARRED = re.compile(r"[^\W\d_]+[*#@$%!]{2,}|[*#@$%]{2,}[^\W\d_]+")
#: Common forms of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti usted ustedes tus vosotros".split())
#: Digits and symbols that stand for letters.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"})
NEAR = 5  # words
KEPT_WORDS = 150_000  # words whose part in the features a worker remembers, and as many from before those
#: Of each byte: 1 capital of ASCII, 2 punctuation of ASCII, 3 exclamation mark, 4 question mark, 0 other.
_KINDS = np.array([1 if 65 <= c <= 90 else 3 if c == 33 else 4 if c == 63 else 2 if 33 < c < 127 and not chr(c).isalnum() else 0 for c in range(256)])
FEATURES = ("lexicon", "strong", "sure", "top", "second", "third", "distinct", "beginnings", "near_you", "you", "folded", "capitals", "shouted", "exclaims", "questions", "punctuation", "inner", "stretched", "spelled", "starred", "length", "hits", "weight")
_STEMS = (4, 5, 6)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def fold(word: str) -> str:
    """A word without the usual disguises: symbols for letters, stretched letters, marks between letters."""
    word = re.sub(r"[*_\-.'’`~^]", "", word.translate(_LEET))
    return re.sub(r"(.)\1{2,}", r"\1", word)


def terms(word: str) -> list[str]:
    return [word, *(f"{word[:k]}…" for k in _STEMS if len(word) > k)]


class Lexicon:
    """Weights of terms: the shrunken logarithm of how much likelier they make a text toxic; of terms with a weight
    over zero also in how many toxic texts they were."""

    def __init__(self, counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int):
        self.weights: dict[str, tuple[float, float]] = {}
        for term, (toxic, clean) in counts.items():
            weight = math.log((toxic + 0.2) / (n_toxic + 1)) - math.log((clean + 1.0) / (n_clean + 1))
            if toxic >= MIN_TOXIC and weight > MIN_WEIGHT:
                self.weights[term] = (weight, math.log(toxic))
        self.seen: dict[str, tuple | int] = {}
        self.before: dict[str, tuple | int] = {}

    def lookup(self, word: str) -> tuple[float, float, bool]:
        """Weight and strength of a word, and whether only a beginning of it is in the lexicon."""
        exact = self.weights.get(word)
        stem = max((self.weights[t] for t in terms(word)[1:] if t in self.weights), default=None)
        return (*max((x for x in (exact, stem) if x), default=(0.0, 0.0)), exact is None and stem is not None)

    def of(self, raw: str) -> tuple | int:
        """What a run of characters without white space adds to a text's features; 0 if nothing, as most do.

        Weight, strength, beginning only, second person, folded, shouted, inner, stretched, starred, single letter.
        """
        weight, strength, stem, you, folded = 0.0, 0.0, False, 0, 0
        for w in _TOKEN.findall(raw.lower()):
            you |= w in SECOND_PERSON
            found = self.lookup(w)
            if not found[0] and not w.isalpha() and (f := fold(w)) != w and (hidden := self.lookup(f))[1] > 1.5:
                found, folded = hidden, 1
            if found[:2] > (weight, strength):
                weight, strength, stem = found
        marks = 0 if raw.isalpha() and raw.islower() else (len(raw) > 2 and raw.isupper(), bool(_INNER.search(raw)), bool(_STARRED.search(raw)))
        stretched, single = bool(_STRETCHED.search(raw)), len(raw) == 1 and raw.isalpha()
        if not (weight or you or stretched or single or marks and any(marks)):
            return 0
        shouted, inner, starred = marks or (False, False, False)
        return weight, strength, stem, you, folded, shouted, inner, stretched, starred, single


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    seen, before, of, found = lexicon.seen, lexicon.before, lexicon.of, []
    for i, raw in enumerate(words):
        x = seen.get(raw)
        if x is None:
            if len(seen) >= KEPT_WORDS:
                before, seen = seen, {}
                lexicon.before, lexicon.seen = before, seen
            x = before.get(raw)
            x = seen[raw] = of(raw) if x is None else x
        if x:
            found.append((i, x))
    hits = [(x[0], x[1], x[2], i, words[i].lower()) for i, x in found if x[0]]
    you = [i for i, x in found if x[3]]
    singles = {i for i, x in found if x[9]}
    ordered = sorted((w * min(1.0, s / 4) for w, s, *_ in hits), reverse=True) + [0.0, 0.0, 0.0]
    near = 0
    if you and hits:
        at = np.array(you)
        after = np.searchsorted(at, [h[3] for h in hits])
        near = sum(1 for h, k in zip(hits, after.tolist(), strict=True) if k < len(at) and at[k] - h[3] <= NEAR or k and h[3] - at[k - 1] <= NEAR)
    kinds = np.bincount(_KINDS[np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)], minlength=5)
    return [
        sum(h[0] for h in hits) / n, sum(1 for h in hits if h[0] > 2) / n, sum(1 for h in hits if h[0] > 2 and h[1] > 3), ordered[0], ordered[1], ordered[2],
        len({h[4] for h in hits if h[0] > 1.5}), sum(h[2] for h in hits) / n, near / n, len(you) / n, sum(x[4] for _, x in found), kinds[1] / chars, sum(x[5] for _, x in found) / n,
        kinds[3] / n, kinds[4] / n, (kinds[2] + kinds[3] + kinds[4]) / chars, sum(x[6] for _, x in found) / n, sum(x[7] for _, x in found) / n,
        sum(1 for i in singles if {i + 1, i + 2, i + 3} <= singles), sum(x[8] for _, x in found) / n, math.log1p(len(words)), len(hits), sum(h[0] * h[1] for h in hits),
    ]


class ToxicityModel:
    """A lexicon, trees and a calibration; without labels of both kinds a constant."""

    def __init__(self, lexicon: Lexicon | None, trees, isotonic, prior: float):
        self.lexicon, self.trees, self.isotonic, self.prior = lexicon, trees, isotonic, prior

    def score(self, docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
        """The columns keep (all by default) of each row of docs, and score (0 to 1) and predicted (1 from 0.5).

        Null and empty texts get the score of a text without words. Columns named score or predicted are replaced.
        """
        keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
        docs, keep, back = set_aside(docs, keep)
        if self.trees is None:
            scored = docs.select(*(F.col(f"`{c}`") for c in keep), F.lit(float(self.prior)).alias("score"))
        else:
            shared = Shared(docs.sparkSession, self.lexicon)

            def make(columns: list[pa.Array]) -> list:
                return [[features(t, shared.value) for t in columns[0].to_pylist()]]

            rows = map_columns(docs, [F.col(text_col)], make, "__x array<double>", keep)
            scored = _judged(self.trees, rows.withColumn("__features", array_to_vector("__x")))
            scored = self.isotonic.transform(scored).select(*(F.col(f"`{c}`") for c in keep), F.least(F.lit(1.0), F.greatest(F.lit(0.0), "__y")).alias("score"))
        return back(scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def _judged(trees, vectors: DataFrame) -> DataFrame:
    """vectors with __p, the trees' probability of label 1."""
    return trees.transform(vectors).withColumn("__p", vector_to_array("__probability")[1])


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label", max_rows: int = MAX_TRAINING_ROWS, seed: int = 7) -> ToxicityModel:
    """A model of labelled rows (text, label 0 or 1); rows with a null label are left out.

    At most about max_rows rows are used, those with the least hash of their text, which is the only bound.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    staging = Staging(spark)
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("double").alias("label"))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 20)))
    total = rows.count()
    if total > max_rows:
        rows = rows.where(F.col("h") < int((1 << 20) * max_rows / total))
    rows = staging.save(rows.withColumn("half", (F.col("h") % 2).cast("int")), "labelled")
    sizes = {(int(r[0]), int(r[1])): r[2] for r in rows.groupBy("half", "label").count().collect()}
    toxic, clean = (sum(sizes.get((h, k), 0) for h in (0, 1)) for k in (1, 0))
    if not toxic or not clean:
        return ToxicityModel(None, None, None, toxic / (toxic + clean) if toxic + clean else 0.0)

    def counting(wanted: Shared | None):
        """Counts, for each half, the texts that hold each term, of all terms or of those wanted."""
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: Counter = Counter()

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_pydict({"half": pa.array([h for h, _ in counts], pa.int32()), "term": pa.array([t for _, t in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

            for batch in batches:
                for half, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held = {t for w in set(tokens(text)) for t in terms(w)}
                    counts.update((half, t) for t in (held if wanted is None else held & wanted.value))
                    if len(counts) > 200_000:
                        yield out()
                        counts = Counter()
            if counts:
                yield out()

        return count

    def counted(label: int, name: str, wanted: Shared | None = None) -> DataFrame:
        each = rows.where(F.col("label") == label).select("half", "text").mapInArrow(counting(wanted), "half int, term string, n bigint")
        return each.groupBy("term").agg(*(F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"{name}{h}") for h in (0, 1)))

    # a term in fewer toxic texts is in none of the lexicons
    often = counted(1, "t").where(F.col("t0") + F.col("t1") >= MIN_TOXIC)
    in_clean = counted(0, "c", Shared(spark, frozenset(r[0] for r in often.select("term").collect())))
    counts = often.join(in_clean, "term", "left").fillna(0)
    # terms that one of the three lexicons keeps, by the rule of Lexicon
    of_half = [(F.col(f"t{h}"), F.col(f"c{h}"), sizes.get((h, 1), 0), sizes.get((h, 0), 0)) for h in (0, 1)]
    of_half.append((F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1"), toxic, clean))
    kept = reduce(lambda p, q: p | q, ((t >= MIN_TOXIC) & (F.log((t + 0.2) / (nt + 1)) - F.log((c + 1.0) / (nc + 1)) > MIN_WEIGHT - 1e-9) for t, c, nt, nc in of_half))
    found = counts.where(kept).collect()
    in_toxic = {r["term"]: (r["t0"], r["t1"]) for r in found}
    in_clean = {r["term"]: (r["c0"], r["c1"]) for r in found}
    cross = [Lexicon({t: (n[1 - h], in_clean[t][1 - h]) for t, n in in_toxic.items()}, sizes.get((1 - h, 1), 0), sizes.get((1 - h, 0), 0)) for h in (0, 1)]
    final = Lexicon({t: (sum(n), sum(in_clean[t])) for t, n in in_toxic.items()}, toxic, clean)
    shared = Shared(spark, cross)

    def make(columns: list[pa.Array]) -> list:
        return [[features(t, shared.value[h]) for t, h in zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True)]]

    seen = staging.save(map_columns(rows, [F.col("text"), F.col("half")], make, "__x array<double>", ["label", "h"]).repartition(max(2, min(32, int(total // 20_000)))), "seen")
    vectors = seen.withColumn("fold", F.floor(F.col("h") / 2) % 2).withColumn("__features", array_to_vector("__x"))
    gbt = GBTClassifier(featuresCol="__features", labelCol="label", predictionCol="__prediction", maxIter=20, maxDepth=4, stepSize=0.2, maxBins=32, minInstancesPerNode=max(1, min(10, toxic // 10)), subsamplingRate=1.0, seed=seed, cacheNodeIds=False)
    gbt._set(rawPredictionCol="__raw", probabilityCol="__probability")
    # the calibration is fitted on probabilities of texts that the trees behind them have not seen
    unseen = [_judged(gbt.fit(apart), vectors.where(F.col("fold") == k)).select("__p", "label") for k in (0, 1) if (apart := vectors.where(F.col("fold") != k)).limit(1).count()]
    trees = gbt.fit(vectors)
    judged = reduce(DataFrame.unionByName, unseen) if len(unseen) == 2 else _judged(trees, vectors)  # rows with one text are in one fold
    isotonic = IsotonicRegression(featuresCol="__p", labelCol="label", predictionCol="__y").fit(judged)
    return ToxicityModel(final, trees, isotonic, toxic / (toxic + clean))
