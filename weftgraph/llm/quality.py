"""Quality rules: statistics of whole texts, and robust outliers among them for each language and source.

Everything is DataFrame expressions. A group's center and covariance are minimum-covariance-determinant estimates: of
all sets with 75 % of the rows, the one whose covariance has the least determinant is sought. From each of several
starts (medians and quartiles, and moments of seeded parts of the rows) concentration steps fit mean and covariance to
the rows that lie nearest, until the determinant gets no smaller; the start that ends lowest counts. Statistics of texts
are often the same for nearly all texts of a group, so that the determinant would be 0; covariances are therefore
regularized by target variances that are added to them, as in the minimum regularized covariance determinant. Rows far
out by their Mahalanobis distance are rejected. Moments and quantiles are aggregates that combine on the map side, so
that a group with most of the rows is no burden.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import set_aside
from .staging import Staging

MIN_GROUP = 200  # usable rows that a group needs for an estimate of its own
INNER = 0.75  # share of the rows that an estimate rests on
STARTS = 3  # parts of the rows, each an eighth, from whose moments concentration also starts
SETTLED = 1e-4  # a step that lowers the logarithm of the determinant by less is the last
CUTOFF = 60.0  # squared distance; chi-square with five degrees of freedom exceeds 36 once in a million
MEDIAN_CHI2 = 4.3515  # fixed value: median of chi-square with five degrees of freedom
TARGETS = (0.35, 0.06, 0.4, 0.8, 1.0)  # standard deviations of the transformed statistics that are added to those of a group
_AXES = range(5)
_FIT = [*(f"m{i}" for i in _AXES), *(f"l{i}{j}" for i in _AXES for j in range(i + 1)), "logdet"]
_STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_OWN = {*_FIT, *(f"x{i}" for i in _AXES), "g", "scale", "d"}
_BLANKS = " \t\n\x0b\x0c\r"


def text_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long).

    Words are runs without white space. A window is five consecutive words; windows are compared by a 64-bit hash
    of their words' hashes within one text. A null text has no words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), text.alias("__text"))
    rows = rows.withColumn("__words", F.split(F.trim("__text", F.lit(_BLANKS)), f"[{_BLANKS}]+"))
    at = F.when(F.size("__words") >= 5, F.sequence(F.lit(0), F.size("__words") - 5)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("__windows", F.transform(at, lambda i: F.xxhash64(*(F.get("__hashes", i + j) for j in range(5)))))
    windows = F.col("__windows")
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    rows = rows.withColumn("__sorted", F.when(some, F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    order = F.col("__sorted")
    again = F.transform(order, lambda x, k: F.when((F.get(order, k - 1)["h"] == x["h"]) | (F.get(order, k + 1)["h"] == x["h"]), x["i"]))
    places = F.sort_array(F.filter(again, lambda i: i.isNotNull()))
    covered = F.aggregate(places, F.struct(F.lit(-5).alias("last"), F.lit(0).alias("total")), lambda s, i: F.struct(i.alias("last"), (s["total"] + F.least(F.lit(5), i - s["last"])).alias("total")), lambda s: s["total"])
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(f"[^{_BLANKS}]"))
    empty = F.get("__words", F.lit(0)) == ""
    rows = rows.withColumn("__lines", lines)
    return rows.select(
        *(F.col(f"`{c}`") for c in keep),
        F.when(empty, 0).otherwise(F.size("__words")).cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(order.isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vector() -> list[Column]:
    n = F.col("n_words") + 1
    return [
        F.log1p("n_words"),
        F.log((F.col("word_chars") + 1) / n),
        F.log1p(1000 * F.col("n_symbols") / (F.col("word_chars") + 1)),
        F.log1p(1000 * F.col("n_dup_lines") / n),
        F.log1p(1000 * F.col("n_repeat_words") / n),
    ]


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean m0.., lower Cholesky factor l00, l10, .. of each group's regularized covariance, and logdet."""
    sums = [F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in _AXES), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i in _AXES for j in range(i + 1))]
    out = rows.groupBy(*by).agg(*sums).withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in _AXES})
    out = out.select(*by, *(f"m{i}" for i in _AXES), *((F.greatest(F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"), F.lit(0.0)) + F.lit(TARGETS[i] ** 2) if i == j else F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{i}{j}") for i in _AXES for j in range(i + 1)))
    for j in _AXES:
        dots = {i: reduce(lambda a, b: a + b, (F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0)) for i in range(j, 5)}
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - dots[j], F.lit(1e-6))))
        if j < 4:
            out = out.withColumns({f"l{i}{j}": (F.col(f"c{i}{j}") - dots[i]) / F.col(f"l{j}{j}") for i in range(j + 1, 5)})
    return out.select(*by, *_FIT[:-1], _logdet().alias("logdet"))


def _logdet() -> Column:
    return reduce(lambda a, b: a + b, (2 * F.log(f"l{i}{i}") for i in _AXES))


def _distance() -> Column:
    z: list[Column] = []
    for i in _AXES:
        z.append((F.col(f"x{i}") - F.col(f"m{i}") - reduce(lambda a, b: a + b, (F.col(f"l{i}{k}") * z[k] for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, (v * v for v in z))


def least_determinants(rows: DataFrame, staging: Staging) -> DataFrame:
    """g, mean, Cholesky factor and logdet of the least determinant that a start ended with, for each g of rows (g, x0..)."""
    by = ["g", "start"]
    quartiles = rows.groupBy("g").agg(*(F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 10000).alias(f"q{i}") for i in _AXES))
    spread = [(F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(TARGETS[i])) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in _AXES for j in range(i + 1)]
    part = F.pmod(F.xxhash64(*(f"x{i}" for i in _AXES)), F.lit(8)).cast("int")
    parts = rows.withColumn("start", part).where(F.col("start") < STARTS)
    fit = quartiles.select("g", F.lit(-1).alias("start"), *(F.col(f"q{i}")[1].alias(f"m{i}") for i in _AXES), *spread).unionByName(_moments(parts, by).drop("logdet"))
    # the determinants of the starts are of other sets, so that the first step is always taken
    going = staging.save(fit.withColumn("logdet", F.lit(float("inf"))), "starts")
    ended: list[DataFrame] = []
    while going.limit(1).count():
        measured = rows.join(going, "g").withColumn("d", _distance())
        cut = measured.groupBy(*by).agg(F.percentile_approx("d", INNER, 10000).alias("cut"))
        nearest = measured.select(*by, *(f"x{i}" for i in _AXES), "d").join(cut, by).where(F.col("d") <= F.col("cut"))
        before = going.select(*by, F.col("logdet").alias("before"))
        step = staging.save(_moments(nearest, by).join(before, by), "step")
        ended.append(step.drop("before"))
        going = step.where(F.col("before") - F.col("logdet") > SETTLED).drop("before")
    every = reduce(DataFrame.unionByName, ended) if ended else going
    best = every.groupBy("g").agg(F.min(F.struct("logdet", "start", *_FIT[:-1])).alias("v"))
    return staging.save(best.select("g", *(F.col(f"v.{c}").alias(c) for c in _FIT)), "fits")


def judge_quality(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """The columns keep (doc_id by default) of each row of docs, its statistics, base_failed, distance and kept.

    A text fails the base with fewer than ten words or more than a fifth of them in repeated windows; such rows
    take no part in the estimates and have no distance. Groups of fewer than MIN_GROUP usable rows are judged
    with all such groups of their language, and if these are too few, with all such of any language. A null
    language or source is a group like any other. Columns with the names of what is added are replaced. An empty table
    gives an empty result.
    """
    staging = Staging(docs.sparkSession)
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in _STATISTICS and c not in ("base_failed", "distance", "kept")]
    docs, keep, back = set_aside(docs, keep, lambda c: c.startswith("__") or "." in c or c in _OWN)
    base = docs.withColumns({"__lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("\0")), "__source": F.coalesce(F.col(source_col).cast("string"), F.lit("\0"))})
    table = staging.save(text_statistics(base, [*keep, "__lang", "__source"], text_col), "statistics")
    usable = table.where(~base_failed())
    sizes = usable.groupBy("__lang", "__source").agg(F.count("*").alias("n"))
    small = F.col("n") < MIN_GROUP
    langs = sizes.where(small).groupBy("__lang").agg(F.sum("n").alias("rest"))
    groups = sizes.join(langs, "__lang", "left").select("__lang", "__source", F.when(~small, F.concat_ws("\1", "__lang", "__source")).when(F.col("rest") >= MIN_GROUP, F.concat(F.lit("\2"), F.col("__lang"))).otherwise("\3").alias("g"))
    groups = staging.save(groups, "groups")
    axes = [v.alias(f"x{i}") for i, v in enumerate(_vector())]
    rows = staging.save(usable.join(groups, ["__lang", "__source"]).select("g", *axes), "vectors")

    fit = least_determinants(rows, staging)
    measured = rows.join(fit, "g").withColumn("d", _distance())
    middle = measured.groupBy("g").agg(F.percentile_approx("d", 0.5, 10000).alias("middle"))
    fit = staging.save(fit.join(middle, "g").withColumn("scale", F.greatest(F.lit(1.0), F.col("middle") / MEDIAN_CHI2)).drop("middle", "logdet"), "fit")
    # equal statistics have equal results, so each row is measured again from its own
    judged = table.join(groups, ["__lang", "__source"], "left").join(fit, "g", "left").withColumns({f"x{i}": v for i, v in enumerate(_vector())})
    failed = base_failed()
    distance = F.when(~failed, _distance() / F.col("scale"))
    out = judged.select(*(F.col(f"`{c}`") for c in keep), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), distance.alias("distance"))
    return back(out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)))
