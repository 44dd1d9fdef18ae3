"""A join of texts by edit distance: by halves where few edits are allowed, else over an inverted index of q-grams.

A pair is similar if 1 - distance / longer length reaches theta, so that a text's length bounds the edits of a pair that it
is in. If these are three at most, one half of b has one edit at most against a begin or an end of a. Different halves and
such parts of a are matched first, by what is left of them without one letter, and then the rest of each pair of texts is
verified by the edits that are left for it. So texts that are put together from few parts meet by long pieces, not by the
many grams that they share.

Other pairs meet by grams. An edit changes q grams at most. So of grams ranked by how rare they are, the first q * edits + 1 of both texts have
one in common, at places that are no further apart than the edits (position filter), and the texts share all but
q * edits of their different grams (count filter). What passes is verified by the distance itself, computed no further than
the bound. Grams of two letters promise nothing for the shortest texts; pairs of such texts meet by single letters, of
which any theta over 0 leaves one in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.staging import save
from .similarity import levenshtein, normal

LEAST, MOST = 8, 3  # characters of the longer text of a pair that is matched by halves, and its edits at most


def _grams(text: Column, q: int) -> Column:
    """Runs of q characters, in order; none for a shorter text."""
    n = F.length(text) - q + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))


def _edits(longer: Column, theta: float) -> Column:
    return F.floor((1 - F.lit(theta)) * longer + 1e-9).cast("int")


def _candidates(a: DataFrame, b: DataFrame, theta: float, q: int) -> DataFrame:
    """(a, b) of texts that share a gram of their prefixes and pass the length, position and count filters."""
    left, right = (rows.select(F.col(c).alias(c), F.length(c).alias(f"n_{c}"), _grams(F.col(c), q).alias(f"g_{c}")) for rows, c in ((a, "a"), (b, "b")))
    every = left.select(F.explode("g_a").alias("g")).unionByName(right.select(F.explode("g_b").alias("g")))
    rank = every.groupBy("g").agg(F.count("*").alias("often"))

    def prefix(rows: DataFrame, c: str) -> DataFrame:
        each = rows.select(c, f"n_{c}", F.array_distinct(f"g_{c}").alias(f"d_{c}"), F.posexplode(f"g_{c}").alias(f"at_{c}", "g")).join(rank, "g")
        most = q * _edits(F.col(f"n_{c}") / theta, theta) + 1  # the longer text of a pair may have n / theta characters
        place = F.rank().over(W.partitionBy(c).orderBy("often", "g"))  # equal grams have one place
        return each.withColumn("place", place).where(F.col("place") <= most).select("g", c, f"n_{c}", f"at_{c}", f"d_{c}")

    met = prefix(left, "a").join(prefix(right, "b"), "g")
    most = _edits(F.greatest("n_a", "n_b"), theta)
    met = met.where((F.abs(F.col("n_a") - F.col("n_b")) <= most) & (F.abs(F.col("at_a") - F.col("at_b")) <= most))
    return met.where(F.size(F.array_intersect("d_a", "d_b")) >= F.greatest(F.size("d_a"), F.size("d_b")) - q * most).select("a", "b").distinct()


def _by_halves(longer: Column, theta: float) -> Column:
    """Whether pairs with this longer length are matched by halves."""
    return (longer >= LEAST) & (_edits(longer, theta) <= MOST)


def _letters(text: Column) -> Column:
    """A bit for each letter, of 64 in all: an edit changes two of them at most."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda s, c: s.bitwiseOR(bit(c)))


def _half_pairs(a: DataFrame, b: DataFrame, theta: float) -> DataFrame:
    """(a, b) of all texts within their edits whose longer length is one for halves; a pair may be repeated."""
    n = F.length("b")
    halves = F.array(*(F.struct(F.lit(side).alias("side"), F.substring("b", i, k).alias("half"), F.substring("b", j, m).alias("rest_b")) for side, i, k, j, m in ((0, F.lit(1), F.ceil(n / 2).cast("int"), F.ceil(n / 2).cast("int") + 1, n), (1, F.ceil(n / 2).cast("int") + 1, n, F.lit(1), F.ceil(n / 2).cast("int")))))
    of_b = b.select("b", n.alias("n_b"), F.explode(halves).alias("h")).select("b", "n_b", "h.*").withColumn("letters_b", _letters(F.col("rest_b")))

    n = F.length("a")
    off = F.least(F.lit(MOST), _edits(n / theta, theta))  # by how much the other text may be longer or shorter
    # half of b, rounded up or down, is as long as the part of a, or one longer or shorter
    cuts = F.sequence(F.greatest(F.lit(0), F.floor((n - off) / 2).cast("int") - 1), F.least(n, F.ceil((n + off) / 2).cast("int") + 1))
    begins = F.transform(cuts, lambda c: F.struct(F.lit(0).alias("side"), F.substring("a", F.lit(1), c).alias("part"), F.substring("a", c + 1, n).alias("rest_a")))
    ends = F.transform(cuts, lambda c: F.struct(F.lit(1).alias("side"), F.substring("a", n - c + 1, c).alias("part"), F.substring("a", F.lit(1), n - c).alias("rest_a")))
    of_a = a.select("a", n.alias("n_a"), F.explode(F.concat(begins, ends)).alias("p")).select("a", "n_a", "p.*").withColumn("letters_a", _letters(F.col("rest_a")))

    def variants(rows: DataFrame, c: str) -> DataFrame:
        text = F.col(c)
        without = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))
        return rows.select("side", c).distinct().select("side", c, F.explode(F.array_distinct(F.concat(F.array(text), F.when(F.length(text) > 0, without).otherwise(F.array().cast("array<string>"))))).alias("v"))

    parts = variants(of_a, "part").join(variants(of_b, "half"), ["side", "v"]).select("side", "part", "half").distinct()
    parts = parts.withColumn("first_edits", F.levenshtein("part", "half")).where("first_edits <= 1")
    longer = F.greatest("n_a", "n_b")
    most = _edits(longer, theta)
    fits = _by_halves(longer, theta) & (longer - F.least("n_a", "n_b") <= most) & (2 * F.col("first_edits") <= most)
    met = of_b.join(parts, ["side", "half"]).join(of_a, ["side", "part"]).where(fits).withColumn("left", most - F.col("first_edits"))
    met = met.where(F.bit_count(F.col("letters_a").bitwiseXOR(F.col("letters_b"))) <= 2 * F.col("left"))
    return met.where("levenshtein(rest_a, rest_b, left) >= 0").select("a", "b")


def edit_matches(left: DataFrame, right: DataFrame, theta: float) -> DataFrame:
    """(a, b, similarity) of different texts of left (a) and right (b) whose similarity by levenshtein reaches theta, which
    is over 0. Texts that are equal after normal() have 0.98 at least. Null texts match nothing."""
    if not 0 < theta <= 1:
        raise ValueError("theta must be over 0 and 1 at most")
    a, b = (save(rows.select(c).where(f"{c} IS NOT NULL").distinct(), "texts") for rows, c in ((left, "a"), (right, "b")))
    q = 2 if theta > 0.5 else 1
    # texts that may be in a pair for halves, and in one for grams: its longer text has n to n / theta characters
    by_halves = lambda c: (F.length(c) / theta >= LEAST) & (_edits(F.length(c), theta) <= MOST)
    by_grams = lambda c: (F.length(c) < LEAST) | (_edits(F.length(c) / theta, theta) > MOST)
    near = _half_pairs(a.where(by_halves("a")), b.where(by_halves("b")), theta)
    some_a, some_b = a.where(by_grams("a")), b.where(by_grams("b"))
    found = _candidates(some_a, some_b, theta, q)
    if q == 2:
        # two letters promise a common gram if n - 1 - 2 * edits is over 0
        promised = lambda c: F.length(c) - 1 - 2 * _edits(F.length(c), theta) > 0
        limit = int(2 / (2 * theta - 1)) + 2  # of the lengths that may be without the promise
        found = found.unionByName(_candidates(some_a.where((F.length("a") <= limit) & (F.length("a") > 0)), some_b.where((F.length("b") <= limit) & (F.length("b") > 0)), theta, 1).where(~promised("a") | ~promised("b")))
    longer = F.greatest(F.length("a"), F.length("b"))
    found = found.where(~_by_halves(longer, theta)).distinct().withColumn("most", _edits(longer, theta)).where("levenshtein(a, b, most) >= 0").drop("most")
    found = found.unionByName(near.distinct()).where(normal(F.col("a")) != normal(F.col("b")))
    same = a.withColumn("k", normal(F.col("a"))).join(b.withColumn("k", normal(F.col("b"))), "k").select("a", "b")
    out = found.unionByName(same).withColumn("similarity", levenshtein(F.col("a"), F.col("b")))
    return out.where(F.col("similarity") >= theta)
