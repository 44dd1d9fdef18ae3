"""Links between similar sets of hashes that share a token, without all pairs of a token's group.

members has a row for each different set: id binary, n int (its size), m int (how many of its hashes another set may
hold), toks array<struct<tok bigint, pos int>> and odd array<bigint>. sets has (id, hashes), repeated for copies.
Two sets link when 100 * intersection >= percent * union.

odd holds the parity of how many hashes fall into each of a power of two of places (an odd sketch). A hash that is
in one of two sets only changes one bit, so that two sets differ in at least as many hashes as their sketches differ
in bits: a suffix filter, which rejects pairs without a look at their hashes and lets few others pass.

First come star rounds: a few tokens of each set, those with the least hash, form groups, and in each group one pivot
is picked, the set with the fewest hashes that no other set has, which lies in the middle of a group of changed
copies; in later rounds a fixed number of them, by a seeded hash. Each set with another label is paired with the pivot
whose sketch is nearest, and takes its label if the filter lets the pair pass. That is one pair for a set and a round, however large the groups.
These pairs are verified at once, by their hashes, and their components taken. Last, the pairs of all tokens that are
in different components still and pass the filters are verified. A pair within one component cannot change the
components any more, so no link that matters is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import U
from .components import connected_components
from .staging import Staging

STAR_TOKENS = 8
PIVOTS = 4  # of a group in each round but the first


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """The parities of distinct hashes by their low bits, in a power of two of words: two to four bits for each hash."""
    words = 1 << max(0, int(np.ceil(np.log2(max(1, 2 * len(hashes)) / 64))))
    odd = np.bincount((hashes & U(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _needed(a: str, b: str, percent: int) -> Column:
    """The least intersection of two sets of sizes a and b that link."""
    return F.ceil(F.lit(percent) * (F.col(a) + F.col(b)) / (100 + percent) - 1e-9)


def _apart(a: str, b: str) -> Column:
    """In how many bits the sketches of sets a and b differ. The longer sketch is folded to the length of the other;
    sizes that may link are too near for more than one fold."""
    x, y = F.col(f"{a}_odd"), F.col(f"{b}_odd")
    short, long = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    n = F.size(short)
    folded = F.when(F.size(long) == n, long).otherwise(F.zip_with(F.slice(long, 1, n), F.slice(long, n + 1, n), lambda p, q: p.bitwiseXOR(q)))
    return F.aggregate(F.zip_with(short, folded, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def _room(a: str, b: str, percent: int) -> Column:
    """The most hashes that sets a and b that link may differ in."""
    return F.col(f"{a}_n") + F.col(f"{b}_n") - 2 * _needed(f"{a}_n", f"{b}_n", percent)


def sketched(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ..) whose sketches let them link, the intersection that they need, and in how many bits the
    sketches differ."""
    left, right = (members.select(F.col("id").alias(s), F.col("n").alias(f"{s}_n"), F.col("odd").alias(f"{s}_odd")) for s in "ab")
    met = pairs.join(right, "b").join(left, "a").withColumn("apart", _apart("a", "b"))
    return met.where(F.col("apart") <= _room("a", "b", percent)).select(*pairs.columns, _needed("a_n", "b_n", percent).alias("need"), "apart")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, need) with linked: whether the sets share so many hashes."""
    one = sets.dropDuplicates(["id"])  # sets with one id are equal
    near = pairs.join(one.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")
    near = near.join(one.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a")
    return near.select("a", "b", (F.size(F.array_intersect("ha", "hb")) >= F.col("need")).alias("linked"))


def set_components(members: DataFrame, sets: DataFrame, staging: Staging, percent: int = 80, positional: bool = True, rounds: int = 3) -> DataFrame:
    """(id, component) for each member that links with another; component is a member's id.

    positional: tokens are the rare-first prefix of a set, pos their places in that order. Then a pair is only
    made where the token lies in the shorter set's index prefix, and where as much is left behind it in both
    sets as a link needs.
    """
    by_hash = F.array_sort(F.transform("toks", lambda t: F.struct(F.xxhash64(t["tok"]).alias("h"), t["tok"].alias("tok"))))
    few = staging.save(members.select("id", "n", (F.col("n") - F.col("m")).alias("own"), F.explode(F.slice(by_hash, 1, STAR_TOKENS)).alias("t")).select("id", "n", "own", "t.tok"), "few")
    pairs: DataFrame | None = None
    labels: DataFrame | None = None  # (id, label): sets with one label pass for connected; one without is its own
    kept: list[DataFrame] = [few]

    def labelled(df: DataFrame) -> DataFrame:
        return df.withColumn("c", F.col("id")) if labels is None else df.join(labels, "id", "left").withColumn("c", F.coalesce("label", "id")).drop("label")

    for r in range(rounds):
        here = labelled(few)
        # the set with the fewest hashes of its own lies nearest to what its group has in common
        order = [F.struct("own", "id", "n", "c")] if r == 0 else [F.struct(F.xxhash64("id", F.lit(PIVOTS * r + k)).alias("h"), "id", "n", "c") for k in range(PIVOTS)]
        pivots = here.groupBy("tok").agg(*(F.min(o).alias(f"v{k}") for k, o in enumerate(order)), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
        pivots = pivots.select("tok", F.explode(F.array_distinct(F.array(*(F.struct(f"v{k}.id", f"v{k}.n", f"v{k}.c") for k in range(len(order)))))).alias("v"))
        pivots = pivots.select("tok", *(F.col(f"v.{c}").alias(f"p_{c}") for c in ("id", "n", "c")))
        met = here.join(pivots, "tok").where((F.col("c") != F.col("p_c")) & (100 * F.least("n", "p_n") >= percent * F.greatest("n", "p_n")))
        met = sketched(met.select(F.col("id").alias("a"), F.col("p_id").alias("b"), "p_c").distinct(), members, percent)
        best = met.groupBy("a").agg(F.min(F.struct("apart", "b", "p_c", "need")).alias("v")).select("a", "v.b", "v.p_c", "v.need")
        found = staging.save(best if pairs is None else best.join(pairs, ["a", "b"], "left_anti"), "tried")
        kept.append(found)
        pairs = found.drop("p_c") if pairs is None else pairs.unionByName(found.drop("p_c"))
        new = found.select(F.col("a").alias("id"), F.col("p_c").alias("label"))
        every = new if labels is None else labels.unionByName(new.join(labels.select("id"), "id", "left_anti"))
        up = every.select(F.col("id").alias("label"), F.col("label").alias("up"))
        labels = staging.save(every.join(up, "label", "left").select("id", F.coalesce("up", "label").alias("label")), "labels")
        kept.append(labels)
    assert pairs is not None
    checked = staging.save(verify(pairs, sets), "checked")
    links = checked.where("linked").select("a", "b")
    comps = staging.save(connected_components(links, staging), "components")
    labels = comps.withColumnRenamed("component", "label")

    posts = labelled(members.select("id", "n", "m", "toks")).select("id", "n", "m", "c", F.explode("toks").alias("t")).select("t.tok", "t.pos", "id", "n", "m", "c")
    mixed = posts.groupBy("tok").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("tok")
    open_ = posts.join(mixed, "tok", "left_semi").join(members.select("id", "odd"), "id")
    open_ = staging.save(open_.select("tok", "pos", "id", "n", "m", "c", "odd"), "open")
    p, q = (open_.select("tok", *(F.col(c).alias(f"{side}_{c}") for c in open_.columns if c != "tok")) for side in "pq")
    ok = (F.col("p_id") < F.col("q_id")) & (F.col("p_c") != F.col("q_c")) & (100 * F.least("p_n", "q_n") >= percent * F.greatest("p_n", "q_n"))
    ok &= F.least("p_m", "q_m") >= _needed("p_n", "q_n", percent)
    if positional:
        n, pos = F.when(F.col("p_n") <= F.col("q_n"), F.col("p_n")).otherwise(F.col("q_n")), F.when(F.col("p_n") <= F.col("q_n"), F.col("p_pos")).otherwise(F.col("q_pos"))
        ok &= pos <= n - F.ceil(F.lit(2 * percent) * n / (100 + percent) - 1e-9)
        ok &= F.least(F.col("p_n") - F.col("p_pos"), F.col("q_n") - F.col("q_pos")) >= _needed("p_n", "q_n", percent)
    rest = p.join(q, "tok").where(ok & (_apart("p", "q") <= _room("p", "q", percent))).select(F.col("p_id").alias("a"), F.col("q_id").alias("b"), _needed("p_n", "q_n", percent).alias("need")).distinct()
    failed = checked.where("NOT linked").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = staging.save(verify(rest.join(failed, ["a", "b"], "left_anti"), sets), "found")
    kept.append(found)
    found = found.where("linked").select("a", "b")
    if found.limit(1).count():
        comps = staging.save(connected_components(links.unionByName(found), staging), "components")
    staging.drop(*kept, checked, open_)
    return comps
