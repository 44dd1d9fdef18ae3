"""Mixing sources to target weights: a token budget divided down a tree of domains, languages and sources.

Everything is DataFrame expressions. Each node's weight splits its parent's budget. A node that holds fewer
tokens than its share (times the most epochs) gives the rest to its siblings first, by their weights; only what
a whole family cannot take goes to the siblings of its parent. A leaf's share becomes whole epochs and the
prefix of one more epoch, whose order is a seeded hash of the documents.

A prefix is found without sorting a leaf: its documents are summed in 256 ranges of the hash, the range that the
budget ends in again in 256, and only the documents of that last range are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import set_aside
from .staging import Staging

LEVELS = ("domain", "lang", "source")
SMALL_LEAVES = 50_000  # leaves up to which their cutoffs are broadcast; more are joined by a shuffle


def token_count(text_col: str = "text") -> Column:
    """Runs without white space."""
    words = F.split(F.trim(F.translate(F.coalesce(F.col(text_col), F.lit("")), "\t\n\x0b\x0c\r", "     ")), " +")
    return F.when(F.get(words, F.lit(0)) == "", 0).otherwise(F.size(words)).cast("long")


def order_key(doc_id: Column, seed: Column | int) -> Column:
    """A document's place in an epoch: 60 bits of the MD5 of seed and id, the same in any SQL engine."""
    name = F.concat_ws(":", (seed if isinstance(seed, Column) else F.lit(seed)).cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def divide(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes has the columns parent, budget (of the parent), weight and capacity; adds share.

    Siblings in order of capacity by weight: one is filled if its capacity is no more than its part, by weight,
    of what those before it have left. All others split the rest by their weights. Shares are whole tokens.
    """
    before = W.partitionBy(*parent).orderBy((F.col("capacity") / F.col("weight")), *[c for c in LEVELS if c in nodes.columns]).rowsBetween(W.unboundedPreceding, -1)
    after = before.rowsBetween(0, W.unboundedFollowing)
    out = nodes.withColumn("__left", F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("__weights", F.sum("weight").over(after))
    out = out.withColumn("__part", F.floor(F.col("__left") * F.col("weight") / F.col("__weights")))
    full = F.col("capacity") <= F.col("__part")
    out = out.withColumn("__full", F.sum(F.when(full, 0).otherwise(1)).over(before.rowsBetween(W.unboundedPreceding, 0)) == 0)
    out = out.withColumn("__rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("capacity"))).over(before.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit(0)))
    out = out.withColumn("__open", F.sum(F.when(~F.col("__full"), F.col("weight"))).over(before.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    share = F.when(F.col("__full"), F.col("capacity")).otherwise(F.least(F.col("capacity"), F.floor(F.col("__rest") * F.col("weight") / F.col("__open"))))
    return out.withColumn("share", share.cast("long")).drop("__left", "__weights", "__part", "__full", "__rest", "__open")


def leaf_shares(leaves: DataFrame, budget: Column, epochs: int, weights: list[dict[str, int]]) -> DataFrame:
    """leaves has LEVELS and tokens; adds share. weights: for each level, of its names; a name that is not listed
    has weight 1."""
    def weight(level: int) -> Column:
        named = weights[level]
        out = F.lit(1)
        for name, w in named.items():
            out = F.when(F.col(LEVELS[level]) == name, F.lit(w)).otherwise(out)
        return out

    capacity = (F.sum("tokens") * epochs).alias("capacity")
    top = leaves.groupBy("domain").agg(capacity).withColumn("weight", weight(0)).withColumn("__root", F.lit(1))
    total = top.groupBy("__root").agg(F.sum("capacity").alias("__all"))
    top = top.join(total, "__root").withColumn("budget", F.least(budget, F.col("__all")).cast("long")).drop("__all")
    top = divide(top, ["__root"]).select("domain", F.col("share").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg(capacity).join(top, "domain").withColumn("weight", weight(1))
    langs = divide(langs, ["domain"]).select("domain", "lang", F.col("share").alias("budget"))
    sources = leaves.withColumn("capacity", F.col("tokens") * epochs).join(langs, ["domain", "lang"]).withColumn("weight", weight(2))
    return divide(sources, ["domain", "lang"]).drop("budget", "capacity", "weight")


def mix_sources(docs: DataFrame, budget_share: float = 0.5, budget: int | None = None, epochs: int = 2, weights: list[dict[str, int]] | None = None, domain: Column | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all by default) of the selected rows of docs, their domain, n_tokens and copies (how many
    epochs hold the row).

    budget: tokens to select; budget_share of all tokens where it is None. The selected prefix of an epoch is the
    longest that does not exceed the leaf's share, so a leaf falls short by less than a document. Rows with the
    same place in an epoch (repeated rows) are taken together or not at all. Null languages, sources and domains
    are leaves named "null". Rows without tokens are selected with the first range that is, at no cost. Columns
    named domain, n_tokens or copies are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    staging = Staging(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("domain", "n_tokens", "copies")]
    docs, keep, back = set_aside(docs, keep)
    name = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    own = {"__domain": name(F.lit("all") if domain is None else domain), "__lang": name(F.col(lang_col)), "__source": name(F.col(source_col)), "__tokens": token_count(text_col), "__id": F.col(f"`{id_col}`")}
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), *(c.alias(n) for n, c in own.items()))
    thin = staging.save(rows.select(F.col("__id").alias("id"), F.col("__domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"), F.col("__tokens").alias("tokens")), "tokens")
    levels = list(LEVELS)
    leaves = thin.groupBy(*levels).agg(F.sum("tokens").alias("tokens"))
    if budget is None:
        budget = int((thin.agg(F.sum("tokens")).first()[0] or 0) * budget_share)
    shares = leaf_shares(leaves, F.lit(budget), epochs, weights or [{}, {}, {}])
    # whole: epochs that are taken whole; part: tokens of the prefix of the next one
    shares = shares.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("share") / F.col("tokens"))).otherwise(0).cast("int")).withColumn("part", F.col("share") - F.col("whole") * F.col("tokens"))
    shares = staging.save(shares.select(*levels, "whole", "part"), "shares")
    small = shares.count() <= SMALL_LEAVES
    bounded = F.broadcast if small else (lambda df: df)

    here = thin.join(bounded(shares), levels).withColumn("place", order_key(F.col("id"), F.lit(seed) + F.col("whole")))
    low = shares.select(*levels, "whole", F.col("part").alias("left"), F.lit(0).cast("long").alias("from"))
    for bits in (52, 44):  # the range that the budget ends in, of 256 and again of 256
        inside = here.select(*levels, "place", "tokens").join(bounded(low), levels)
        inside = inside if bits == 52 else inside.where(F.shiftright("place", bits + 8) == F.shiftright("from", bits + 8))
        ranges = inside.groupBy(*levels, "left", "from", "whole", F.shiftright("place", bits).alias("range")).agg(F.sum("tokens").alias("tokens"))
        upto = W.partitionBy(*levels).orderBy("range").rowsBetween(W.unboundedPreceding, 0)
        ranges = ranges.withColumn("sum", F.sum("tokens").over(upto))
        ends = ranges.where(F.col("sum") > F.col("left")).groupBy(*levels, "left", "whole").agg(F.min(F.struct("range", "sum", "tokens")).alias("end"))
        # a leaf whose ranges all fit is taken to its end
        low = low.drop("left", "whole", "from").join(ends, levels, "left").join(shares.select(*levels, F.col("whole").alias("w")), levels)
        low = low.select(*levels, F.col("w").alias("whole"), F.when(F.col("end").isNotNull(), F.col("left") - (F.col("end.sum") - F.col("end.tokens"))).alias("left"), F.coalesce(F.shiftleft(F.col("end.range"), bits), F.lit((1 << 60))).alias("from"))
        low = staging.save(low, "ranges")
    last = here.select(*levels, "place", "tokens").join(bounded(low.where("left is not null")), levels).where(F.shiftright("place", 44) == F.shiftright("from", 44))
    places = last.groupBy(*levels, "place", "left").agg(F.sum("tokens").alias("tokens"))
    places = places.withColumn("sum", F.sum("tokens").over(W.partitionBy(*levels).orderBy("place").rowsBetween(W.unboundedPreceding, 0)))
    fits = places.where(F.col("sum") <= F.col("left")).groupBy(*levels).agg(F.max("place").alias("upto"))
    cut = low.join(fits, levels, "left").select(*levels, "whole", F.coalesce("upto", F.col("from") - 1).alias("upto"))
    cut = staging.save(cut.select(F.col("domain").alias("__domain"), F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.col("whole").alias("__whole"), F.col("upto").alias("__upto")), "cuts")

    chosen = rows.join(bounded(cut), ["__domain", "__lang", "__source"])
    copies = F.col("__whole") + (order_key(F.col("__id"), F.lit(seed) + F.col("__whole")) <= F.col("__upto")).cast("int")
    chosen = chosen.withColumn("copies", copies).where(F.col("copies") > 0)
    return back(chosen.select(*(F.col(f"`{c}`") for c in keep), F.col("__domain").alias("domain"), F.col("__tokens").alias("n_tokens"), "copies"))
