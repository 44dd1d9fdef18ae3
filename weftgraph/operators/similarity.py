"""Text similarity of terms, labels of graph nodes, and joins of generated texts with graph terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import save
from ..sources.graph import Graph
from ..sources.terms import LABEL_PROPERTIES, LITERAL
from .patterns import Solutions, join, product, shared, split_by, union
from .vectors import BLOCK, VectorIndex, build_index, search

DEFAULT_THETA = 0.85
SHORT = 24  # words of a text that meets others by sets of words
_TRIM = r"^[\x00-\x20]+|[\x00-\x20]+\z"


def normal(text: Column) -> Column:
    """Lower case, without control characters and blanks at the ends."""
    return F.regexp_replace(F.lower(text), _TRIM, "")


def word_set(text: Column) -> Column:
    return F.array_distinct(F.split(normal(text), r"[ \t\n\x0B\f\r]+"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words by all words; equal texts, also two null ones, are 1."""
    x, y = word_set(a), word_set(b)
    return F.when(a.eqNullSafe(b), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def levenshtein(a: Column, b: Column) -> Column:
    """1 if equal, 0.98 if equal after normal(), else one less the edit distance by the longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when(normal(a) == normal(b), 0.98).otherwise(1 - F.levenshtein(a, b) / longer)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, within 0 and 1; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(0.0)


def canonical(term: Column) -> Column:
    """A text for a term without a label: a literal's form, a blank node's label, or an IRI's last part, decoded, and
    without the id of names such as m_id__label, m_id_label and concept_label. An IRI that ends in / or # is its own."""
    last = F.regexp_extract(term["lex"], r"([^#/]*)$", 1)
    named = F.when(last.rlike("^m_.*?__.+$"), F.regexp_extract(last, "^m_.*?__(.+)$", 1)).when(last.rlike("^m_[^_]*_.+$"), F.regexp_extract(last, "^m_[^_]*_(.+)$", 1))
    last = F.coalesce(named, F.regexp_replace(last, "^concept_", ""))
    words = F.regexp_replace(F.url_decode(F.replace(F.regexp_replace(last, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))), "[_\\-]+", " ")
    return F.when((term["kind"] == 0) & term["lex"].rlike("[#/]$"), term["lex"]).when(term["kind"] == 0, F.trim(F.regexp_replace(words, r"\s+", " "))).otherwise(term["lex"])


def labels(graph: Graph) -> DataFrame:
    """(term, label): all labels of a node by the first label property that it has as a literal."""
    found = [graph.parts[p].where("s.kind = 0 AND o.kind = 2").select(F.col("s").alias("term"), F.col("o.lex").alias("label"), F.lit(k).alias("rank")) for k, p in enumerate(LABEL_PROPERTIES) if p in graph.parts]
    if not found:
        return graph.triples([]).select(F.col("s").alias("term"), F.lit("").alias("label"))
    if len(found) == 1:
        return found[0].select("term", "label").distinct()
    rows = reduce(DataFrame.unionByName, found)
    first = rows.groupBy("term").agg(F.min("rank").alias("rank"))
    return rows.join(first, ["term", "rank"]).select("term", "label").distinct()


def texts_of(terms: DataFrame, label_table: DataFrame) -> DataFrame:
    """(term, label) of distinct terms: labels, or the canonical text; literals their form."""
    named = terms.join(label_table, "term", "left")
    return named.select("term", F.when(F.col("term.kind") == LITERAL, F.col("term.lex")).otherwise(F.coalesce("label", canonical(F.col("term")))).alias("label"))


def _needed(n: Column, m: Column, theta: float) -> Column:
    """How many words two sets of n and m words must share."""
    return F.ceil(F.lit(theta) / (1 + theta) * (n + m) - 1e-9).cast("int")


def _meetings(a: DataFrame, b: DataFrame, theta: float) -> DataFrame:
    """Texts of a and b that meet by words or sets of words (see matching_texts), before any filter of pairs."""
    words_a, words_b = a.withColumn("w", word_set(F.col("a"))), b.withColumn("w", word_set(F.col("b")))
    counts = words_b.select(F.explode("w").alias("t")).groupBy("t").agg(F.count("*").alias("n_texts"))

    def ranked(rows: DataFrame, name: str) -> DataFrame:
        each = rows.select(name, F.explode("w").alias("t")).join(counts, "t", "left")
        sets = each.groupBy(name).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n_texts", F.lit(0)).alias("n"), "t"))).alias("w"))
        return sets.select(name, F.col("w.t").alias("w"), F.size("w").alias("n"))

    def keyed(rows: DataFrame, lengths: DataFrame, name: str, other: str) -> DataFrame:
        """A row for each length m of the other side, up to SHORT (0: all longer pairs), and each set of words."""
        n, m = F.col("n"), F.col("m")
        may = (m == 0) & (n / theta > SHORT) | (F.greatest(n, m) <= SHORT) & (m >= F.lit(theta) * n - 1e-9) & (n >= F.lit(theta) * m - 1e-9)
        rows = rows.join(F.broadcast(lengths), may)
        o = F.when(m == 0, F.ceil(F.lit(theta) * n - 1e-9).cast("int")).otherwise(_needed(n, m, theta))
        spare = F.greatest(n, m) - o
        size = F.when(m == 0, 1).otherwise(F.least(o, F.when(spare <= 2, 4).when(spare == 3, 3).when(spare <= 5, 2).otherwise(1)))
        rows = rows.withColumn("size", size).withColumn("p", F.slice("w", F.lit(1), F.greatest(F.lit(0), n - o + F.col("size"))))
        grown = lambda sets, t: F.concat(sets, F.transform(F.filter(sets, lambda x: F.size(x) < F.col("size")), lambda x: F.concat(x, F.array(t))))
        sets = F.filter(F.aggregate("p", F.array(F.array().cast("array<string>")), grown), lambda x: F.size(x) == F.col("size"))
        one = F.transform("p", lambda t: F.array(t))
        keys = F.when(F.col("size") == 1, one).otherwise(sets)
        return rows.select(name, F.col("w").alias(f"w_{name}"), n.alias(f"n_{name}"), F.col("p").alias(f"p_{name}"), "size", F.when(m == 0, 0).otherwise(n).alias(f"m_{name}"), m.alias(f"m_{other}"), F.explode(keys).alias("t"))

    lengths_of = lambda words: words.select(F.size("w").alias("m")).where(F.col("m") <= SHORT).distinct().unionByName(words.sparkSession.range(1).select(F.lit(0).alias("m")))
    return keyed(ranked(words_a, "a"), lengths_of(words_b), "a", "b").join(keyed(ranked(words_b, "b"), lengths_of(words_a), "b", "a").drop("size"), ["t", "m_a", "m_b"])


def matching_texts(left: DataFrame, right: DataFrame, theta: float) -> DataFrame:
    """(a, b, similarity) of texts of left (a) and right (b) with a word-set Jaccard of theta or more.

    Words are ranked by how many texts of right hold them, rarest first. If two texts of n and m words must share o of
    them, the first n - o + l words of the one and the first m - o + l of the other have l in common at least. Texts meet
    by sets of l words, each length with each that it can match, so that words which many texts hold, but in few of the
    same sets, make few pairs. Texts of more than SHORT words meet by one word. theta of 0 matches all pairs.
    """
    a = left.select("a").where("a IS NOT NULL").distinct()
    b = right.select("b").where("b IS NOT NULL").distinct()
    if theta <= 0:
        pairs = product(Solutions(a), Solutions(b)).df
        return pairs.withColumn("similarity", jaccard(F.col("a"), F.col("b")))
    near = _meetings(a, b, theta)
    longest = F.greatest("n_a", "n_b")
    near = near.where((F.col("n_a") >= F.lit(theta) * F.col("n_b") - 1e-9) & (F.col("n_b") >= F.lit(theta) * F.col("n_a") - 1e-9) & ((F.col("m_a") > 0) | (longest > SHORT)))
    # a pair is made once, at the first words that both prefixes have
    near = near.where(F.slice(F.array_intersect("p_a", "p_b"), F.lit(1), F.col("size")) == F.col("t"))
    # a single word must leave enough words in both texts
    left_of = lambda c: F.col(f"n_{c}") - F.array_position(f"p_{c}", F.get("t", F.lit(0))) + 1
    near = near.where((F.col("size") > 1) | (F.least(left_of("a"), left_of("b")) >= _needed(F.col("n_a"), F.col("n_b"), theta)))
    both = F.size(F.array_intersect("w_a", "w_b"))
    return near.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(both / (F.col("n_a") + F.col("n_b") - both)).alias("similarity")).where(F.col("similarity") >= theta)


def text_matches(left: DataFrame, right: DataFrame, theta: float, measure: str = "words", vectors: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity, reason) of texts of left (a) and right (b) that are similar by a measure: words (Jaccard of word
    sets), edit (edit distance), or vectors: the cosine of vectors (text, v), 1 for equal texts, and words where one of
    the texts has no vector. reason is the measure that a pair was compared by."""
    if measure == "words":
        return matching_texts(left, right, theta).withColumn("reason", F.lit("words"))
    if measure == "edit":
        from .edits import edit_matches

        return edit_matches(left, right, theta).withColumn("reason", F.lit("edit"))
    if measure != "vectors" or vectors is None:
        raise ValueError("measures are words, edit, and vectors with a table of them")
    a, b = (rows.select(c).where(f"{c} IS NOT NULL").distinct() for rows, c in ((left, "a"), (right, "b")))
    has = vectors.where("v IS NOT NULL").dropDuplicates(["text"])
    with_a, with_b = (rows.join(has.withColumnRenamed("text", c), c) for rows, c in ((a, "a"), (b, "b")))
    without_a, without_b = (rows.join(has.select(F.col("text").alias(c)), c, "left_anti") for rows, c in ((a, "a"), (b, "b")))
    equal = a.join(b, F.col("a") == F.col("b")).select("a", "b", F.lit(1.0).alias("similarity"), F.lit("equal").alias("reason"))
    near = search(with_a.select(F.col("a").alias("q"), "v"), build_index(with_b.select(F.col("b").alias("id"), "v")), None, theta).select(F.col("q").alias("a"), F.col("id").alias("b"), "similarity", F.lit("vectors").alias("reason"))
    words = matching_texts(without_a, b, theta).unionByName(matching_texts(with_a.select("a"), without_b, theta)).withColumn("reason", F.lit("words"))
    return equal.unionByName(near.unionByName(words).where("a <> b"))


def term_matches(generated: DataFrame, terms: DataFrame, label_table: DataFrame, theta: float, measure: str = "words", vectors: DataFrame | None = None) -> DataFrame:
    """(value, term, similarity): generated texts (value) and terms of which a label is similar enough; the most
    similar label counts."""
    named = texts_of(terms.select("term").distinct(), label_table)
    pairs = text_matches(generated.select(F.col("value").alias("a")), named.select(F.col("label").alias("b")), theta, measure, vectors)
    found = pairs.join(named.select("term", F.col("label").alias("b")), "b")
    return found.groupBy(F.col("a").alias("value"), "term").agg(F.max("similarity").alias("similarity"))


def _compatible(pattern: Solutions, made: Solutions, v: str, label_table: DataFrame, theta: float, measure: str, vectors: DataFrame | None) -> DataFrame:
    """(p, m): terms of both sides for a variable that at least one of them generates, where they agree: a generated
    literal by its similarity with a generated one, or with a label of another term; all others are the same term."""
    mine, theirs = (x.df.select(F.col(v).alias(c)).where(F.col(c).isNotNull()).distinct() for x, c in ((pattern, "p"), (made, "m")))
    split = lambda rows, c, of: (rows.where(F.col(f"{c}.kind") == LITERAL), rows.where(F.col(f"{c}.kind") != LITERAL)) if v in of.generated else (rows.limit(0), rows)
    (p_made, p_other), (m_made, m_other) = split(mine, "p", pattern), split(theirs, "m", made)
    parts = [p_other.join(m_other, F.col("p") == F.col("m"))]
    values = lambda rows, c: rows.select(F.col(f"{c}.lex").alias("value")).distinct()
    if v in made.generated:
        found = term_matches(values(m_made, "m"), p_other.select(F.col("p").alias("term")), label_table, theta, measure, vectors).select("value", F.col("term").alias("p"))
        parts.append(m_made.withColumn("value", F.col("m.lex")).join(found, "value").select("p", "m"))
    if v in pattern.generated:
        found = term_matches(values(p_made, "p"), m_other.select(F.col("m").alias("term")), label_table, theta, measure, vectors).select("value", F.col("term").alias("m"))
        parts.append(p_made.withColumn("value", F.col("p.lex")).join(found, "value").select("p", "m"))
    if v in made.generated and v in pattern.generated:
        pairs = text_matches(values(p_made, "p").toDF("a"), values(m_made, "m").toDF("b"), theta, measure, vectors).select("a", "b")
        parts.append(p_made.withColumn("a", F.col("p.lex")).join(pairs, "a").join(m_made.withColumn("b", F.col("m.lex")), "b").select("p", "m"))
    return reduce(DataFrame.unionByName, parts).distinct()


def similarity_join(pattern: Solutions, made: Solutions, graph: Graph, theta: float = DEFAULT_THETA, measure: str = "words", vectors: DataFrame | None = None) -> Solutions:
    """Solutions of a pattern that agree with solutions of a generative one on all variables that both bind; merged rows
    keep the graph's terms, and the pattern's of two generated ones.

    Variables that either side holds as generated literals are compared by similarity (see text_matches), others by
    equality. With several of them different combinations of their terms are matched first: the variable that the fewest
    pairs of combinations agree on gives the candidates, which the others then verify. Rows are joined by those that agree.
    """
    similar_ones = [x for x in shared(pattern, made) if x in made.generated | pattern.generated]
    open_ = next((v for v in similar_ones if v in pattern.maybe or v in made.maybe), None)
    if open_ is not None:  # unbound on one side: that side's rows agree with all
        (p1, p0), (m1, m0) = split_by(pattern, open_), split_by(made, open_)
        parts = [similarity_join(x, y, graph, theta, measure, vectors) for x, y in ((p1, m1), (p0, m1), (p1, m0), (p0, m0)) if x is not None and y is not None]
        return reduce(union, parts)
    if not similar_ones:
        return join(pattern, made)
    label_table = labels(graph)
    agree = {v: save(_compatible(pattern, made, v, label_table, theta, measure, vectors), "agree") for v in similar_ones}
    # different combinations of the terms on each side, then rows by combinations: rows meet only where all variables agree
    mine, theirs = (x.df.select(*similar_ones).distinct() for x in (pattern, made))
    theirs = theirs.withColumnsRenamed({v: f"__{v}" for v in similar_ones})
    if len(similar_ones) > 1:
        def pairs_of(v: str) -> int:
            p, m = (rows.groupBy(F.col(x).alias(c)).agg(F.count("*").cast("decimal(38,0)").alias(f"n_{c}")) for rows, x, c in ((mine, v, "p"), (theirs, f"__{v}", "m")))
            return agree[v].join(p, "p").join(m, "m").agg(F.coalesce(F.sum(F.col("n_p") * F.col("n_m")), F.lit(0))).first()[0]

        similar_ones.sort(key=pairs_of)
    first, rest = similar_ones[0], similar_ones[1:]
    combos = theirs.join(agree[first].select(F.col("p").alias(first), F.col("m").alias(f"__{first}")), f"__{first}")
    if rest:
        combos = combos.join(mine, first)
        for v in rest:
            combos = combos.join(agree[v].select(F.col("p").alias(v), F.col("m").alias(f"__{v}")), [v, f"__{v}"], "left_semi")
        combos = save(combos, "combos")
    theirs = made.df.withColumnsRenamed({v: f"__{v}" for v in similar_ones}).join(combos, [f"__{v}" for v in similar_ones])
    met = join(pattern, Solutions(theirs, made.maybe, made.generated - set(similar_ones), made.thetas))
    df = met.df
    from_made = [v for v in similar_ones if v in pattern.generated and v not in made.generated]
    out = df.select(*(F.coalesce(f"__{v}", v).alias(v) if v in from_made else F.col(v) for v in [*pattern.variables, *(x for x in made.variables if x not in pattern.variables)]))
    both = {v for v in similar_ones if v in pattern.generated and v in made.generated}
    mapped = set(similar_ones) - both
    return Solutions(out, frozenset(v for v in met.maybe if v in out.columns), frozenset((pattern.generated | made.generated) & set(out.columns)) - mapped, {**made.thetas, **pattern.thetas})


def similar(a: Solutions, x: str, y: Column, theta: float | None = None) -> Column:
    """= in a filter for a generated variable: similarity of texts where it is a literal, equality where it was
    mapped to a term; an unbound side is an error."""
    v = F.col(x.lstrip("?"))
    limit = a.thetas.get(x.lstrip("?"), DEFAULT_THETA) if theta is None else theta
    return F.when(v.isNull() | y.isNull(), F.lit(None)).when(v["kind"] == LITERAL, jaccard(v["lex"], y["lex"]) >= limit).otherwise(v == y)


def nearest(queries: DataFrame, index: DataFrame | VectorIndex, k: int | None = 1, theta: float = 0.0, block: int = BLOCK) -> DataFrame:
    """(q, id, similarity): the k nearest vectors of an index, or of a table (id, v) that an index is built of, by cosine of
    each of queries (q, v), if at least theta; ties go to the smaller id. k of None takes all that reach theta."""
    return search(queries, build_index(index, block=block) if isinstance(index, DataFrame) else index, k, theta, block)
