"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm, chat, decontaminate, html, line_dedup, mixing, ngram_join, paragraph_dedup, periodic_runs, quality, token_count, toxicity, vector_codes
from .staging import Staging

TOKENIZERS = "/opt/tokenizers"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Production parameters of the mix: a crawl that is a third of the corpus, and curated sources.
MIX = {"budget_share": 0.5, "epochs": 2, "seed": 17, "weights": [{"crawl": 4, "curated": 6}, {"en": 50, "de": 20, "fr": 20, "es": 10}, {}]}


def mix_domain():
    return F.when(F.col("source") == "src0", "crawl").otherwise("curated")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    """Fitted on the labelled documents that are not held out; of more than MAX_TRAINING_ROWS labels on about that
    many, by a hash of doc_id. The labels that are used, a bounded number of pairs, are broadcast, so that no text is
    shuffled to find the labelled ones."""
    labels = table(spark, sf_dir, "labels").where(~held_out()).where("toxic IN (0, 1)").select("doc_id", F.col("toxic").alias("label"))
    n = labels.count()
    if n > toxicity.MAX_TRAINING_ROWS:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * toxicity.MAX_TRAINING_ROWS / n))
    return toxicity.fit(docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontaminate.report(found)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, byte_fallback = token_count.read_vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model")
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary, byte_fallback, keep=["doc_id", "n_chars"])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity_model(spark, docs, sf_dir).score(docs, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), domain=mix_domain(), keep=["doc_id", "lang", "source"], **MIX)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], turns.schema)
    with open(f"{TOKENIZERS}/byte_bpe_50k.json", encoding="utf-8") as f:
        formatted = chat.format_conversations(turns.unionByName(extra), f.read())
    # what is read back from the formatted text: turns between the control strings, and the text under the mask
    between = F.split(F.expr(f"substr(formatted, {len(chat.START) + 1}, length(formatted) - {len(chat.START) + len(chat.END)})"), r"<\|im_end\|><\|im_start\|>", -1)
    plain = lambda x: F.regexp_replace(x, r"<\\(\\*)\|", r"<$1|")
    turn = F.transform(F.when(F.length("formatted") > 0, between).otherwise(F.array().cast("array<string>")), lambda t: F.split(t, r"<\|im_sep\|>", -1))
    read = F.array_join(F.transform(turn, lambda t: F.concat(plain(t[0]), F.lit("\n"), plain(t[1]), F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: plain(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    out = formatted.withColumns({"__read": read, "__loss": loss, "n_turns": F.size(turn).cast("long")})
    return out.select("conv_id", "n_turns", F.sha2("__read", 256).alias("turns_sha256"), F.length("__loss").cast("long").alias("loss_chars"), F.sha2("__loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "n_tokens")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_paragraphs(table(spark, sf_dir, "documents"))


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    staging = Staging(spark)
    model = attention_lm.fit(docs.where(~held), attention_lm.read_ranks(f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"), staging)
    scored = model.score(docs, staging, keep=["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """The texts of documents whose crc32(doc_id) divides by ten, from some word on, repeat the words that follow it."""
    blanks = " \t\n\x0b\x0c\r"
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.split(F.trim("text", F.lit(blanks)), f"[{blanks}]+")
    rows = docs.withColumn("words", F.when(h % 10 == 0, F.filter(words, lambda w: w != ""))).withColumn("g", F.floor(h / 10))
    n = F.size("words")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    changed = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(n > 0, F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse_runs(with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    listed = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.withColumns({"best": best, "listed": F.sha2(F.array_join(listed, ""), 256), "collapsed": F.sha2("collapsed", 256)})
    start, length, period = F.col("best.start"), -F.col("best.less"), F.col("best.period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.col("listed").alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), keep=["vec_id", "label"])
    out = vector_codes.with_label_error(coded, Staging(spark)).drop("label")
    return out.withColumn("codebooks_sha256", F.lit(books.digest() if books else None).cast("string"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_token_counts, op3_toxicity, op4_quality_rules, op5_mixing, op6_chat_format, op7_html_extraction, op8_line_dedup, op9_ngram_jaccard, op10_substring_dedup, op11_lm_scores, op12_periodic_runs, op13_vector_codes)}

ORACLE_SQL = {
    "op1_decontamination": rf"""
WITH bw AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bs AS (SELECT item_id, w, least(10, len(w)) AS size FROM bw WHERE len(w) > 0),
bn AS (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM bs),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS t FROM bn),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dn AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, (SELECT DISTINCT size FROM win) WHERE len(w) >= size),
dt AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS t FROM dn),
hit AS (SELECT DISTINCT dt.doc_id, dt.i, dt.size, win.item_id FROM dt JOIN win ON dt.size = win.size AND dt.t = win.t),
places AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(places.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_mixing": r"""
WITH d AS (SELECT doc_id, lang, source, CASE WHEN source = 'src0' THEN 'crawl' ELSE 'curated' END AS domain,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * 2 AS capacity FROM d GROUP BY ALL),
top0 AS (SELECT domain, sum(capacity) AS capacity, CASE domain WHEN 'crawl' THEN 4 ELSE 6 END AS weight,
  least(CAST(floor((SELECT sum(n_tokens) FROM d) * 0.5) AS BIGINT), (SELECT sum(capacity) FROM leaf)) AS budget FROM leaf GROUP BY domain),
top1 AS (SELECT *, budget - coalesce(sum(capacity) OVER b, 0) AS l, sum(weight) OVER a AS ws FROM top0
  WINDOW b AS (ORDER BY CAST(capacity AS DOUBLE) / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (ORDER BY CAST(capacity AS DOUBLE) / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
top2 AS (SELECT *, sum(CASE WHEN capacity <= floor(CAST(l AS DOUBLE) * weight / ws) THEN 0 ELSE 1 END) OVER (ORDER BY CAST(capacity AS DOUBLE) / weight, domain ROWS UNBOUNDED PRECEDING) = 0 AS f FROM top1),
top3 AS (SELECT *, budget - coalesce(sum(CASE WHEN f THEN capacity END) OVER (), 0) AS r, sum(CASE WHEN NOT f THEN weight END) OVER () AS o FROM top2),
top AS (SELECT domain, CAST(CASE WHEN f THEN capacity ELSE least(capacity, floor(CAST(r AS DOUBLE) * weight / o)) END AS BIGINT) AS budget FROM top3),
lang0 AS (SELECT leaf.domain, lang, sum(capacity) AS capacity, any_value(budget) AS budget, CASE lang WHEN 'en' THEN 50 WHEN 'de' THEN 20 WHEN 'fr' THEN 20 WHEN 'es' THEN 10 ELSE 1 END AS weight FROM leaf JOIN top USING (domain) GROUP BY leaf.domain, lang),
lang1 AS (SELECT *, budget - coalesce(sum(capacity) OVER (PARTITION BY domain ORDER BY CAST(capacity AS DOUBLE) / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
  sum(weight) OVER (PARTITION BY domain ORDER BY CAST(capacity AS DOUBLE) / weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM lang0),
lang2 AS (SELECT *, sum(CASE WHEN capacity <= floor(CAST(l AS DOUBLE) * weight / ws) THEN 0 ELSE 1 END) OVER (PARTITION BY domain ORDER BY CAST(capacity AS DOUBLE) / weight, lang ROWS UNBOUNDED PRECEDING) = 0 AS f FROM lang1),
lang3 AS (SELECT *, budget - coalesce(sum(CASE WHEN f THEN capacity END) OVER (PARTITION BY domain), 0) AS r, sum(CASE WHEN NOT f THEN weight END) OVER (PARTITION BY domain) AS o FROM lang2),
langs AS (SELECT domain, lang, CAST(CASE WHEN f THEN capacity ELSE least(capacity, floor(CAST(r AS DOUBLE) * weight / o)) END AS BIGINT) AS budget FROM lang3),
src0 AS (SELECT leaf.*, budget, 1 AS weight FROM leaf JOIN langs USING (domain, lang)),
src1 AS (SELECT *, budget - coalesce(sum(capacity) OVER (PARTITION BY domain, lang ORDER BY CAST(capacity AS DOUBLE) / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
  sum(weight) OVER (PARTITION BY domain, lang ORDER BY CAST(capacity AS DOUBLE) / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM src0),
src2 AS (SELECT *, sum(CASE WHEN capacity <= floor(CAST(l AS DOUBLE) * weight / ws) THEN 0 ELSE 1 END) OVER (PARTITION BY domain, lang ORDER BY CAST(capacity AS DOUBLE) / weight, source ROWS UNBOUNDED PRECEDING) = 0 AS f FROM src1),
src3 AS (SELECT *, budget - coalesce(sum(CASE WHEN f THEN capacity END) OVER (PARTITION BY domain, lang), 0) AS r, sum(CASE WHEN NOT f THEN weight END) OVER (PARTITION BY domain, lang) AS o FROM src2),
share AS (SELECT domain, lang, source, tokens, CAST(CASE WHEN f THEN capacity ELSE least(capacity, floor(CAST(r AS DOUBLE) * weight / o)) END AS BIGINT) AS share FROM src3),
part AS (SELECT *, CASE WHEN tokens > 0 THEN CAST(share // tokens AS BIGINT) ELSE 0 END AS whole FROM share),
placed AS (SELECT d.*, whole, share - whole * tokens AS part, CAST('0x' || substr(md5(CAST(17 + whole AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS place FROM d JOIN part USING (domain, lang, source)),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE UNBOUNDED PRECEDING) AS s FROM placed)
SELECT doc_id, lang, source, domain, n_tokens, CAST(whole + CASE WHEN s <= part THEN 1 ELSE 0 END AS INTEGER) AS copies FROM summed WHERE whole + CASE WHEN s <= part THEN 1 ELSE 0 END > 0""",
    "op8_line_dedup": rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op13_vector_codes": r"""
WITH kept AS (SELECT vec_id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, p, list_transform(range(len(v) // 16), lambda k: CAST(floor(256 * CAST(v[p * (len(v) // 16) + k + 1] AS DOUBLE)) AS BIGINT)) AS x FROM kept, (SELECT unnest(range(16)) AS p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64),
b0 AS MATERIALIZED (SELECT p, e, x AS c FROM x JOIN first USING (vec_id)),
a0 AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min({'d': d, 'e': e}) AS m FROM (SELECT vec_id, x.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b0 ON x.p = b0.p) GROUP BY vec_id, p),
n1 AS (SELECT p, e, list(s ORDER BY k) AS c FROM (SELECT p, m.e AS e, k, CAST(floor(sum(x[k]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS s FROM a0, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM x))) AS k) GROUP BY p, m.e, k) GROUP BY p, e),
b1 AS MATERIALIZED (SELECT p, e, coalesce(n1.c, b0.c) AS c FROM b0 LEFT JOIN n1 USING (p, e)),
a1 AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min({'d': d, 'e': e}) AS m FROM (SELECT vec_id, x.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b1 ON x.p = b1.p) GROUP BY vec_id, p),
n2 AS (SELECT p, e, list(s ORDER BY k) AS c FROM (SELECT p, m.e AS e, k, CAST(floor(sum(x[k]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS s FROM a1, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM x))) AS k) GROUP BY p, m.e, k) GROUP BY p, e),
b2 AS MATERIALIZED (SELECT p, e, coalesce(n2.c, b1.c) AS c FROM b1 LEFT JOIN n2 USING (p, e)),
a2 AS (SELECT vec_id, p, min({'d': d, 'e': e}) AS m FROM (SELECT vec_id, x.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b2 ON x.p = b2.p) GROUP BY vec_id, p),
coded AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
whole AS (SELECT coded.*, label FROM coded JOIN kept USING (vec_id)),
book AS (SELECT sha256(string_agg(CAST(i AS VARCHAR), ',' ORDER BY p, e, k)) AS s FROM (SELECT p, e, unnest(c) AS i, unnest(range(len(c))) AS k FROM b2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM whole, book""",
}
