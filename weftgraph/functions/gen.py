"""Functions for generated texts. Those that a model answers take a provider and a DataFrame of inputs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.generate import Options, ask_model
from ..operators.similarity import jaccard
from ..sources.terms import XSD, literal


def approx_equal(a: Column, b: Column, theta: float) -> Column:
    return jaccard(a, b) >= theta


def token_cost(prompt: Column) -> Column:
    """A rough number of tokens: the mean of a quarter of the characters and 1.3 times the words, rounded up each."""
    text = F.trim(prompt)
    words = F.when(text == "", 0).otherwise(F.size(F.split(text, r"\s+")))
    return F.floor((F.ceil(F.length(prompt) / 4) + F.ceil(words * 1.3)) / 2).cast("int")


def parse_json(raw: Column, path: str) -> Column:
    """The value at a path such as a.b[0] as text; empty where there is none."""
    return F.coalesce(F.get_json_object(raw, path if path.startswith("$") else f"$.{path}"), F.lit(""))


def parse_json_term(raw: Column, path: str) -> Column:
    """The value at a path such as a.b[0] as a term of its type: an integer, a double, a boolean or a string; objects and
    arrays as strings of JSON; an empty string where there is none or the text is no JSON. Reads the text once, as a
    variant."""
    found = F.try_variant_get(F.try_parse_json(raw), path if path.startswith("$") else f"$.{path}", "variant")
    kind = F.schema_of_variant(found)
    as_type = lambda t: F.try_variant_get(found, "$", t)
    return (
        F.when(found.isNull() | F.is_variant_null(found), literal(F.lit("")))
        .when(kind == "BIGINT", literal(as_type("bigint"), XSD + "integer"))
        .when(kind.startswith("DECIMAL") & kind.endswith(",0)"), literal(as_type("decimal(38,0)"), XSD + "integer"))
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), literal(as_type("double"), XSD + "double"))
        .when(kind == "BOOLEAN", literal(as_type("boolean"), XSD + "boolean"))
        .when(kind == "STRING", literal(as_type("string")))
        .otherwise(literal(F.to_json(found)))
    )


def embedding_text(vector: Column) -> Column:
    """Components with six decimals, rounded by their exact binary values, so that a tie goes to the even digit (Java's
    format rounds it up). Null components are left out; nothing but such ones is null."""

    @F.arrow_udf("string")
    def text(vectors: pa.Array) -> pa.Array:
        rows = vectors.to_pylist()
        known = ([x for x in v if x is not None] if v else v for v in rows)
        return pa.array([None if v is None or (full and not v) else ",".join(["%.6f" % x for x in v]) for full, v in zip(rows, known, strict=True)], pa.string())

    return text(vector)


def _whole_word(answer: Column, label: str) -> Column:
    return answer.rlike("(?<![a-z0-9_])\\Q" + label.lower() + "\\E(?![a-z0-9_])")


def pick_label(answer: Column, options: list[str]) -> Column:
    """The label that an answer names: exactly, else the longest as whole words, else the longest inside it, else
    the answer in lower case."""
    low = F.lower(F.trim(answer))
    longest = sorted(options, key=lambda o: (-len(o), o))
    out = F.when(low == "", "")
    for o in options:
        out = out.when(low == o.lower(), o)
    for o in longest:
        out = out.when(_whole_word(low, o), o)
    for o in longest:
        out = out.when(low.contains(o.lower()), o)
    return out.otherwise(low)


def judged_valid(answer: Column) -> Column:
    """Whether an answer says that a value is valid; a negative word counts first."""
    low = F.lower(answer)
    return ~low.rlike(r"\b(invalid|not|no|false)\b") & low.rlike(r"\b(valid|yes|true)\b")


def says_entailed(answer: Column) -> Column:
    low = F.lower(answer)
    return low.contains("entailment") | low.contains("yes") | low.contains("true")


def grounded_iri(answer: Column) -> Column:
    """An address as it is, a Q number in Wikidata, any other name in DBpedia; none for NONE or nothing."""
    text = F.trim(answer)
    return (
        F.when((text == "") | (F.upper(text) == "NONE"), F.lit(None))
        .when(text.startswith("http"), text)
        .when(text.rlike(r"^Q\d+$"), F.concat(F.lit("http://www.wikidata.org/entity/"), text))
        .otherwise(F.concat(F.lit("http://dbpedia.org/resource/"), F.replace(text, F.lit(" "), F.lit("_"))))
    )


def answered(df: DataFrame, prompt: Column, provider, out: str = "answer") -> DataFrame:
    """df with the raw answers to prompts; each different prompt is asked once, a failure is an empty text."""
    asked = df.withColumn("__prompt", prompt)
    answers = ask_model(asked.select(F.col("__prompt").alias("prompt")), provider, [out], Options())
    return asked.join(answers.select(F.col("prompt").alias("__prompt"), F.coalesce("raw", F.lit("")).alias(out)), "__prompt", "left").drop("__prompt")


def classify(df: DataFrame, text: Column, options: list[str], provider, out: str = "label") -> DataFrame:
    prompt = F.concat(F.lit(f"Classify the text as one of: {', '.join(options)}. Text: "), text)
    found = answered(df, prompt, provider, "__answer")
    return found.withColumn(out, pick_label(F.col("__answer"), options)).drop("__answer")


def extract(df: DataFrame, text: Column, fields: list[str], provider, out: str = "fields") -> DataFrame:
    prompt = F.concat(F.lit(f"Extract {', '.join(fields)} as a JSON object from: "), text)
    found = answered(df, prompt, provider, "__answer")
    return found.withColumn(out, F.when(F.col("__answer") == "", "{}").otherwise(F.col("__answer"))).drop("__answer")


def entail(df: DataFrame, premise: Column, hypothesis: Column, provider, out: str = "entailed") -> DataFrame:
    prompt = F.concat(F.lit("Does the premise entail the hypothesis? Premise: "), premise, F.lit(" Hypothesis: "), hypothesis)
    return answered(df, prompt, provider, "__answer").withColumn(out, says_entailed(F.col("__answer"))).drop("__answer")


def validate(df: DataFrame, value: Column, schema: str, provider, out: str = "valid") -> DataFrame:
    prompt = F.concat(F.lit(f"Is this value valid for {schema}? Value: "), value)
    return answered(df, prompt, provider, "__answer").withColumn(out, judged_valid(F.col("__answer"))).drop("__answer")


def ground(df: DataFrame, text: Column, provider, out: str = "iri") -> DataFrame:
    prompt = F.concat(F.lit("Name the entity that this text means: "), text)
    return answered(df, prompt, provider, "__answer").withColumn(out, grounded_iri(F.col("__answer"))).drop("__answer")
