"""What a generative step would cost, from counts that Spark makes over its input."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.generate import placeholders, resolved
from ..operators.patterns import Solutions


def call_statistics(sol: Solutions, prompt: str) -> DataFrame:
    """(n_solutions, n_calls): solutions that would be asked about, and different prompts, which are the calls."""
    if not placeholders(prompt):
        return sol.df.agg(F.count("*").alias("n_solutions"), F.least(F.count("*"), F.lit(1)).cast("bigint").alias("n_calls"))
    asked = sol.df.select(resolved(prompt).alias("p")).where("p IS NOT NULL")
    # two steps, so that a frequent prompt is counted before it is shuffled
    return asked.groupBy("p").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_solutions"), F.count("*").alias("n_calls"))


def prompt_tokens(sol: Solutions, prompt: str) -> DataFrame:
    """(n_calls, tokens): different prompts and a quarter of their characters."""
    asked = sol.df.select(resolved(prompt).alias("p")).where("p IS NOT NULL").distinct()
    return asked.agg(F.count("*").alias("n_calls"), F.coalesce(F.sum(F.ceil(F.length("p") / 4)), F.lit(0)).cast("bigint").alias("tokens"))


def survivors(expected_rows: Column, theta: float) -> Column:
    """Rows that a similarity filter is expected to keep."""
    return expected_rows * (1 - 0.8 * theta)


def predicate_statistics(rows: DataFrame) -> DataFrame:
    """(p, n, subjects, objects) of triples (s, p, o)."""
    return rows.groupBy(F.col("p.lex").alias("p")).agg(F.count("*").alias("n"), F.countDistinct("s").alias("subjects"), F.countDistinct("o").alias("objects"))


def estimate(statistics: DataFrame, tokens_out: int, per_million_in: float, per_million_out: float, seconds_a_call: float, at_once: int = 1) -> DataFrame:
    """Adds tokens_out, price and seconds to (n_calls, tokens): what asking would cost, with so many calls at once."""
    out = statistics.withColumn("tokens_out", F.col("n_calls") * tokens_out)
    price = (F.col("tokens") * per_million_in + F.col("tokens_out") * per_million_out) / 1e6
    return out.withColumns({"price": price, "seconds": F.ceil(F.col("n_calls") / at_once) * seconds_a_call})


_NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve".split()
#: What asks for a single thing: forms of be that a question word governs in the singular, and plain words for one.
_ASKS_ONE = re.compile(r"\b(?:who|what|which|where|when|how)(?:\s+\w+)?(?:'s|\s+(?:is|was))\b|\b(?:only one|exactly one|a single|the single)\b")
#: What asks for a list: the plural forms, imperatives for lists, and words for more than one.
_ASKS_MANY = re.compile(r"\b(?:who|what|which|where)(?:\s+\w+)?\s+(?:are|were)\b|\b(?:list|enumerate|mention|all|every|each|several|some|various|different|multiple)\b")


def _asked_number(low: str) -> int:
    """The first number, in digits or as a word, that a plural follows within two words or that ends the text; 0 if none."""
    words = re.findall(r"[\w']+", low)
    for k, w in enumerate(words):
        n = int(w) if w.isdecimal() else _NUMBER_WORDS.index(w) + 1 if w in _NUMBER_WORDS else 0
        if 1 <= n <= 100 and (k == len(words) - 1 or any(x.endswith("s") for x in words[k + 1 : k + 3])):
            return n
    return 0


def fan_out(prompt: str | None) -> float:
    """Rows that an answer is expected to have: the number that the prompt asks for (1 to 100), 1 if it asks for a single
    thing, 10 if for a list, else 5."""
    low = (prompt or "").lower()
    if n := _asked_number(low):
        return float(n)
    return 1.0 if _ASKS_ONE.search(low) else 10.0 if _ASKS_MANY.search(low) else 5.0


def observed_fan_out(prior: float, answers: DataFrame) -> DataFrame:
    """(fan_out): the prior, counted as three answers, and the rows of the answers that were given."""
    return answers.where("ok").agg(((F.lit(3 * prior) + F.coalesce(F.sum(F.size("rows")), F.lit(0))) / (F.count("*") + 3)).alias("fan_out"))
