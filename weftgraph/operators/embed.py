"""Vectors of texts from an embedding service, and similarity by them where both texts have one."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import save
from .similarity import cosine, jaccard


@dataclass
class Embeddings:
    """A service with the widespread /embeddings interface; a failed request gives its texts no vectors."""

    base: str
    model: str
    key: str | None = None
    timeout: float = 30.0

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        import urllib.request

        head = {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.key}"} if self.key else {})}
        request = urllib.request.Request(f"{self.base}/embeddings", json.dumps({"model": self.model, "input": texts}).encode(), head)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                found = {x["index"]: x["embedding"] for x in json.load(r)["data"]}
        except Exception:  # noqa: BLE001 - any failure is no vector
            found = {}
        return [found.get(k) for k in range(len(texts))]


@dataclass
class LetterCounts:
    """How often a text holds each letter a-z; no vector for texts that begin with a prefix. For tests whose vectors
    SQL can state."""

    none_for: str = "\0"

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        return [None if t.startswith(self.none_for) else [float(t.count(chr(c))) for c in range(97, 123)] for t in texts]


def embed_texts(texts: DataFrame, provider, batch: int = 64) -> DataFrame:
    """(text, v) of the different texts, each sent once, batch at a time; v is null without an answer. Written
    before use."""
    work = cloudpickle.dumps(provider)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = cloudpickle.loads(work)
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf["text"].iloc[i : i + batch].tolist()
                yield pd.DataFrame({"text": part, "v": provider.embed(part)})

    return save(texts.select("text").where("text IS NOT NULL").distinct().mapInPandas(vectors, "text string, v array<double>"), "vectors")


def compared(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (a, b, ..) with similarity and measure: cosine where both texts have a vector, else their words' Jaccard."""
    side = lambda name: vectors.select(F.col("text").alias(name), F.col("v").alias(f"__{name}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    has = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    out = both.withColumn("similarity", F.when(has, cosine(F.col("__a"), F.col("__b"))).otherwise(jaccard(F.col("a"), F.col("b"))))
    return out.withColumn("measure", F.when(has, "cosine").otherwise("words")).select(*pairs.columns, "similarity", "measure")
