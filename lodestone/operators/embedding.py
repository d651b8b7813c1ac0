"""Vectors of texts: feature hashing of tokens in the JVM; a model may take its place as an iterator function."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import query_tokens, tokens
from lodestone.plans.lineage import BROADCAST_ROWS, cut

DIM = 64


def embed(docs: DataFrame, id_col: str, dim: int = DIM, text_col: str = "text") -> DataFrame:
    """(id, embedding) with unit vectors of hashed token counts; the zero vector for a text without tokens."""
    counted = HashingTF(numFeatures=dim, inputCol="__t", outputCol="__c").transform(docs.select(id_col, tokens(F.col(text_col)).alias("__t")))
    return Normalizer(inputCol="__c", outputCol="__v").transform(counted).select(id_col, vector_to_array("__v", "float32").alias("embedding"))


def embed_with(docs: DataFrame, id_col: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], text_col: str = "text") -> DataFrame:
    """As embed, by a model: load() runs once per task and returns a function of a batch of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield pd.DataFrame({id_col: batch[id_col], "embedding": model(batch[text_col].fillna("").tolist())})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, embedding array<float>")


def rerank_with(texts: DataFrame, query: str, id_col: str, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Callable[[DataFrame], DataFrame]:
    """A rerank step for ranking.retrieve: joins the pool's texts (id, text) and scores (query, text) pairs by a model."""

    def step(hits: DataFrame) -> DataFrame:
        hits = cut(hits)  # ranked once: it is counted and joined
        ids = hits.select(id_col)
        pool = texts.select(id_col, "text").join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, id_col)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for batch in batches:
                yield pd.DataFrame({id_col: batch[id_col], "raw_score": model([(query, t) for t in batch["text"].fillna("")])})

        kind = texts.schema[id_col].dataType.simpleString()
        return pool.mapInPandas(run, f"`{id_col}` {kind}, raw_score double")

    return step


def late_interaction(texts: DataFrame, query: str, id_col: str) -> Callable[[DataFrame], DataFrame]:
    """A rerank step for ranking.retrieve without a trained model: the sum, over the query's tokens, of how like the most like token of a text is.

    A token's vector has a place for each run of three characters of the token between two marks, and unit length, so
    forms of a word are alike and others are not. The places of the query's tokens suffice for all products; a text's
    tokens times these is one matrix product. Texts without tokens score 0.
    """

    def runs(token: str) -> set[str]:
        marked = f"^{token}$"
        return {marked[i : i + 3] for i in range(len(marked) - 2)}

    asked = sorted(set(query_tokens(query)))
    places = {run: i for i, run in enumerate(sorted(set().union(*map(runs, asked))))}

    def matrix(tokens_: list[str]) -> np.ndarray:
        out = np.zeros((len(tokens_), len(places)))
        for row, token in enumerate(tokens_):
            own = runs(token)
            out[row, [places[r] for r in own if r in places]] = 1 / math.sqrt(len(own))
        return out

    def load() -> Callable[[list[tuple[str, str]]], list[float]]:
        wanted = matrix(asked).T

        def score(pairs: list[tuple[str, str]]) -> list[float]:
            return [float((matrix(sorted(set(query_tokens(text)))) @ wanted).max(axis=0, initial=0.0).sum()) for _, text in pairs]

        return score

    return rerank_with(texts, query, id_col, load)
