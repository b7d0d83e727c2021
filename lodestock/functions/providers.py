"""Outside models as functions of tables: a vectorizer loaded from a file, and a judge that is asked in batches."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .embedding import EmbeddingProvider


def vectorizer_at(path: str, name: str = "Vectorizer") -> Callable[[], EmbeddingProvider]:
    """What builds the provider of class `name` in a Python file, for `embed`. The file must be on every executor: `sparkContext.addFile` brings it there."""
    base = os.path.basename(path)

    def make() -> EmbeddingProvider:
        here = SparkFiles.get(base)
        spec = importlib.util.spec_from_file_location(base.removesuffix(".py"), here if os.path.exists(here) else path)
        if spec is None or spec.loader is None:
            raise ValueError(f"no module at {path}")
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        provider = getattr(module, name)()
        for needed in ("model_id", "dimension", "embed"):
            if not hasattr(provider, needed):
                raise TypeError(f"{name} of {path} has no {needed}")
        return provider

    return make


class Judge(Protocol):
    """What answers whether products suit a role. Built once in each task. An answer: (main_sku, verdict, probability); tokens: what the last call used."""

    tokens: int

    def ask(self, scene: str, questions: Sequence[dict]) -> Sequence[tuple[str, str, float | None]]: ...


ANSWER = "scene string, batch long, main_sku string, verdict string, probability double, error string, tokens long"


def answers_of(asked: DataFrame, make: Callable[[], Judge]) -> DataFrame:
    """(scene, batch, main_sku, verdict, probability, error, tokens): a call for each batch of `asked` (scene, batch, main_sku, ...), of a bounded size by rerank.question_batches.

    A batch whose call fails gives one row with the error and no answers, so that its SKUs stay silent and the others go on; tokens stand in a batch's first row.
    """
    schema = pa.schema([("scene", pa.string()), ("batch", pa.int64()), ("main_sku", pa.string()), ("verdict", pa.string()), ("probability", pa.float64()), ("error", pa.string()), ("tokens", pa.int64())])

    def call(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        scene, number = (k.as_py() for k in key)
        questions = sorted(rows.to_pylist(), key=lambda r: r["main_sku"])
        judge = make()
        try:
            out = [{"scene": scene, "batch": number, "main_sku": s, "verdict": v, "probability": p} for s, v, p in judge.ask(scene, questions)]
        except Exception as e:  # a provider's failure is data: the batch is reported, not the job ended
            out = [{"scene": scene, "batch": number, "error": f"{type(e).__name__}: {e}"[:300]}]
        if out:
            out[0]["tokens"] = int(getattr(judge, "tokens", 0) or 0)
        return pa.Table.from_pylist(out, schema=schema)

    plain = asked.withColumn("main_sku", F.col("main_sku").cast("string")).withColumn("batch", F.col("batch").cast("long"))
    return plain.groupBy("scene", "batch").applyInArrow(call, ANSWER)


def call_summary(answers: DataFrame) -> DataFrame:
    """One row: batches, failed, tokens."""
    return answers.agg(F.countDistinct("scene", "batch").alias("batches"), F.countDistinct(F.when(F.col("error").isNotNull(), F.struct("scene", "batch"))).alias("failed"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
