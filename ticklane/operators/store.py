"""Saving fitted parameters: a dataclass of numbers, texts, lists and arrays as one JSON line in any store that Spark writes; Spark ML pipelines with their metadata beside them."""

from __future__ import annotations

import dataclasses
import json
from typing import TypeVar

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

M = TypeVar("M")


def save(spark: SparkSession, model, path: str, **metadata) -> None:
    """Writes a fitted dataclass (hmm.Model, reduction.Components, hawkes parameters) and what is to be remembered about it; an older one at path is replaced."""
    plain = {f.name: getattr(model, f.name) for f in dataclasses.fields(model)}
    body = {k: {"array": v.tolist()} if isinstance(v, np.ndarray) else {"value": v} for k, v in plain.items()}
    spark.createDataFrame([(json.dumps({"kind": type(model).__name__, "fields": body, "metadata": metadata}),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, kind: type[M], path: str) -> tuple[M, dict]:
    """The dataclass written by save, which must be of the kind, and its metadata."""
    found = json.loads(spark.read.text(path).first()[0])
    if found["kind"] != kind.__name__:
        raise ValueError(f"{path} holds a {found['kind']}, not a {kind.__name__}")
    return kind(**{k: np.array(v["array"]) if "array" in v else v["value"] for k, v in found["fields"].items()}), found["metadata"]


def save_pipeline(spark: SparkSession, model: PipelineModel, path: str, **metadata) -> None:
    """A pipeline under path/model and its features and metadata under path/metadata."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps({"features": list(model.stages[0].getInputCols()), "learner": type(model.stages[-1]).__name__} | metadata),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_pipeline(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/metadata").first()[0])
