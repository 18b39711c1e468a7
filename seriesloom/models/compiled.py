"""Fitted trees of spark.ml as flat node arrays, evaluated for whole Arrow batches.

A saved model is a table of its nodes. As arrays they answer what the model's own
``transform`` does not: the prediction after any number of trees, and a recursion in which
each prediction is an input of the next one, without a plan that grows with the steps.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.session import WRITTEN, use_checkpoint_dir

_ROWS = 4096


@dataclass
class Compiled:
    """Nodes of all trees, one tree after another; a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    children: np.ndarray  # (nodes, 2)
    value: np.ndarray
    weight: np.ndarray  # of each tree
    depth: int

    def each(self, inputs: np.ndarray) -> Iterator[np.ndarray]:
        """What every tree says of every row, times its weight; tree by tree."""
        rows = np.arange(len(inputs))
        for root, weight in zip(self.roots, self.weight):
            node = np.full(len(inputs), root)
            for _ in range(self.depth):
                after = self.children[node, (inputs[rows, self.feature[node]] > self.threshold[node]).astype(int)]
                if (after == node).all():
                    break
                node = after
            yield self.value[node] * weight

    def predict(self, inputs: np.ndarray) -> np.ndarray:
        return sum(self.each(inputs), np.zeros(len(inputs)))

    def staged(self, df: DataFrame, features: str, counts: Sequence[int], keep: Sequence[str]) -> DataFrame:
        """``keep`` and ``staged``: the prediction of the first trees, for every count of ``counts``."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                inputs = _matrix(batch.column("_inputs"))
                upto, out = np.zeros(len(inputs)), []
                for k, says in enumerate(self.each(inputs), 1):
                    upto = upto + says
                    if k in counts:
                        out.append(upto)
                flat = np.stack([*out, *[upto] * (len(counts) - len(out))], axis=1)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(flat.reshape(-1)), len(counts)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, "staged"])

        rows = df.select(*keep, vector_to_array(features).alias("_inputs"))
        return rows.mapInArrow(run, _kinds(rows, keep) + ", staged array<double>")

    def recursive(self, state: DataFrame, recent: str, given: str, steps: int) -> DataFrame:
        """``state`` with ``_path``: predictions step by step, each the newest value of the next step.

        ``recent`` are the last values, newest first; ``given`` the other inputs of all steps, one after another.
        """
        keep = [c for c in state.columns if c not in (recent, given)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, whole.num_rows, _ROWS):
                    batch = whole.slice(a, _ROWS)
                    values, other = _matrix(batch.column(recent)), _matrix(batch.column(given)).reshape(batch.num_rows, steps, -1)
                    path = np.empty((batch.num_rows, steps))
                    for k in range(steps):
                        path[:, k] = self.predict(np.hstack([values, other[:, k]]))
                        values = np.hstack([path[:, k : k + 1], values[:, :-1]])
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(path.reshape(-1)), steps).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, "_path"])

        return state.mapInArrow(run, _kinds(state, keep) + ", _path array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def _kinds(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def compile_trees(model, spark: SparkSession) -> Compiled:
    """The nodes of a fitted forest or boosted model of spark.ml, read from its saved table."""
    path = f"{use_checkpoint_dir(spark)}/{WRITTEN}{uuid.uuid4().hex}"
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").select(
        "treeID", "id", "prediction", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"))
    nodes = saved.toPandas().sort_values(["treeID", "id"])  # as many as the model that the driver fitted
    sizes = nodes.groupby("treeID").size().to_numpy()
    roots = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    offset = np.repeat(roots, sizes)
    leaf, own = nodes["leftChild"].to_numpy() < 0, np.arange(len(nodes))
    children = np.stack([np.where(leaf, own, nodes[c].to_numpy() + offset) for c in ("leftChild", "rightChild")], axis=1)
    weights = np.array(model.treeWeights) if hasattr(model, "getMaxIter") else np.full(len(sizes), 1 / len(sizes))
    return Compiled(
        roots, np.where(leaf, 0, nodes["feature"].to_numpy()), np.where(leaf, np.inf, nodes["threshold"].to_numpy(dtype=float)), children,
        nodes["prediction"].to_numpy(), weights, max(t.depth for t in model.trees),
    )
