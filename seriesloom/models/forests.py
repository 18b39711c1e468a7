"""Regression forests of all depths and counts at once, grown by Spark.

A tree cut at a depth is the tree of that depth, and the first trees of a forest are a smaller
forest. So one forest, grown to the largest depth and count, answers for all smaller ones:
rows to be predicted run down the trees while these grow, and what their node says is noted
at every depth that is asked.

Rows carry the bins of their features, one byte each. A node with more than ``local_rows``
rows is split by Spark: tasks add up counts and sums per bin of their rows, Spark adds those of
all tasks. Below that the rows of a node, a bounded number, meet in one task that grows the
rest of the tree. Both ways take the same splits: how often a tree draws a row, and which
features a node tries, are hashes of their numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.ordering import join_facts

BINS = 32
LOCAL_ROWS = 100_000
TREES_A_TASK = 25
#: Chances that a draw with replacement takes a row at most 0, 1, 2, ... times (Poisson, mean 1).
DRAWS = np.cumsum([1 / np.e / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


@dataclass(frozen=True)
class Forest:
    """What is grown: trees, depths that are asked, features, how many of them a node tries."""

    trees: int
    depths: tuple[int, ...]
    features: int
    seed: int = 42
    bootstrap: bool = True
    share: float = 1 / 3

    @property
    def tried(self) -> int:
        return max(1, int(np.ceil(self.features * self.share)))


def mixed(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of numbers."""
    out = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for part in parts:
            out = out + np.asarray(part).astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
            out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out = out ^ (out >> np.uint64(31))
    return out


def draws(forest: Forest, row: np.ndarray, tree: int) -> np.ndarray:
    """How often the tree draws each row."""
    if not forest.bootstrap:
        return np.ones(len(row))
    return np.searchsorted(DRAWS, mixed(row, tree, forest.seed) / 2.0**64).astype(float)


def tried_features(forest: Forest, tree: int, nodes: np.ndarray) -> np.ndarray:
    """The features that each node tries, a row each."""
    order = mixed(nodes[:, None], np.arange(forest.features)[None, :], tree, forest.seed + 1)
    return np.sort(np.argpartition(order, forest.tried - 1, axis=1)[:, : forest.tried], axis=1)


def cells(at: np.ndarray, bins: np.ndarray, tried: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sums of each of ``values`` per node, tried feature and bin; ``at`` is the node's place per row."""
    k, m = tried.shape
    place = ((at[:, None] * m + np.arange(m)) * BINS + bins[np.arange(len(at))[:, None], tried[at]]).reshape(-1)
    return [np.bincount(place, np.repeat(v, m), k * m * BINS).reshape(k, m, BINS) for v in values]


def choose(n: np.ndarray, s: np.ndarray, tried: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, last bin of the left side and gain of the best split per node; gain 0 without one."""
    left_n, left_s = n.cumsum(2), s.cumsum(2)
    all_n, all_s = left_n[:, :1, -1:], left_s[:, :1, -1:]
    right_n, right_s = all_n - left_n, all_s - left_s
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_s**2 / left_n + right_s**2 / right_n - all_s**2 / all_n
    gain = np.where((left_n >= least) & (right_n >= least), gain, 0.0).reshape(len(n), -1)
    gain = np.round(gain, 9)  # sums in another order must not change the split
    best = gain.argmax(1)
    return tried[np.arange(len(n)), best // BINS], best % BINS, gain[np.arange(len(n)), best]


class Grower:
    """The subtree of one tree below ``node``; rows of weight 0 only run down."""

    def __init__(self, forest: Forest, tree: int, least: int, bins: np.ndarray, y: np.ndarray, weight: np.ndarray, node: int = 1):
        self.forest, self.tree, self.least = forest, tree, least
        self.bins, self.y, self.weight = bins, y, weight
        self.node, self.depth = np.full(len(y), node, np.int64), int(node).bit_length() - 1

    def run(self) -> Iterator[tuple[int, np.ndarray]]:
        """(depth, what every row's node says) for every asked depth from here on."""
        active = np.arange(len(self.y))  # rows of nodes that may split
        says = np.zeros(len(self.y))
        for depth in range(self.depth, max(self.forest.depths) + 1):
            if len(active):
                nodes, at = np.unique(self.node[active], return_inverse=True)
                w, y = self.weight[active], self.y[active]
                n, s = np.bincount(at, w), np.bincount(at, w * y)
                says[active] = (s / np.maximum(n, 1))[at]
            if depth in self.forest.depths:
                yield depth, says.copy()
            if depth == max(self.forest.depths) or not len(active):
                continue
            open_ = n >= 2 * self.least
            active, at = active[open_[at]], (np.cumsum(open_) - 1)[at[open_[at]]]
            if not len(active):
                continue
            nodes = nodes[open_]
            tried, w = tried_features(self.forest, self.tree, nodes), self.weight[active]
            # Labels count from the mean of their node, so the gain keeps its digits.
            off, drawn = self.y[active] - says[active], np.flatnonzero(w)
            n, s = cells(at[drawn], self.bins[active[drawn]], tried, w[drawn], (w * off)[drawn])
            feature, last, gain = choose(n, s, tried, self.least)
            split = gain > 0
            active, at = active[split[at]], at[split[at]]
            right = self.bins[active, feature[at]] > last[at]
            self.node[active] = self.node[active] * 2 + right


def bin_edges(rows: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per group an array of borders per feature; a value lies in the bin of how many it exceeds."""
    spots = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    return rows.groupBy(*by).agg(F.array(*[F.array_distinct(F.percentile_approx(c, spots, 10_000)) for c in columns]).alias("_edges"))


def binned(rows: DataFrame, columns: Sequence[str], edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` with ``bins``, an array of one small number per feature."""
    def place(k: int, c: str) -> F.Column:
        return F.size(F.filter(F.col("_edges")[k], lambda e: F.col(c) > e)).cast("tinyint")

    return join_facts(rows, edges, by).withColumn("bins", F.array(*[place(k, c) for k, c in enumerate(columns)])).drop("_edges")


def _arrays(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, ...]:
    bins = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, features).astype(np.intp)
    return batch.column("row").to_numpy(), bins, batch.column("y").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)


def _descend(tops: dict, tree: int, bins: np.ndarray) -> np.ndarray:
    """The node of each row below all splits of ``tops``: {(tree, node): (feature, last bin)}."""
    node = np.ones(len(bins), np.int64)
    moving = np.arange(len(bins))
    while len(moving):
        nodes, at = np.unique(node[moving], return_inverse=True)
        splits = [tops.get((tree, int(v))) for v in nodes]
        on = np.array([s is not None for s in splits])
        moving, at = moving[on[at]], at[on[at]]
        if len(moving):
            feature, last = np.array([s or (0, 0) for s in splits]).T
            node[moving] = node[moving] * 2 + (bins[moving, feature[at]] > last[at])
    return node


def upper_splits(rows: DataFrame, forest: Forest, least: int, local_rows: int) -> tuple[dict, dict, set]:
    """Splits, node means and nodes without a split, of all nodes with more than ``local_rows`` rows.

    A level of all trees is one job; there are as many such nodes as the rows fill, per tree.
    """
    tops, means, ended = {}, {}, set()
    frontier = [(t, 1) for t in range(forest.trees)]
    for depth in range(max(forest.depths) + 1):
        wanted: dict[int, np.ndarray] = {}
        for t, v in frontier:
            wanted.setdefault(t, []).append(v)
        wanted = {t: np.array(sorted(v), np.int64) for t, v in wanted.items()}

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # The labels count from the mean of the parent's level: exact enough, and known to all tasks.
            for batch in batches:
                row, bins, y, train = _arrays(batch, forest.features)
                for t, nodes in wanted.items():
                    at = _descend(tops, t, bins)
                    here = np.flatnonzero(np.isin(at, nodes))
                    if not len(here):
                        continue
                    place, tried = np.searchsorted(nodes, at[here]), tried_features(forest, t, nodes)
                    w = draws(forest, row[here], t) * train[here]
                    parts = cells(place, bins[here], tried, w, w * y[here], np.ones(len(here)))
                    full = np.flatnonzero(parts[2].reshape(-1))
                    i, j, b = np.unravel_index(full, parts[2].shape)
                    found = [np.full(len(full), t), nodes[i], j, b, *(p.reshape(-1)[full] for p in parts)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["tree", "node", "slot", "bin", "n", "s", "c"])

        cells_ = rows.mapInArrow(sums, "tree bigint, node bigint, slot bigint, bin bigint, n double, s double, c double")
        cells_ = cells_.groupBy("tree", "node", "slot", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "s", "c")])
        upto = Window.partitionBy("tree", "node", "slot").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy("tree", "node", "slot")
        run = cells_.select("tree", "node", "slot", "bin", *[F.sum(c).over(w).alias(f"{p}{c}") for p, w in (("l", upto), ("a", whole)) for c in ("n", "s", "c")])
        off = F.col("ls") - F.col("as") / F.col("an") * F.col("ln")  # the left sum from the mean of the node
        gain = F.when((F.col("ln") >= least) & (F.col("an") - F.col("ln") >= least), off * off / F.col("ln") + off * off / (F.col("an") - F.col("ln"))).otherwise(0.0)
        best = F.struct(F.round(gain, 9).alias("gain"), (-F.col("slot")).alias("slot"), (-F.col("bin")).alias("bin"), (F.col("lc") * 1.0).alias("lc"))
        found = run.groupBy("tree", "node").agg(F.max(best).alias("best"), F.max("an").alias("n"), F.max("as").alias("s"), F.max("ac").alias("c")).collect()
        frontier = []
        for r in found:
            t, v, split = r["tree"], r["node"], r["best"]
            means[t, v] = r["s"] / max(r["n"], 1.0)
            if depth == max(forest.depths) or r["n"] < 2 * least or split["gain"] <= 0:
                ended.add((t, v))
                continue
            feature = tried_features(forest, t, np.array([v]))[0][-split["slot"]]
            tops[t, v] = int(feature), int(-split["bin"])
            frontier += [(t, c) for c, size in ((2 * v, split["lc"]), (2 * v + 1, r["c"] - split["lc"])) if size > local_rows]
        if not frontier:
            break
    return tops, means, ended


def grow_and_predict(rows: DataFrame, forest: Forest, least: int, counts: Sequence[int], local_rows: int = LOCAL_ROWS) -> DataFrame:
    """``row, d<depth>_t<count>``: predictions of every row that is not ``train``, per asked depth and count of trees.

    ``rows`` has ``row`` (a number that tells rows apart), ``bins``, ``y`` and ``train``.
    """
    rows = rows.select("row", "bins", F.col("y").cast("double").alias("y"), "train")
    large = rows.count() > local_rows
    tops, means, ended = upper_splits(rows, forest, least, local_rows) if large else ({}, {}, set())
    edges = sorted({0, *counts} | ({*range(0, forest.trees, 1 if large else TREES_A_TASK)}))
    blocks = list(zip(edges, edges[1:]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row to the tasks of its nodes; nodes that are done need no training rows, so any task serves."""
        for batch in batches:
            row, bins, _, train = _arrays(batch, forest.features)
            for first, _ in blocks:
                node = _descend(tops, first, bins) if large else np.ones(len(row), np.int64)
                done = np.array([(first, int(v)) in ended for v in node]) if large else np.zeros(len(row), bool)
                keep = np.flatnonzero(~done | ~train)
                part = np.where(done, row % 1024, -1)[keep]
                kept = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), first)), pa.array(node[keep]), pa.array(part), *kept.columns], ["first", "node", "part", *kept.schema.names])

    ends = dict(blocks)

    def grow(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        first, node = batch.column("first")[0].as_py(), batch.column("node")[0].as_py()
        # One order of rows, so that sums are the same again if a lost task is rerun.
        batch = batch.take(pa.array(np.argsort(batch.column("row").to_numpy(), kind="stable")))
        row, bins, y, train = _arrays(batch, forest.features)
        test = np.flatnonzero(~train)
        total = np.zeros((len(forest.depths), len(test)))
        for tree in range(first, ends[first]):
            depth = node.bit_length() - 1
            for k, asked in enumerate(forest.depths):
                if asked < depth or (first, node) in ended:
                    total[k] += means[tree, node >> max(0, depth - asked)]
            if (first, node) not in ended:
                weight = draws(forest, row, tree) * train
                used = np.flatnonzero((weight > 0) | ~train)
                for asked, says in Grower(forest, tree, least, bins[used], y[used], weight[used], node).run():
                    total[forest.depths.index(asked)] += says[~train[used]]
        sums = {f"s{k}": pa.array(t) for k, t in enumerate(total)}
        return pa.table({"row": pa.array(row[test]), "last": pa.array(np.full(len(test), ends[first])), **sums})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    sent = rows.mapInArrow(send, "first bigint, node bigint, part bigint, " + ", ".join(f"{c} {k}" for c, k in kinds.items()))
    # The rows are few for the work they cause, so their number must not decide on the tasks.
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * len(blocks))
    sent = sent.repartition(tasks, "first", "node", "part")
    found = sent.groupBy("first", "node", "part").applyInArrow(grow, "row bigint, last bigint, " + ", ".join(f"s{k} double" for k in range(len(forest.depths))))
    return found.groupBy("row").agg(*[
        (F.sum(F.when(F.col("last") <= count, F.col(f"s{k}"))) / count).alias(f"d{depth}_t{count}") for k, depth in enumerate(forest.depths) for count in counts
    ])
