"""Exact top-k search by tiled matrix products.

Queries and vectors are quantised to whole numbers. Query blocks meet vector shards in tiles:
one task multiplies a block with the slices of a shard and keeps, per query, the best of the
slice and of what it had (partial selection). The short lists of the shards are then merged in
a tree, ``FAN_IN`` lists at a time. Blocks and shards are hash-dealt and of bounded size, a
vector is copied once per query block, a query once per shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.session import cut_lineage

K = 5
SCALE = 256.0
BLOCK = 4096
SHARD = 16384
SLICE = 2048
FAN_IN = 8
#: Up to this product of norms a dot product in doubles is exact.
EXACT = 2.0**52


def quantised(vectors: DataFrame, scale: float, flag: bool) -> DataFrame:
    """``vec_id, row, q`` of (vec_id, embedding, is_query) rows that take part; with ``flag`` only the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, asks = batch.column(0).to_pylist(), batch.column(3), batch.column(2).to_pylist()
            kept, out = [], []
            for i, x in enumerate(batch.column(1).to_pylist()):
                if x is None or ids[i] is None or (flag and not asks[i]) or any(v is None for v in x):
                    continue
                x = np.array(x, np.float64)
                if np.isfinite(x).all():
                    kept.append(i)
                    out.append(np.floor(x * scale))
            edges = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32))
            lists = pa.ListArray.from_arrays(edges, pa.array(np.concatenate(out) if out else np.zeros(0)))
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), rows.take(at), lists], ["vec_id", "row", "q"])

    return vectors.mapInArrow(run, f"vec_id {vectors.schema[0].dataType.simpleString()}, row bigint, q array<double>")


def products(queries: list[np.ndarray], vectors: list[np.ndarray]) -> np.ndarray:
    """Whole-number inner products; a shorter vector counts as filled up with zeros.

    Doubles are exact while the norms are small enough for it. Beyond, Python's integers are
    used, and a product beyond 2**63 - 1 either way becomes that number.
    """
    wide = max((len(x) for x in [*queries, *vectors]), default=0)

    def matrix(rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), wide))
        for i, x in enumerate(rows):
            out[i, : len(x)] = x
        return out

    q, v = matrix(queries), matrix(vectors)
    out = q @ v.T
    large = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :] >= EXACT
    if not large.any():
        return out.astype(np.int64)
    whole = np.where(large, 0, out).astype(np.int64)
    low, high = -(2**63 - 1), 2**63 - 1
    exact = {}
    for i, j in zip(*np.nonzero(large)):
        a = exact.setdefault((0, i), [int(x) for x in q[i]])
        b = exact.setdefault((1, j), [int(x) for x in v[j]])
        whole[i, j] = min(max(sum(x * y for x, y in zip(a, b)), low), high)
    return whole


class TopLists:
    """The best ``k`` vectors of each query of a tile so far."""

    def __init__(self, queries: list[np.ndarray], k: int):
        self.queries, self.k = queries, k
        self.scores, self.ids = np.zeros((len(queries), 0), np.int64), np.zeros((len(queries), 0), np.int64)

    def add(self, vectors: list[np.ndarray], ids: np.ndarray) -> None:
        scores = products(self.queries, vectors)
        if scores.shape[1] > 4 * self.k:  # partial selection: what is below the k-th score of the slice goes
            floor = np.partition(scores, -self.k, axis=1)[:, -self.k]
            useful = (scores >= floor[:, None]).any(axis=0)
            scores, ids = scores[:, useful], ids[useful]
        scores = np.hstack([self.scores, scores])
        ids = np.hstack([self.ids, np.tile(ids, (len(scores), 1))])
        order = np.lexsort((ids, -scores))[:, : self.k]
        self.scores, self.ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def tile_lists(tiles: DataFrame, k: int, slice_rows: int) -> DataFrame:
    """``row, query_id, own, shard, vec_id, score``: the best k of every query in every tile.

    The rows of a tile come sorted, queries first, and its vectors are read slice by slice.
    """
    schema = "row bigint, query_id bigint, own bigint, shard bigint, vec_id bigint, score bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, ids, queries, lists = None, [], [], [], None

        def finished() -> Iterator[pa.RecordBatch]:
            if lists is None or not lists.scores.shape[1]:
                return
            n, m = lists.scores.shape
            own = np.concatenate([products([q], [q])[0] for q in queries])
            columns = [np.repeat(np.array(rows, np.int64), m), np.repeat(np.array(ids, np.int64), m), np.repeat(own, m), np.full(n * m, key[1]), lists.ids.ravel(), lists.scores.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "query_id", "own", "shard", "vec_id", "score"])

        for batch in batches:
            block, shard, kind, vec_id, row = (batch.column(i).to_numpy() for i in range(5))
            q = batch.column(5)
            flat, place = q.values.to_numpy(), q.offsets.to_numpy()
            change = np.ones(len(block), bool)
            change[1:] = (block[1:] != block[:-1]) | (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])
            edges = np.append(np.flatnonzero(change), len(block))
            for a, b in zip(edges[:-1], edges[1:]):
                if key != (block[a], shard[a]):
                    yield from finished()
                    key, rows, ids, queries, lists = (block[a], shard[a]), [], [], [], None
                if kind[a] == 0:
                    queries += [flat[place[i] : place[i + 1]] for i in range(a, b)]
                    rows += row[a:b].tolist()
                    ids += vec_id[a:b].tolist()
                elif queries:
                    lists = lists or TopLists(queries, k)
                    for x in range(a, b, slice_rows):
                        y = min(b, x + slice_rows)
                        lists.add([flat[place[i] : place[i + 1]] for i in range(x, y)], vec_id[x:y])
        yield from finished()

    return tiles.mapInArrow(run, schema)


def merge_lists(lists: DataFrame, group: list[str], k: int) -> DataFrame:
    """The k best rows of each group by score, ties to smaller ids."""
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), "vec_id")
    return lists.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = SCALE,
    block: int = BLOCK, shard: int = SHARD, slice_rows: int = SLICE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row the k other rows of highest score.

    ``is_query`` picks the query rows by the columns of ``vectors``. The score is the inner
    product of floor(scale * x), cut at 2**63 - 1 either way. Vectors that are null or hold a null or non-finite component, and rows without an id, take no part; a
    shorter vector counts as filled up with zeros. Rows that repeat an id are rows of their
    own: such a query has as many result lists. Fewer than k candidates give all of them; an
    empty table gives no rows. Other columns are not read.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("x"), F.coalesce(is_query, F.lit(False)).alias("ask"), F.monotonically_increasing_id().alias("row"))
    queries = cut_lineage(quantised(rows.filter("ask"), scale, True))
    blocks, shards = max(1, -(-queries.count() // block)), max(1, -(-vectors.count() // shard))
    deal = F.xxhash64("row")
    asked = queries.withColumn("block", F.pmod(deal, F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))
    stored = quantised(rows, scale, False).withColumn("shard", F.pmod(deal, F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    columns = ["block", "shard", "kind", "vec_id", "row", "q"]
    tiles = asked.withColumn("kind", F.lit(0)).select(columns).unionByName(stored.withColumn("kind", F.lit(1)).select(columns))
    tiles = tiles.repartition("block", "shard").sortWithinPartitions("block", "shard", "kind", "vec_id")
    # One more than asked for, as a query finds itself too.
    lists = tile_lists(tiles, k + 1, slice_rows)
    while shards > 1:
        shards = -(-shards // FAN_IN)
        lists = merge_lists(lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN)), ["row", "shard"], k + 1).drop("place")
    found = merge_lists(lists, ["row"], k + 1)
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    found = found.withColumn("self", F.min(F.when(own, F.col("place"))).over(Window.partitionBy("row")))
    found = found.filter("self IS NULL OR place <> self").withColumn("rank", F.col("place") - F.when(F.col("place") > F.col("self"), 1).otherwise(0))
    return found.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
