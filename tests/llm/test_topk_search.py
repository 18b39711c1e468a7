import math
import random

import pytest
from pyspark.sql import functions as F

from seriesloom.llm.topk_search import top_k

KIND = "vec_id bigint, embedding array<float>, label int, row string, score string, block string"


def brute(rows, k):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(kept):
        if i % 3:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(kept) if m != n)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 1.0, 3.0]) for _ in range(6)], i, "r", "s", "b") for i in range(60)]
    rows += [(9, [1.0] * 6, 1, "r", "s", "b")] * 3 + [(12, [1.0, 2.0], 1, "r", "s", "b"), (15, [], 1, "r", "s", "b")]
    rows += [(18, None, 1, "r", "s", "b"), (None, [1.0] * 6, 1, "r", "s", "b"), (21, [1.0, None], 1, "r", "s", "b"), (24, [float("nan")], 1, "r", "s", "b"), (27, [float("inf")], 1, "r", "s", "b")]
    return rows


@pytest.mark.parametrize("block, shard, slice_rows", [(4096, 16384, 2048), (5, 7, 3)])
def test_against_brute_force(spark, block, shard, slice_rows):
    rows = rows_of(1)
    frame = spark.createDataFrame(rows, KIND).repartition(3)
    found = top_k(frame, F.col("vec_id") % 3 == 0, 4, block=block, shard=shard, slice_rows=slice_rows).collect()
    assert sorted(tuple(r) for r in found) == brute(rows, 4)


def test_few_and_large(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (3, [2.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert top_k(few, F.col("vec_id") % 3 == 0, 5).count() == 2
    assert top_k(few.limit(0), F.col("vec_id") % 3 == 0, 5).count() == 0
    large = spark.createDataFrame([(0, [3e6, 1.0]), (1, [3e6 + 0.25, 7.0]), (2, [1e300, 0.0])], "vec_id bigint, embedding array<double>")
    found = {r["vec_id"]: r["score"] for r in top_k(large, F.col("vec_id") == 0, 5).collect()}
    assert found == {1: 768000000 * 768000064 + 256 * 1792, 2: 2**63 - 1}
