"""Quality by importance resampling.

Two generative models over hashed words and word pairs are counted: one of target texts, one
of all texts. The log weight of a text is the sum of the log ratios of the two over its features,
so the weight is the ratio of the chances that the models give the text. As an option (``scale``)
it is the mean log ratio times a number of features, as if all texts were that long; that
tempers the weights of long texts, and the sample is then not in proportion to the ratio. Gumbel noise from a seeded hash of the id is added, and the ``k`` largest sums are a
sample without replacement in proportion to the weights.

The raw model is counted over all documents. The target model is fitted on at most
``target_rows`` labelled ids, those with the smallest hashes, which are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.shingles import WordRuns, chunks
from seriesloom.session import cut_lineage

BITS = 14
TARGET_ROWS = 20_000
SEED = 3
_BINS = 4096
_FEW = 50_000


def features(texts: pa.Array, bits: int) -> Iterator[np.ndarray]:
    """The hashed words and word pairs of each text, with repeats."""
    shift = np.uint64(64 - bits)
    for _, part in chunks(texts):
        runs = WordRuns(part)
        (one, a), (two, b) = runs.runs(1), runs.runs(2)
        one, two = (one >> shift).astype(np.int64), (two >> shift).astype(np.int64)
        for i in range(len(part)):
            yield np.concatenate([one[a[i] : a[i + 1]], two[b[i] : b[i + 1]]])


def log_ratios(docs: DataFrame, targets: DataFrame, doc_id: str, text: str, bits: int) -> np.ndarray:
    """The log of target chance by raw chance of each hashed feature, with one added to each count."""
    marked = targets.select(F.col(doc_id).alias("__id")).distinct().withColumn("__target", F.lit(True))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(marked), F.col("id") == F.col("__id"), "left").select("text", F.coalesce("__target", F.lit(False)).alias("target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for found, wanted in zip(features(batch.column(0), bits), batch.column(1).to_pylist()):
                counts = np.bincount(found, minlength=1 << bits)
                raw += counts
                if wanted:
                    target += counts
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["feature", "raw", "target"])

    sums = rows.mapInArrow(count, "feature bigint, raw bigint, target bigint").groupBy("feature").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.ones(1 << bits), np.ones(1 << bits)
    for r in sums:
        raw[r["feature"]] += r["raw"]
        target[r["feature"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_weights(docs: DataFrame, ratios: np.ndarray, doc_id: str, text: str, scale: float | None = None) -> DataFrame:
    """``doc_id, log_weight`` of every row; null for texts without words."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    bits = int(np.log2(len(ratios)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [float(ratios[f].sum()) * (1.0 if scale is None else scale / len(f)) if len(f) else None for f in features(batch.column(1), bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.float64())], ["doc_id", "log_weight"])

    return rows.mapInArrow(weigh, f"doc_id {rows.schema[0].dataType.simpleString()}, log_weight double")


def kth_largest(rows: DataFrame, key: str, k: int) -> float | None:
    """The k-th largest key; None if there are at most k rows.

    Histograms narrow the range of keys until few rows, or one key, are left in it.
    """
    low, high, inside = rows.agg(F.min(key), F.max(key), F.count("*")).first()
    if k <= 0 or inside <= k:
        return None
    while inside > _FEW and high > low:
        bin_ = F.least(F.floor((F.col(key) - low) / ((high - low) / _BINS)), F.lit(_BINS - 1))
        part = rows.filter(F.col(key).between(low, high)).groupBy(bin_.alias("bin"))
        for r in sorted(part.agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect(), reverse=True):
            if k <= r["n"]:
                inside, low, high = r["n"], r["low"], r["high"]
                break
            k -= r["n"]
    if low == high:
        return low
    return rows.filter(F.col(key).between(low, high)).orderBy(F.col(key).desc()).limit(k).agg(F.min(key)).first()[0]


def resample(
    docs: DataFrame, targets: DataFrame, k: int | float, doc_id: str = "doc_id", text: str = "text", bits: int = BITS,
    target_rows: int = TARGET_ROWS, scale: float | None = None, seed: int = SEED,
) -> DataFrame:
    """``doc_id, log_weight, gumbel_key, kept`` for every row of ``docs``.

    ``targets`` has the ids of the target texts; null, unknown and repeated ids do no harm.
    ``k`` is a number of documents, or as a float a share of all. Rows that tie with the last
    one kept, as repeated rows do, are kept with it. Null, empty and blank texts have no weight and
    are not kept; a null id has a noise of its own. Texts of any length are read whole. ``scale`` replaces the sum of log ratios by their mean times ``scale``. Without targets the weights follow from
    the added ones alone. Repeated rows stay rows; an empty table gives no rows.
    """
    few = targets.select(F.col(doc_id)).filter(F.col(doc_id).isNotNull()).distinct().orderBy(F.xxhash64(F.lit(seed), doc_id), doc_id).limit(target_rows)
    ratios = log_ratios(docs, few, doc_id, text, bits)
    chance = (F.pmod(F.xxhash64(F.lit(seed), F.lit("noise"), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weighed = log_weights(docs, ratios, doc_id, text, scale).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(chance)))
    weighed = cut_lineage(weighed)
    number = k if isinstance(k, int) else round(k * weighed.count())
    last = kth_largest(weighed.filter("gumbel_key IS NOT NULL").select("gumbel_key"), "gumbel_key", number)
    kept = F.col("gumbel_key") >= (float("-inf") if last is None else last)
    return weighed.withColumn("kept", F.coalesce(kept, F.lit(False)) & F.lit(number > 0))
