import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from frames import messy_rows

from seriesloom.llm import quality_resampling
from seriesloom.llm.quality_resampling import features, kth_largest, log_ratios, log_weights, resample


def test_models_against_counts(spark):
    texts = {1: "good clean words", 2: "bad bad junk", 3: "good words", 4: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    ratios = log_ratios(docs, spark.createDataFrame([(1,), (3,), (3,), (99,)], "doc_id bigint"), "doc_id", "text", 10)
    raw, target = Counter(), Counter()
    for i, f in zip(texts, features(pa.array(texts.values(), pa.string()), 10)):
        assert len(f) == max(0, 2 * len(re.findall(r"\S+", texts[i] or "")) - 1)
        raw.update(f.tolist())
        target.update(f.tolist() if i in (1, 3) else [])
    for f in range(1 << 10):
        want = math.log((target[f] + 1) / (target.total() + 1024)) - math.log((raw[f] + 1) / (raw.total() + 1024))
        assert abs(ratios[f] - want) < 1e-12


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(quality_resampling, "_FEW", 20)
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=3000), np.full(500, 0.25), rng.normal(size=50) * 1e6])
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    ordered = np.sort(values)[::-1]
    for k in (1, 7, 60, 1000, 1400, 3549):
        assert kth_largest(rows, "v", k) == ordered[k - 1]
    assert kth_largest(rows, "v", 0) is None and kth_largest(rows, "v", len(values)) is None


def test_resampling_prefers_the_target(spark):
    rows = [(i, f"fine prose number {i} of good kind") for i in range(60)] + [(100 + i, f"$$$ %%% {i} ### junk") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = resample(docs, docs.filter("doc_id < 60").select("doc_id"), 60).collect()
    assert sum(r["kept"] for r in found) == 60 and all(r["kept"] == (r["doc_id"] < 60) for r in found)


def test_messy(messy, nothing):
    found = resample(messy, messy.filter("lang = 'en'").select("doc_id"), 0.5).collect()
    assert len(found) == len(messy_rows())
    assert all(not r["kept"] and r["log_weight"] is None for r in found if r["doc_id"] in (4, 5, 6))
    assert abs(sum(r["kept"] for r in found) - len(found) / 2) <= 1
    assert resample(nothing, nothing.select("doc_id"), 0.5).count() == 0
    assert all(r["kept"] == (r["log_weight"] is not None) for r in resample(messy, nothing.select("doc_id"), 1.0).collect())
    assert not any(r["kept"] for r in resample(messy, nothing.select("doc_id"), 0).collect())


def test_weights_are_ratios_of_chances(spark):
    """The log weight is that of the chance of the text under one model by that under the other."""
    texts = {1: "good clean words", 2: "bad bad junk " * 40, 3: "good words", 4: None, 5: "clean junk"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    ratios = log_ratios(docs, spark.createDataFrame([(1,), (3,)], "doc_id bigint"), "doc_id", "text", 10)
    every = dict(zip(texts, features(pa.array(texts.values(), pa.string()), 10)))
    found = {r["doc_id"]: r["log_weight"] for r in log_weights(docs, ratios, "doc_id", "text").collect()}
    assert found[4] is None
    assert all(abs(found[i] - sum(ratios[f] for f in every[i].tolist())) < 1e-9 for i in (1, 2, 3, 5))
    tempered = {r["doc_id"]: r["log_weight"] for r in log_weights(docs, ratios, "doc_id", "text", 10.0).collect()}
    assert all(abs(tempered[i] - 10 * found[i] / len(every[i])) < 1e-9 for i in (1, 2, 3, 5))


def test_sample_in_proportion_to_the_ratio(spark):
    """Of two kinds of texts, one with twice the ratio is drawn first twice as often."""
    rows = [(i, "alpha" if i % 2 else "beta") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = resample(docs, docs.filter("doc_id % 6 IN (0, 1, 3)").select("doc_id"), 400).collect()
    weights = {r["doc_id"] % 2: r["log_weight"] for r in found}
    ratio = math.exp(weights[1] - weights[0])
    kept = Counter(r["doc_id"] % 2 for r in found if r["kept"])
    assert ratio > 1.5 and 0.7 < kept[1] / kept[0] / ratio < 1.4
