"""Mixing sources to target weights by hierarchical budgets.

Documents hang on a tree, one column per level (such as domain, language, source). The budget
of tokens runs down it: a node shares its budget among its children by their weights, and no
child gets more than it can give, its tokens times the number of epochs. What a child cannot
take goes to its siblings; only what a whole family cannot take reaches the next level up,
because a family's capacity bounds its budget already.

A leaf takes whole epochs first and then the beginning of one more epoch. Each epoch has its
own order of the documents by a seeded hash. All a document needs to know is its leaf's row:
the whole epochs and the last place that is still in. Nothing but tables of nodes is ordered
as a whole; inside a leaf, token sums of 4096 hash ranges find the range where the quota ends
and only that range is ordered row by row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.session import cut_lineage

EPOCHS = 4
SEED = 6


def word_count(text: str = "text") -> Column:
    """The number of runs of other characters than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def order_key(epoch: Column, doc_id: str, seed: int) -> Column:
    """The place of a document in an epoch; a null id counts as the empty text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def matched(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which null keys match; the keys come from the left."""
    renamed = right.withColumnsRenamed({c: f"__{c}" for c in columns})
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(renamed, condition, how).drop(*(f"__{c}" for c in columns))


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, str], budget: float | int, epochs: int) -> DataFrame:
    """``leaves`` (level columns and ``supply``) with ``quota``, the tokens each may give.

    ``weights`` has an SQL expression over the level columns for each level; a missing level
    weighs all alike, null and negative weights are 0 and give nothing. ``budget`` is a number
    of tokens if it is an int, else a share of all tokens.
    """
    weight = [F.greatest(F.coalesce(F.expr(weights.get(c, "1")).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in levels]
    nodes = leaves.withColumns({f"w{k}": w for k, w in enumerate(weight)})
    nodes = nodes.withColumn("capacity", F.when(F.least(*(F.col(f"w{k}") for k in range(len(levels))), F.lit(1.0)) > 0, F.col("supply") * F.lit(float(epochs))).otherwise(0.0))
    total = float(budget) if isinstance(budget, int) else (leaves.agg(F.sum("supply")).first()[0] or 0) * budget
    given = None
    for k, level in enumerate(levels):
        path = list(levels[: k + 1])
        here = nodes.groupBy(*path).agg(F.max(f"w{k}").alias("w"), F.sum("capacity").alias("capacity"))
        here = here.withColumn("given", F.lit(total)) if given is None else matched(here, given, levels[:k])
        family = Window.partitionBy(*(levels[:k] or [F.lit(0)]))
        ratio = F.when(F.col("w") > 0, F.col("capacity") / F.col("w")).otherwise(F.lit(float("inf")))
        order = family.orderBy(ratio, level)
        here = here.withColumn("before", F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("capacity"))
        here = here.withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        # The water level is the largest of these: it rises while children fill up and falls after.
        here = here.withColumn("line", F.when(F.col("rest") > 0, (F.col("given") - F.col("before")) / F.col("rest")))
        here = here.withColumn("line", F.greatest(F.max("line").over(family), F.lit(0.0)))
        given = here.select(*path, F.least("capacity", F.col("w") * F.col("line")).alias("given"))
    return matched(leaves, given, levels).withColumn("quota", F.floor(F.coalesce(F.col("given"), F.lit(0.0)) + 1e-6)).drop("given")


def mix_plan(docs: DataFrame, levels: Sequence[str], weights: Mapping[str, str], budget: float | int, epochs: int, seed: int, doc_id: str, tokens: str) -> DataFrame:
    """One row per leaf: ``supply, quota, whole`` epochs, and the last place ``cut`` of the next one."""
    rows = docs.select(*levels, F.col(doc_id).alias("id"), F.col(tokens).alias("tokens"))
    leaves = rows.groupBy(*levels).agg(F.sum("tokens").alias("supply"))
    leaves = leaf_budgets(cut_lineage(leaves), levels, weights, budget, epochs)
    whole = F.when(F.col("supply") > 0, F.floor(F.col("quota") / F.col("supply"))).otherwise(0)
    leaves = cut_lineage(leaves.withColumn("whole", whole).withColumn("rest", F.col("quota") - F.col("whole") * F.col("supply")))
    open_ = leaves.filter("rest > 0").select(*levels, "whole", "rest")
    placed = matched(rows, open_, levels).withColumn("key", order_key(F.col("whole") + 1, "id", seed)).withColumn("part", F.substring("key", 1, 3))
    parts = placed.groupBy(*levels, "part", "rest").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*levels).orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("tokens"))
    edge = cut_lineage(parts.filter("before <= rest AND upto > rest").groupBy(*levels).agg(F.min_by(F.struct("part", "before"), "part").alias("edge")).select(*levels, "edge.part", "edge.before"))
    place = F.struct("key", "tokens")
    inner = matched(placed, edge.withColumnRenamed("part", "edge"), levels).filter("part = edge")
    inner = inner.withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy(*levels).orderBy("key", "tokens")))
    last = inner.groupBy(*levels).agg(F.max(F.when(F.col("upto") <= F.col("rest"), place)).alias("cut"))
    # Without a place in the edge range, all places before that range are in.
    last = matched(edge.withColumnRenamed("part", "edge"), last, levels).select(*levels, F.coalesce("cut", F.struct(F.col("edge").alias("key"), F.lit(-1).cast("bigint").alias("tokens"))).alias("cut"))
    return cut_lineage(matched(leaves, last, levels, "left"))


def mix(
    docs: DataFrame, levels: Sequence[str], weights: Mapping[str, str], budget: float | int, epochs: int = EPOCHS, seed: int = SEED,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once per ``epoch``, with their ``tokens``.

    Tokens are words. A leaf gives its whole epochs and the longest beginning of the next one
    that its quota holds. Null levels are values of their own; rows that tie in an epoch (the
    same id and tokens) are in or out together, so repeated rows are too. Texts without words
    cost nothing and come with their epoch's place. A leaf without any tokens gives no rows,
    and so does an empty table. Columns named ``epoch``, ``tokens`` are replaced.
    """
    # Columns of any name travel in one struct; those of the mix have names of their own.
    names = [f"__level{k}" for k in range(len(levels))]
    counted = docs.select(
        F.struct(*(c for c in docs.columns if c not in ("epoch", "tokens"))).alias("row"),
        *(F.col(c).alias(n) for c, n in zip(levels, names)), F.col(doc_id).alias("__id"), word_count(text).alias("__tokens"),
    )
    small = cut_lineage(counted.drop("row").withColumnsRenamed(dict(zip(names, levels))))
    plan = mix_plan(small, levels, weights, budget, epochs, seed, "__id", "__tokens").filter("quota > 0")
    taken = matched(counted, plan.select(*(F.col(c).alias(n) for c, n in zip(levels, names)), "whole", "rest", "cut"), names)
    key = order_key(F.col("whole") + 1, "__id", seed)
    # No cut though something is left over: the quota ends with the epoch's last document.
    inside = F.when(F.col("rest") <= 0, False).otherwise(F.col("cut").isNull() | (F.struct(key.alias("key"), F.col("__tokens").alias("tokens")) <= F.col("cut")))
    taken = taken.withColumn("epochs", F.col("whole") + F.when(inside, 1).otherwise(0)).filter("epochs > 0")
    epoch = F.explode(F.sequence(F.lit(1).cast("bigint"), "epochs"))
    return taken.select("row", F.col("__tokens").alias("tokens"), epoch.alias("epoch")).select("row.*", "epoch", "tokens")
