"""Similarity join of word 5-gram sets by chosen paths.

In one run every set picks, by a hash that all sets share, each of its tokens with chance
``spread / (threshold * size)``; the sets that picked a token form a bucket. A bucket of more
than ``small`` sets is split again in the same way with a hash of its own, and so on. Two sets
of Jaccard similarity ``threshold`` share a bucket at depth k with the survival chance of a
branching process with ``spread`` children in the mean; runs are repeated until the chance to
miss such a pair is below 1 - ``recall`` (:func:`runs_needed`). More similar pairs are missed
less often.

How it is laid out:

1. One pass over the texts gives each set its two-word digest, its size, its 64 smallest
   hashes (a sketch) and its paths, as a forest. Equal sets are one set from here on.
2. Buckets are counted level by level; a path ends at its first bucket that is small, and
   paths that are alone in a bucket end for good. Only below large buckets are the forests
   unfolded, so a set of a large group walks as one row per bucket and not per path.
3. Buckets are brute-forced on the sketches: pairs that could reach the threshold tie their
   sets into clusters (the sketch of two sets at the threshold falls below ``screen`` in one
   of 10,000 cases; sets of at most 64 tokens are compared exactly). Large buckets
   are cut into blocks and every pair of blocks is a task of its own.
4. Each cluster is brute-forced on the whole sets, again in pairs of blocks, as products of
   0/1 matrices. Tasks return link counts per set and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.components import components
from seriesloom.llm.shingles import WordRuns, chunks, mix
from seriesloom.session import cut_lineage

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
SPREAD = 1.25
DEPTH = 3
SMALL = 64
SKETCH = 64
SCREEN = 0.6
BLOCK_SETS = 1024
BLOCK_TOKENS = 1_000_000
_SEED = 0x5EED0FC405E2


def runs_needed(recall: float, spread: float, depth: int) -> int:
    """Runs after which a pair at the threshold is found with chance ``recall`` at any depth."""
    lives = 1.0
    for _ in range(depth):  # of a Poisson branching process, generation by generation
        lives = 1 - math.exp(-spread * lives)
    return math.ceil(math.log(1 - recall) / math.log(1 - lives))


def chosen_paths(tokens: np.ndarray, runs: int, spread: float, threshold: float, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The paths of a set as a forest: level by level the nodes and the places of their parents in the level above.

    A node is a hash of its whole path, so no two nodes of a set are equal. Nodes of one parent
    stand together, in the order of the parents; those of the first level have runs as parents.
    """
    chance = spread / (threshold * max(len(tokens), 1))
    limit = np.uint64(min(int(chance * 2.0**64), 2**64 - 1))
    nodes, levels = mix(np.arange(_SEED, _SEED + runs, dtype=np.uint64)), []
    step = max(1, 2_000_000 // max(len(tokens), 1))
    for _ in range(depth):
        parents, children = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for k in range(0, len(nodes) if len(tokens) else 0, step):
            hashes = mix(tokens[None, :] ^ nodes[k : k + step, None])
            at, which = np.nonzero(hashes <= limit)
            parents.append(at + k)
            children.append(hashes[at, which])
        nodes = np.concatenate(children)
        levels.append((nodes, np.concatenate(parents)))
    return levels


def as_forests(sets: list[list[tuple[np.ndarray, np.ndarray]]], depth: int) -> pa.Array:
    """The forests of many sets as one array of nested lists: ``node`` and ``next``, the list of its children."""
    inner = None
    for level in reversed(range(depth)):
        node = pa.array(np.concatenate([x[level][0] for x in sets]).view(np.int64))
        whole = pa.StructArray.from_arrays([node] if inner is None else [node, inner], ["node"] if inner is None else ["node", "next"])
        if level:
            counts = np.concatenate([np.bincount(x[level][1], minlength=len(x[level - 1][0])) for x in sets])
        else:
            counts = np.array([len(x[0][0]) for x in sets])
        inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), whole)
    return inner


def token_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct word-run hashes of each text."""
    for _, part in chunks(texts):
        hashes, edges = WordRuns(part).runs(words, short=True)
        for a, b in zip(edges[:-1], edges[1:]):
            yield np.unique(hashes[a:b])


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, whatever the order of their tokens."""
    two = [mix(tokens ^ np.uint64(salt)).sum(dtype=np.uint64) if len(tokens) else np.uint64(0) for salt in (0xA5A5A5A5, 0x3C3C3C3C3C)]
    return int(two[0].astype(np.int64)), int(two[1].astype(np.int64))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two of the sets share, as products of 0/1 matrices."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    if len(sets) < 2:
        return out
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = uses[column] > 1
    owner, column = owner[keep], column[keep]
    if not len(column):
        return out
    column = np.unique(column, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    step = 4096
    for a in range(0, int(column[-1]) + 1, step):
        x, y = np.searchsorted(column, [a, a + step])
        part = np.zeros((len(sets), min(step, int(column[-1]) + 1 - a)), np.float32)
        part[owner[x:y], column[x:y] - a] = 1
        out += part @ part.T
    return out


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n things the first one of its component under the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


# ---- the Spark side --------------------------------------------------------------------


def describe_sets(docs: DataFrame, doc_id: str, text: str, words: int, runs: int, spread: float, threshold: float, depth: int) -> DataFrame:
    """One row per document: a row number, a hash of its text, and digest, size, sketch and paths of its set."""
    whole = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), F.monotonically_increasing_id().alias("row"), F.xxhash64(whole).alias("text_hash"))
    nested = "array<struct<node: bigint>>"
    for _ in range(depth - 1):
        nested = f"array<struct<node: bigint, next: {nested}>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, second, size, sketch, paths = [], [], [], [], []
            for tokens in token_sets(batch.column(1), words):
                a, b = digest(tokens)
                first.append(a)
                second.append(b)
                size.append(len(tokens))
                sketch.append((tokens[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes())
                paths.append(chosen_paths(tokens, runs, spread, threshold, depth))
            columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(size, pa.int64())]
            columns += [pa.array(sketch, pa.binary()), as_forests(paths, depth)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "text_hash", "d1", "d2", "size", "sketch", "paths"])

    kept = f"doc_id {rows.schema[0].dataType.simpleString()}, row bigint, text_hash bigint"
    return rows.mapInArrow(run, f"{kept}, d1 bigint, d2 bigint, size bigint, sketch binary, paths {nested}")


def buckets(sets: DataFrame, depth: int, small: int) -> DataFrame:
    """``row, node, sets``: the buckets of at least two sets in which the paths end.

    A set walks as one row per node with the forest below it, which is unfolded by one level
    only where the bucket of the node is large.
    """
    found = None
    nodes, walking = sets.select("row", F.explode("paths.node").alias("node")), sets.select("row", F.inline("paths"))
    for level in range(depth):
        counts = cut_lineage(nodes.groupBy("node").agg(F.count("*").alias("sets")).filter("sets > 1"))
        last = level == depth - 1
        here = nodes.join(counts if last else counts.filter(F.col("sets") <= small), "node").select("row", "node", "sets")
        found = here if found is None else found.unionByName(here)
        large = counts.filter(F.col("sets") > small).select("node")
        if last or large.isEmpty():
            return found
        walking = cut_lineage(walking.join(large, "node", "left_semi").select("row", F.inline("next")))
        nodes = walking.select("row", "node")
    return found


def in_tiles(rows: DataFrame, blocks: str, by: str) -> DataFrame:
    """Deal the rows of a group into ``blocks`` blocks and copy them to every pair of blocks.

    Adds the pair as ``low`` and ``high`` and the block of the row as ``side``.
    """
    dealt = rows.withColumn("side", F.pmod(F.xxhash64(by), F.col(blocks)))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1)))
    each = each.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other"))
    return each.drop("other", blocks)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups with the row at which each group begins."""
    held, rows = [], 0

    def edges(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        change[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        at = edges(t)
        if len(at) > 1:
            yield t.slice(0, at[-1]), at[:-1]
            held, rows = t.slice(at[-1]).to_batches(), t.num_rows - int(at[-1])
    if rows:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, edges(t)


def _pairs_in_groups(begin: np.ndarray, n: int, side: np.ndarray, one_block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs inside the groups; in groups of two blocks only those across."""
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
    left, right = [], []
    for shift in range(1, n):
        a = np.flatnonzero(group[:-shift] == group[shift:])
        if not len(a):
            break
        keep = one_block[a] | (side[a] != side[a + shift])
        left.append(a[keep])
        right.append(a[keep] + shift)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def screened_links(entries: DataFrame, threshold: float, screen: float, small: int) -> DataFrame:
    """``a, b``: a forest over the sets of each bucket whose sketches say they may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begin in whole_groups(batches, ["node", "low", "high"]):
            row, size, side = (t.column(c).to_numpy() for c in ("row", "size", "side"))
            one = t.column("low").to_numpy() == t.column("high").to_numpy()
            lengths = np.minimum(size, SKETCH)
            flat = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u4")
            place = np.concatenate([[0], np.cumsum(lengths)])
            counts = np.diff(np.append(begin, len(row)))
            few = np.repeat(counts <= small, counts)
            sketch = np.full((int(few.sum()), SKETCH), 0, np.uint64)
            spot = np.cumsum(few) - 1  # of the rows in small groups
            inside = np.arange(SKETCH)[None, :] < lengths[few][:, None]
            sketch[inside] = flat[np.repeat(few, lengths)]
            # Unused places hold numbers that no other place holds.
            filler = (np.uint64(1) << np.uint64(33)) + np.arange(sketch.size, dtype=np.uint64).reshape(sketch.shape)
            sketch[~inside] = filler[~inside]
            begins_few = np.searchsorted(np.flatnonzero(few), begin[counts <= small])
            a, b = _pairs_in_groups(begins_few, len(sketch), side[few], one[few])
            sizes = size[few]
            fit = np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b])
            a, b = a[fit], b[fit]
            good = np.zeros(len(a), bool)
            for k in range(0, len(a), 20_000):
                both = np.sort(np.concatenate([sketch[a[k : k + 20_000]], sketch[b[k : k + 20_000]]], axis=1), axis=1)
                common = (both[:, 1:] == both[:, :-1]).sum(axis=1)
                good[k : k + 20_000] = common >= screen * np.minimum(SKETCH, np.maximum(sizes[a[k : k + 20_000]], sizes[b[k : k + 20_000]]))
            rows_few = np.flatnonzero(few)
            links = [(rows_few[a[good]], rows_few[b[good]])]
            for x, n in zip(begin[counts > small], counts[counts > small]):
                common = overlaps([flat[place[i] : place[i + 1]] for i in range(x, x + n)])
                s = size[x : x + n]
                low, high = np.minimum(s[:, None], s[None, :]), np.maximum(s[:, None], s[None, :])
                close = (low >= threshold * high) & (common >= screen * np.minimum(SKETCH, high))
                if not one[x]:
                    close &= side[x : x + n, None] != side[None, x : x + n]
                u, v = np.nonzero(np.triu(close, 1))
                links.append((u + x, v + x))
            u, v = (np.concatenate(x) for x in zip(*links))
            root = local_roots(len(row), u, v)
            tied = np.flatnonzero(root != np.arange(len(row)))
            yield pa.RecordBatch.from_arrays([pa.array(row[root[tied]]), pa.array(row[tied])], ["a", "b"])

    return entries.mapInArrow(run, "a bigint, b bigint")


def verified_links(tiles: DataFrame, threshold: float) -> DataFrame:
    """``row, links, root`` by tile: the documents linked to a set, and a forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begin in whole_groups(batches, ["cluster", "low", "high"], 512):
            row, side, copies = (t.column(c).to_numpy() for c in ("row", "side", "copies"))
            one = t.column("low").to_numpy() == t.column("high").to_numpy()
            lists = t.column("tokens").combine_chunks()
            flat, place = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            for x, y in zip(begin, np.append(begin[1:], len(row))):
                _, at = np.unique(row[x:y], return_index=True)  # repeated documents bring a set twice
                at = at + x
                sets = [flat[place[i] : place[i + 1]] for i in at]
                size = np.array([len(s) for s in sets])
                common = overlaps(sets)
                close = common * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-3
                np.fill_diagonal(close, False)
                if not one[x]:
                    close &= side[at][:, None] != side[at][None, :]
                root = local_roots(len(at), *np.nonzero(np.triu(close, 1)))
                linked = np.flatnonzero(close.any(axis=1))
                links = close[linked].astype(np.float64) @ copies[at].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(row[at[linked]]), pa.array(links.astype(np.int64)), pa.array(row[at[root[linked]]])], ["row", "links", "root"])

    return tiles.mapInArrow(run, "row bigint, links bigint, root bigint")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL,
    spread: float = SPREAD, depth: int = DEPTH, small: int = SMALL, screen: float = SCREEN, block_sets: int = BLOCK_SETS, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """``doc_id, class_id, n_links, copies, text_hash, first`` for every row of ``docs``.

    Two documents are linked if the sets of their runs of ``words`` words have a Jaccard
    similarity of ``threshold`` or more; a text of fewer words is one run. Classes are the
    connected components, named by their smallest id. ``n_links`` counts the other documents
    that are linked to this one, ``copies`` the documents with the same set, itself included.
    ``text_hash`` is Spark's ``xxhash64`` of the text, which with the id tells rows apart where ids
    repeat; ``first`` is true for one row of each class, one with the smallest id.
    Null, empty and blank texts have no words: they are linked to nothing and their class is
    their own id. Repeated rows count as documents; a null id is larger than any other. Texts
    are read whole, a megabyte of text or one longer text at a time. At equal ids the earlier row
    in the order of the read is ``first``. Other columns are not read, whatever their names; an
    empty table gives no rows.
    """
    runs = runs_needed(recall, spread, depth)
    described = cut_lineage(describe_sets(docs, doc_id, text, words, runs, spread, threshold, depth))
    some = described.filter("size > 0")
    least = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    groups = cut_lineage(some.groupBy("d1", "d2").agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.min(least).alias("least")))
    sets = some.join(groups.select("row"), "row", "left_semi")

    entries = cut_lineage(buckets(sets, depth, small))
    entries = entries.join(sets.select("row", "size", "sketch"), "row").withColumn("blocks", F.ceil(F.col("sets") / block_sets))
    entries = in_tiles(entries, "blocks", "row").repartition("node", "low", "high").sortWithinPartitions("node", "low", "high")
    clusters = components(screened_links(entries, threshold, screen, small).distinct(), "a", "b")

    inside = clusters.select(F.col("node").alias("row"), F.col("root").alias("cluster")).join(sets.select("row", "doc_id", "text_hash", "d1", "d2", "size"), "row")
    inside = cut_lineage(inside.join(groups.select("row", "copies"), "row"))
    spans = inside.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("size") / block_tokens)).alias("blocks"))
    wanted = inside.join(spans, "cluster").withColumnsRenamed({"doc_id": "wanted_id", "text_hash": "wanted_hash"}).drop("size")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Always by shuffle, so that the plan is the same at any size. The hash keeps rows of one id apart.
    same = F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.xxhash64("text") == F.col("wanted_hash"))
    texts = texts.join(wanted.hint("merge"), same).select("row", "cluster", "blocks", "copies", "d1", "d2", "text")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(token_sets(batch.column(6), words))
            # Another text may have the same id and hash: only the set that was asked for counts.
            right = np.array([digest(t) == (a, b) for t, a, b in zip(found, batch.column(4).to_pylist(), batch.column(5).to_pylist())], bool)
            found = [t for t, ok in zip(found, right) if ok]
            edges = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
            lists = pa.ListArray.from_arrays(edges, pa.array((np.concatenate(found) if found else np.zeros(0, np.uint64)).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(pa.array(right)) for k in range(4)), lists], ["row", "cluster", "blocks", "copies", "tokens"])

    tiles = in_tiles(texts.mapInArrow(tokens, "row bigint, cluster bigint, blocks bigint, copies bigint, tokens array<bigint>"), "blocks", "row")
    tiles = tiles.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")
    verified = cut_lineage(verified_links(tiles, threshold))
    links = verified.groupBy("row").agg(F.sum("links").alias("links"))
    roots = components(verified.filter("row <> root"), "row", "root").select(F.col("node").alias("row"), "root")
    known = groups.join(links, "row", "left").join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
    names = known.groupBy("root").agg(F.min("least").alias("least"))
    total = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    known = known.drop("least").join(names, "root").select("d1", "d2", "copies", F.col("least.doc_id").alias("class_id"), F.col("least.row").alias("first_row"), total)
    worded = some.select("doc_id", "text_hash", "row", "d1", "d2").join(known, ["d1", "d2"])
    worded = worded.select("doc_id", "class_id", "n_links", "copies", "text_hash", (F.col("row") == F.col("first_row")).alias("first"))
    none, one = F.lit(0).cast("bigint").alias("n_links"), F.lit(1).cast("bigint").alias("copies")
    wordless = described.filter("size = 0").select("doc_id", F.col("doc_id").alias("class_id"), none, one, "text_hash", F.lit(True).alias("first"))
    return worded.unionByName(wordless)
