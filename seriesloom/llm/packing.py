"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Three steps, none of which gathers documents in one place:

1. Tasks tokenise their documents, cut the long ones into pieces and give every piece a
   running number among the pieces of its length in this task (its block). The pieces are
   written once as a table.
2. The histogram of the lengths, at most one count for each length up to the capacity
   whatever the corpus, is packed as a whole: :func:`plan_bins` returns bin patterns with
   the number of bins of each.
3. The pieces of one length are numbered through by block offsets, and a number finds its
   bin and its place in the pattern by a range lookup in the (small) plan.

So the result is that of a packing of the whole corpus at once, and as good at any size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.tokens import token_encoder
from seriesloom.session import cut_lineage

CAPACITY = 2048
_ROWS = 256


def best_two_fit(left: np.ndarray, capacity: int) -> list[int]:
    """The lengths of one bin: the longest piece left, best fits, then the two-for-one exchange.

    ``left[n]`` counts the unpacked pieces of length n; it is not changed.
    """
    left = left.copy()
    sizes = np.flatnonzero(left)
    first = int(sizes[-1])
    bin_, gap = [first], capacity - first
    left[first] -= 1
    while gap > 0:
        fits = np.flatnonzero(left[: gap + 1])
        if not len(fits):
            break
        n = int(fits[-1])
        bin_.append(n)
        left[n] -= 1
        gap -= n
    if gap > 0:
        smallest = bin_[-1]
        room = gap + smallest
        # Two unpacked pieces a <= b with smallest < a + b <= room, the larger sum the better.
        fits = np.flatnonzero(left[: room + 1])
        best = (smallest, 0, 0)
        a, b = 0, len(fits) - 1
        while a <= b:
            total = int(fits[a] + fits[b])
            if total > room or (a == b and left[fits[a]] < 2):
                b -= 1
                continue
            if total > best[0]:
                best = (total, int(fits[a]), int(fits[b]))
            a += 1
        if best[1]:
            bin_[-1:] = [best[2], best[1]]
    return bin_


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns of bins and how many bins have each: ``(bins, lengths)``.

    A pattern is used as long as all its lengths last, so each step uses up a length and the
    number of patterns is bounded by the capacity, not by the corpus.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, count in histogram.items():
        left[n] = count
    plan = []
    while left.any():
        pattern = best_two_fit(left, capacity)
        lengths, times = np.unique(pattern, return_counts=True)
        bins = int((left[lengths] // times).min())
        left[lengths] -= bins * times
        plan.append((bins, pattern))
    return plan


Payload = tuple[str, Callable[[np.ndarray, np.ndarray], pa.Array]]


def _lists(ids: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32)))


IDS: Payload = ("ids array<int>", _lists)


def _crc32(ids: np.ndarray, edges: np.ndarray) -> pa.Array:
    raw = ids.astype("<u4")
    return pa.array([zlib.crc32(raw[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.int64())


IDS_CRC32: Payload = ("ids_crc32 bigint", _crc32)


def cut_pieces(docs: DataFrame, encoder: Callable[[], Callable[[str | None], np.ndarray]], capacity: int, doc_id: str, text: str, payload: Payload) -> DataFrame:
    """The pieces of every document with their payload, block and number in the block."""
    name, make = payload[0].split()[0], payload[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, block, seen = encoder(), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for a in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(a, _ROWS)
                of, piece, start, length, flat = [], [], [], [], []
                for i in range(batch.num_rows):
                    ids = encode(batch.column(1)[i].as_py())
                    edges = list(range(len(ids) % capacity or capacity, len(ids) + 1, capacity))
                    flat.append(ids)
                    for k, (x, y) in enumerate(zip([0, *edges[:-1]], edges)):
                        of.append(i)
                        piece.append(k)
                        start.append(x)
                        length.append(y - x)
                number = np.empty(len(length), np.int64)
                for k, n in enumerate(length):
                    number[k] = seen[n]
                    seen[n] += 1
                kept = make(np.concatenate(flat), np.concatenate([[0], np.cumsum(length)]))
                columns = [
                    batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), kept, pa.array(np.full(len(of), block), pa.int32()), pa.array(number),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", name, "block", "number"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, piece int, start bigint, length bigint, {payload[0]}, block int, number bigint")


def place(numbered: DataFrame, plan: list[tuple[int, list[int]]], capacity: int) -> DataFrame:
    """Give each piece, known by its length and its ``number`` in the corpus, a sequence and an offset."""
    slots, first, used = [], 0, np.zeros(capacity + 1, np.int64)
    for bins, pattern in plan:
        offset = 0
        for n in pattern:  # the bins from ``first`` on take the next ``bins`` numbers of this length
            slots.append((n, used[n], first - used[n], offset))
            used[n] += bins
            offset += n
        first += bins
    slots.sort()
    of, low, shift, offset = np.array(slots, np.int64).reshape(-1, 4).T
    begin = np.searchsorted(of, np.arange(capacity + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(batch.schema.get_field_index("length")).to_numpy()
            number = batch.column(batch.schema.get_field_index("number")).to_numpy()
            at = np.empty(len(n), np.int64)
            for size in np.unique(n):
                rows = n == size
                at[rows] = begin[size] + np.searchsorted(low[begin[size] : begin[size + 1]], number[rows], side="right") - 1
            rest = [c for c in batch.schema.names if c != "number"]
            columns = [*(batch.column(batch.schema.get_field_index(c)) for c in rest), pa.array(number + shift[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, [*rest, "sequence_id", "offset"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields if f.name != "number"]
    return numbered.mapInArrow(run, ", ".join([*fields, "sequence_id bigint, offset bigint"]))


def pack(
    docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 0, payload: Payload = IDS
) -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset`` of every piece of every document.

    A document is the ids of its text and then ``end_id``; a null text is empty, so it is the
    end alone. Only documents of more than ``capacity`` tokens are cut; the first piece takes
    the remainder. ``payload`` names what is kept of the ids of a piece and how it is made, by
    default the ids. Repeated rows are packed as often as they come, document ids may be null
    or tied, other columns are not read, and an empty table gives no rows.
    """
    pieces = cut_lineage(cut_pieces(docs, lambda: token_encoder(vocabulary, end_id), capacity, doc_id, text, payload))
    counts = cut_lineage(pieces.groupBy("length", "block").agg(F.count("*").alias("pieces")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("pieces").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "block", F.coalesce(F.sum("pieces").over(earlier), F.lit(0)).alias("before"))
    numbered = pieces.join(before, ["length", "block"]).withColumn("number", F.col("number") + F.col("before"))
    return place(numbered.select("doc_id", "piece", "start", "length", payload[0].split()[0], "number"), plan_bins(histogram, capacity), capacity)
