"""Token ids in files of fixed-width bit packing, written and read by Spark.

A file, a *shard*, holds whole documents, one after another. Every id takes the bits that
the vocabulary needs, so its place is known without reading what stands before it::

    header     magic, version, bits an id, ids a block
    blocks     packed ids; all blocks but the last are full
    index      of every block: byte offset, crc32
    documents  id, whether it is known, place of the first id
    footer     ids, documents, blocks, place of the index, shard number, magic, line end

Numbers are little-endian. Blocks start at byte borders, so a reader that maps the file
takes any ids out of it with :meth:`Shard.ids`, and unpacking works on 64 ids at a time in
numpy. The line end lets Spark's own text writer write a shard as one line of one file: so
shards go wherever Spark can write, and its commit drops what a lost task had begun.

Shards are numbered (partition, count), in the order of document ids. The place of a document
in the whole corpus is that in its shard plus the ids of all shards before.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.llm.word_tokens import SEGMENT_BYTES, WordEncoder, kept_encoder, segments, vocabulary_size
from seriesloom.operators.ordering import join_facts
from seriesloom.session import cut_lineage

MAGIC, VERSION = b"TOKS", 1
HEADER, FOOTER = "<4sBBHI4x", "<QQQQII4sc"
GROUP = 64  # ids that fill whole 64-bit words at any width
BLOCK_IDS = 1024 * GROUP
SHARD_BYTES = 32 << 20
_ROWS = 1024


def id_bits(vocabulary: int) -> int:
    """The least bits that tell ``vocabulary`` ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` at ``bits`` bits each; the last group of 64 is filled with zeros."""
    groups = np.zeros((-(-len(ids) // GROUP), GROUP), np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(groups), bits), "<u8")
    for k in range(GROUP):
        word, shift = divmod(k * bits, 64)
        words[:, word] |= groups[:, k] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= groups[:, k] >> np.uint64(64 - shift)
    return words.tobytes()


def unpack_bits(packed: bytes | memoryview, bits: int) -> np.ndarray:
    """The ids of whole groups of 64, fill included."""
    words = np.frombuffer(packed, "<u8").reshape(-1, bits)
    groups = np.empty((len(words), GROUP), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for k in range(GROUP):
        word, shift = divmod(k * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value |= words[:, word + 1] << np.uint64(64 - shift)
        groups[:, k] = value & mask
    return groups.reshape(-1)


class ShardWriter:
    """Collects the packed blocks of one shard; open ids are never more than a block and what is added."""

    def __init__(self, bits: int, block_ids: int = BLOCK_IDS):
        if block_ids % GROUP:
            raise ValueError(f"a block holds a multiple of {GROUP} ids")
        self._bits, self._block_ids = bits, block_ids
        self._out, self._index = bytearray(struct.pack(HEADER, MAGIC, VERSION, bits, 0, block_ids)), []
        self._open, self._open_ids, self._ids, self._documents = [], 0, 0, []

    def __len__(self) -> int:
        return len(self._out)

    def begin(self, doc_id: int | None) -> None:
        """The ids added from here on belong to this document."""
        self._documents.append((doc_id or 0, doc_id is not None, self._ids))

    def add(self, ids: np.ndarray) -> None:
        self._open.append(ids)
        self._open_ids += len(ids)
        self._ids += len(ids)
        if self._open_ids >= self._block_ids:
            self._pack(self._open_ids // self._block_ids * self._block_ids)

    def _pack(self, count: int) -> None:
        ids = np.concatenate(self._open)
        for a in range(0, count, self._block_ids):
            packed = pack_bits(ids[a : min(a + self._block_ids, count)], self._bits)
            self._index.append((len(self._out), zlib.crc32(packed)))
            self._out += packed
        self._open, self._open_ids = [ids[count:]], len(ids) - count

    def close(self, partition: int, number: int) -> bytes:
        """The whole shard, line end included."""
        if self._open_ids:
            self._pack(self._open_ids)
        at = len(self._out)
        index = np.array(self._index, [("at", "<u8"), ("crc", "<u4")])
        ids, known, starts = zip(*self._documents) if self._documents else ((), (), ())
        for part in (index["at"], index["crc"], np.array(ids, "<i8"), np.array(starts, "<u8"), np.array(known, "u1")):
            self._out += part.tobytes()
        self._out += struct.pack(FOOTER, self._ids, len(ids), len(index), at, partition, number, MAGIC, b"\n")
        return bytes(self._out)


class Shard:
    """A shard in memory or mapped from a file: its documents, and any of its ids."""

    def __init__(self, data: bytes | memoryview):
        self._data = memoryview(data)
        magic, version, self.bits, _, self.block_ids = struct.unpack_from(HEADER, self._data)
        self.n_ids, documents, blocks, at, self.partition, self.number, end, _ = struct.unpack_from(FOOTER, self._data, len(self._data) - struct.calcsize(FOOTER))
        if (magic, version, end) != (MAGIC, VERSION, MAGIC):
            raise ValueError("not a whole token shard of this version")
        self._index_at = at

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            values = np.frombuffer(self._data, kind, n, at)
            at += values.nbytes
            return values

        self.block_at, self._crc = column("<u8", blocks), column("<u4", blocks)
        self.doc_ids, self.starts, self.known = column("<i8", documents), column("<u8", documents), column("u1", documents).astype(bool)
        self.lengths = np.diff(np.append(self.starts, np.uint64(self.n_ids))).astype(np.int64)

    def block(self, k: int, check: bool = True) -> np.ndarray:
        """All ids of block ``k``; damaged bytes raise."""
        end = self.block_at[k + 1] if k + 1 < len(self.block_at) else self._index_at
        packed = self._data[int(self.block_at[k]) : int(end)]
        if check and zlib.crc32(packed) != self._crc[k]:
            raise ValueError(f"block {k} of shard ({self.partition}, {self.number}) is damaged")
        return unpack_bits(packed, self.bits)[: min(self.block_ids, self.n_ids - k * self.block_ids)]

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from ``start`` on; reads the groups of 64 that hold them and nothing else."""
        out, end = [], min(start + count, self.n_ids)
        while start < end:
            k, first = divmod(start, self.block_ids)
            last = min(self.block_ids, first + end - start)
            low, high = first // GROUP, -(-last // GROUP)
            at, width = int(self.block_at[k]), self.bits * 8
            found = unpack_bits(self._data[at + low * width : at + high * width], self.bits)
            out.append(found[first - low * GROUP : last - low * GROUP])
            start += last - first
        return np.concatenate(out) if out else np.empty(0, np.uint32)


def _encoded(batches: Iterator[pa.RecordBatch], encode: WordEncoder) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Documents and their ids in portions of about a megabyte of text: (begun ids or None, ids, edges)."""
    begun, texts, ends, size = [], [], [], 0

    def portion() -> tuple[list, np.ndarray, np.ndarray]:
        ids, lengths = encode(texts, ends)
        return begun, ids, np.concatenate([[0], np.cumsum(lengths)])

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1)):
            doc, parts = doc.as_py(), list(segments(text.as_py() or b""))
            for k, part in enumerate(parts):
                begun.append((k == 0, doc))
                texts.append(part)
                ends.append(k == len(parts) - 1)
                size += len(part)
                if size >= SEGMENT_BYTES or len(texts) >= _ROWS:
                    yield portion()
                    begun, texts, ends, size = [], [], [], 0
    if texts:
        yield portion()


def write_tokens(
    docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 1, shard_bytes: int = SHARD_BYTES, block_ids: int = BLOCK_IDS
) -> None:
    """Write the ids of all documents, in ascending order of ``doc_id``, as shards into ``folder``.

    A document is the ids of its text and then ``end_id``; a null text is empty, so it is the
    end alone. A shard ends with the first document that brings it to ``shard_bytes``: texts of
    any length are whole, encoded a segment at a time. Null ids come first; rows of one id are
    ordered by the hash of their text, and equal rows, also very many, spread over tasks and
    stand one after another. ``doc_id`` must be of a whole-number type; other columns are not
    read. An empty table leaves no shard.
    """
    bits = id_bits(vocabulary_size(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number, shard = TaskContext.get().partitionId(), 0, None
        for begun, ids, edges in _encoded(batches, kept_encoder(vocabulary, end_id)):
            for (first, doc), a, b in zip(begun, edges[:-1], edges[1:]):
                if first and shard and len(shard) >= shard_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([shard.close(partition, number)[:-1]], pa.binary())], ["shard"])
                    shard, number = None, number + 1
                shard = shard or ShardWriter(bits, block_ids)
                if first:
                    shard.begin(doc)
                shard.add(ids[a:b])
        if shard:
            yield pa.RecordBatch.from_arrays([pa.array([shard.close(partition, number)[:-1]], pa.binary())], ["shard"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    spread = rows.withColumns({"hash": F.xxhash64("text"), "origin": F.spark_partition_id()})
    by = ["doc_id", "hash", "text", "origin"]
    placed = spread.repartitionByRange("doc_id", "hash", "origin").sortWithinPartitions(*by).select("doc_id", "text")
    shards = placed.mapInArrow(run, "shard binary").select(F.col("shard").cast("string"))
    shards.write.option("maxRecordsPerFile", 1).text(folder)


def _numbers(shard: Shard, each: Callable[[np.ndarray], object], kind: pa.DataType) -> pa.Array:
    """``each`` of the ids of every document, a block at a time in memory."""
    out, rest, k, begin = [], np.empty(0, np.uint32), 0, 0
    for length in shard.lengths:
        parts, have = [rest], len(rest)
        while have < length:
            parts.append(shard.block(k))
            have += len(parts[-1])
            k += 1
        rest = np.concatenate(parts) if len(parts) > 1 else rest
        out.append(each(rest[:length]))
        rest, begin = rest[length:], begin + length
    return pa.array(out, kind)


def read_tokens(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """Every document of the shards in ``folder``: ``doc_id, start, n_tokens`` and its ``ids``, or with ``ids=False`` their ``ids_crc32``.

    ``start`` counts the ids of all documents before. Every block is checked against its crc32.
    """
    name, kind = ("ids", pa.list_(pa.int32())) if ids else ("ids_crc32", pa.int64())

    def each(values: np.ndarray) -> object:
        return values.astype(np.int32) if ids else zlib.crc32(values.astype("<u4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                if not content.as_buffer().size:  # what Spark writes for a table without rows
                    continue
                shard = Shard(content.as_buffer())
                n = len(shard.doc_ids)
                columns = [
                    pa.array(np.full(n, shard.partition), pa.int32()), pa.array(np.full(n, shard.number), pa.int32()),
                    pa.array(shard.doc_ids, pa.int64(), mask=~shard.known), pa.array(shard.starts.astype(np.int64)), pa.array(shard.lengths),
                    _numbers(shard, each, kind),
                ]
                whole = pa.RecordBatch.from_arrays(columns, ["partition", "number", "doc_id", "place", "n_tokens", name])
                for a in range(0, n, _ROWS * 8):
                    yield whole.slice(a, _ROWS * 8)

    files = spark.read.format("binaryFile").load(folder).select("content")
    found = files.mapInArrow(run, f"partition int, number int, doc_id bigint, place bigint, n_tokens bigint, {name} {'array<int>' if ids else 'bigint'}")
    found = cut_lineage(found)
    # One row per shard, then one per partition: neither grows with the ids of a shard.
    shards = found.groupBy("partition", "number").agg(F.sum("n_tokens").alias("ids"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("ids").over(earlier.partitionBy("partition").orderBy("number")), F.lit(0))
    partitions = shards.groupBy("partition").agg(F.sum("ids").alias("ids"))
    before = F.coalesce(F.sum("ids").over(earlier.orderBy("partition")), F.lit(0))
    bases = shards.withColumn("inside", inside).join(partitions.select("partition", before.alias("before")), "partition")
    placed = join_facts(found, bases.select("partition", "number", (F.col("inside") + F.col("before")).alias("base")), ["partition", "number"])
    return placed.select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", name)
