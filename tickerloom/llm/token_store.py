"""Token ids on disk as directly addressable codes (DAC).

An id is cut into 8-bit chunks, lowest first. Level k holds the k-th chunks of all ids that have
one, a bitmap telling which of them continue, and a rank directory (ones before every 512th bit).
To read id i: take chunk i of level 0; while its bit is set, the next level's index is the number
of ones before it, which the directory and one short popcount give. No block is decoded.

Payload layout, little endian: ``b"DAC1"``, uint32 levels; per level uint64 n, n chunk bytes,
ceil(n/8) bitmap bytes (bit j of a byte is entry 8*byte+j), ceil(n/512)+1 uint64 rank counts.

A stored corpus is a Parquet folder of rows (part, block, first, n_tokens, doc_ids, doc_lengths,
payload): ``part`` follows ascending doc_id, ``block`` the order inside it, ``first`` the position
of the block's first id inside the part. Parquet is only the container, so that Spark's commit
protocol covers retried tasks and any store that Spark reaches can hold it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, string_column, texts, work_path, writing
from .tokens import tokenizer

#: A block is closed once it holds this many ids; one document is never cut. Blocks are small, as
#: Parquet readers take thousands of rows at a time.
BLOCK_IDS = 1 << 14
#: Stands for a null doc_id in a store.
NO_ID = -(1 << 63)
#: Characters of a text by which documents of one id are ordered and dealt.
HEAD = 64
_RANK = 512
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)

STORE = "part long, block long, first long, n_tokens long, doc_ids binary, doc_lengths binary, payload binary"


def dac_encode(ids: np.ndarray) -> bytes:
    """Directly addressable code of unsigned 32-bit ids."""
    rest, levels = np.asarray(ids, np.uint32), []
    while len(rest) or not levels:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(np.add.reduceat(more.astype(np.uint64), np.arange(0, len(rest), _RANK)))]) if len(rest) else np.zeros(1)
        levels.append(struct.pack("<Q", len(rest)) + (rest & np.uint32(255)).astype(np.uint8).tobytes() + bits.tobytes() + ones.astype("<u8").tobytes())
        rest = rest[more] >> np.uint32(8)
    return b"DAC1" + struct.pack("<I", len(levels)) + b"".join(levels)


class Dac:
    """Random access to the ids of one payload."""

    def __init__(self, payload: bytes):
        view = memoryview(payload)
        if bytes(view[:4]) != b"DAC1":
            raise ValueError("not a DAC payload")
        (levels,) = struct.unpack_from("<I", view, 4)
        at, self.levels = 8, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", view, at)
            at += 8
            chunks = np.frombuffer(view, np.uint8, n, at)
            at += n
            bits = np.frombuffer(view, np.uint8, -(-n // 8), at)
            at += len(bits)
            ranks = np.frombuffer(view, "<u8", -(-n // _RANK) + 1, at)
            at += 8 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        first = i // _RANK * (_RANK // 8)
        tail = int(bits[i >> 3]) & ((1 << (i & 7)) - 1) if i & 7 else 0
        return int(ranks[i // _RANK]) + int(_ONES[bits[first : i >> 3]].sum()) + int(_ONES[tail])

    def __getitem__(self, i: int) -> int:
        """The i-th id, read from at most one chunk per level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            i = self._rank(bits, ranks, i)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1: a contiguous range of every level, found by two ranks each."""
        out = np.zeros(stop - start, np.uint32)
        where = np.arange(stop - start)
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            if start >= stop:
                break
            out[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(8 * k)
            more = np.unpackbits(bits[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 : (start & 7) + stop - start].astype(bool)
            where = where[more]
            start = self._rank(bits, ranks, start)
            stop = start + len(where)
        return out


def _blocks(rows: Iterator[tuple[int | None, str]], path: str, end_id: int) -> Iterator[tuple]:
    coder, part = tokenizer(path), TaskContext.get().partitionId()
    end, block, first = np.array([end_id], "<u4"), 0, 0
    doc_ids, lengths, pieces, held = [], [], [], 0
    for doc_id, text in rows:
        ids = coder.ids(text)
        doc_ids.append(NO_ID if doc_id is None else doc_id)
        lengths.append(len(ids) + 1)
        pieces += [ids, end]
        held += len(ids) + 1
        if held >= BLOCK_IDS:
            yield part, block, first, held, np.array(doc_ids, "<i8").tobytes(), np.array(lengths, "<i8").tobytes(), dac_encode(np.concatenate(pieces))
            block, first = block + 1, first + held
            doc_ids, lengths, pieces, held = [], [], [], 0
    if doc_ids:
        yield part, block, first, held, np.array(doc_ids, "<i8").tobytes(), np.array(lengths, "<i8").tobytes(), dac_encode(np.concatenate(pieces))


_ARROW = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("doc_lengths", pa.binary()), ("payload", pa.binary())])


def write_store(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 0) -> None:
    """Encode every whole text and write the ids, each document closed by ``end_id``, in ascending doc_id order.

    Defined results: a null or empty text gives only the end id; a null doc_id sorts first and is
    stored as ``NO_ID``; equal doc_ids follow each other in the order of their texts' first ``HEAD``
    characters, then by a hash of the whole text; an empty table gives an empty store; other columns
    are ignored. One range shuffle, then a narrow pass that holds one block of ids. The ranges go by
    that order and, among equal rows, by where these were read, so no id or text has to fit a task.
    """
    bounded_batches(docs.sparkSession)
    keyed = texts(docs).withColumns({"head": F.substring("text", 1, HEAD), "hash": F.xxhash64("text"), "place": F.spark_partition_id()})
    ordered = keyed.repartitionByRange("doc_id", "head", "hash", "place").sortWithinPartitions("doc_id", "head", "hash", "text").select("doc_id", "text")

    def run(batches):
        rows = ((d, t.as_py()) for b in batches for d, t in zip(b.column(0).to_pylist(), string_column(b.column(1)), strict=True))
        for block in _blocks(rows, tokenizer_path, end_id):
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(block, _ARROW, strict=True)], schema=_ARROW)

    ordered.mapInArrow(run, STORE).write.mode("overwrite").options(**writing(out)).option("compression", "none").parquet(out)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids.

    ``start`` adds the totals of earlier parts, one number for each part that was written.
    """
    bounded_batches(spark)
    store = spark.read.schema(STORE).parquet(path)
    totals = store.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, at = {}, 0
    for row in totals:
        before[row.part], at = at, at + row.n

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes = Dac(row["payload"])
                ids = np.frombuffer(row["doc_ids"], "<i8")
                lengths = np.frombuffer(row["doc_lengths"], "<i8")
                stops = np.cumsum(lengths)
                starts = stops - lengths
                base = before[row["part"]] + row["first"]
                for low in range(0, len(ids), 256):
                    part = slice(low, low + 256)
                    at = int(starts[low])  # these documents lie side by side: one range of every level
                    span = codes.slice(at, int(stops[part][-1])).astype("<u4")
                    found = [span[a - at : b - at] for a, b in zip(starts[part].tolist(), stops[part].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None if d == NO_ID else int(d) for d in ids[part]], pa.int64()),
                            pa.array(base + starts[part]),
                            pa.array(lengths[part]),
                            pa.array([zlib.crc32(x) for x in found], pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return store.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer_path: str, end_id: int = 0, out: str | None = None) -> DataFrame:
    """Write a store (to the shared folder unless ``out`` names a place) and read it back per document."""
    spark = docs.sparkSession
    path = out or work_path(spark, "token-store")
    write_store(docs, tokenizer_path, path, end_id)
    return read_store(spark, path)
