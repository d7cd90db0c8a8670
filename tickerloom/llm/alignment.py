"""Two tokenizers' tokens of the same text, aligned by bytes.

A whole Arrow slice is worked on at once: its documents' tokens lie end to end, an offset for each token's
last byte. Ends of both kinds are counted per byte once; where both occur, the text is cut, and a running count
of cuts names each token's group. Results of documents are differences of running sums at their ends.

How often ids are linked in the corpus needs two passes over what the first one stores. It writes
a row for each block (an Arrow batch): the distinct id pairs of the block, in how many of its documents
each is, and for each document which pairs it holds how often. Sums by pair and the highest by A id follow, and each
block asks for its own pairs only. So what is shuffled is a pair once a block, not once a token.
"""

from __future__ import annotations

import functools
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, materialize, number_batches, string_column, texts
from .tokens import _STAND_IN
from .transducer import Merges, _Memo, encode

#: Bytes of text aligned at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: A group with more links than this is counted by distinct ids, not link by link.
MANY_LINKS = 4096
#: Rows of the look-up handed on at once.
ROWS = 65_536

BLOCKS = "block long, codes binary, held binary, rows binary, pairs binary, times binary, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>"


class Pieces:
    """A sentencepiece file and the bytes of each of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(self.library.id_to_piece(i)[3:5], 16)]) if self.library.is_byte(i) else self.library.id_to_piece(i).replace("▁", " ").encode() for i in range(self.library.get_piece_size())]
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.decimal = [str(i) for i in range(len(self.bytes))]

    def encode(self, text: list[str]) -> list[list[int]]:
        return self.library.encode(text, num_threads=1)


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@functools.lru_cache(maxsize=2)
def byte_merges(path: str) -> Merges:
    """The merge list, whose library merges the pre-tokens that are not kept yet."""
    m = Merges(path)
    tokenize = m.library.model.tokenize
    m.memo = _Memo(lambda data: [t.id for t in tokenize(data.decode("latin-1").translate(_STAND_IN))])
    return m


@functools.lru_cache(maxsize=2)
def _lengths(path: str) -> np.ndarray:
    return np.array([len(b) for b in byte_merges(path).bytes], np.int64)


@functools.lru_cache(maxsize=2)
def _signed(ids: int) -> np.ndarray:
    """Decimal ids followed by a comma, then all followed by a bar, then by a semicolon; shorter ones end with zero bytes."""
    return np.array([f"{i}{sign}".encode() for sign in ",|;" for i in range(ids)])


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))


def _segments(total: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Sums of segments from running sums with a leading zero; ``stops`` are the segments' ends, in order."""
    return np.diff(total[stops], prepend=0)


def _running(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x)])


def align(text: list[str], m: Merges, lengths: np.ndarray, p: Pieces) -> tuple:
    """Of some texts: n_a, n_b, n_groups, n_links per text, the hash of each one's groups, and (document, pair code, times) of the links."""
    a = [list(chain.from_iterable(encode(m, " " + t, special=False))) if t else [] for t in text]
    b = p.encode(text) if text else []
    for d, t in enumerate(text):
        whole = (" " + t).encode() if t else b""
        if b"".join(map(m.bytes.__getitem__, a[d])) != whole or b"".join(map(p.bytes.__getitem__, b[d])) != whole:
            a[d], b[d] = [], []
    n_a, n_b = np.array([*map(len, a)], np.int64), np.array([*map(len, b)], np.int64)
    ids_a, ids_b = _flat(a), _flat(b)
    end_a, end_b = np.cumsum(lengths[ids_a]), np.cumsum(p.length[ids_b])
    size = int(end_a[-1]) + 1 if len(end_a) else 1
    cuts = np.cumsum((np.bincount(end_a, minlength=size) > 0) & (np.bincount(end_b, minlength=size) > 0))
    group_a, group_b = cuts[end_a - 1], cuts[end_b - 1]
    groups = int(cuts[-1])
    in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    last = np.cumsum(n_a) - 1  # each text ends with a group
    ends = np.where(last >= 0, group_a[np.maximum(last, 0)] + 1, 0) if len(ids_a) else np.zeros(len(text), np.int64)
    ends = np.maximum.accumulate(ends) if len(ends) else ends
    n_groups, n_links = np.diff(ends, prepend=0), _segments(_running(in_a * in_b), ends)

    # the texts of groups: ids in order, A before B within a group, each with what follows it
    lead = _running(in_a + in_b)[:-1]
    first_a, first_b = _running(in_a)[:-1], _running(in_b)[:-1]
    tokens = np.empty(len(ids_a) + len(ids_b), np.int64)
    marks = np.zeros(len(tokens), np.int64)  # 0: comma, 1: bar, 2: semicolon
    tokens[lead[group_a] + np.arange(len(ids_a)) - first_a[group_a]] = ids_a
    tokens[lead[group_b] + in_a[group_b] + np.arange(len(ids_b)) - first_b[group_b]] = ids_b
    marks[lead + in_a - 1], marks[lead + in_a + in_b - 1] = 1, 2
    shas, at = [], 0
    ids = max(len(m.decimal), len(p.decimal))
    listed = _signed(ids)[tokens + marks * ids]
    for count in (n_a + n_b).tolist():
        if count:
            word = listed[at : at + count].tobytes().translate(None, b"\0")
            shas.append(hashlib.sha256(word[:-1]).hexdigest())
        else:
            shas.append("")
        at += count

    doc_a = np.repeat(np.arange(len(text)), n_a)
    small = in_a * in_b <= MANY_LINKS
    ours = np.flatnonzero(small[group_a])
    wide = in_b[group_a[ours]]
    left = np.repeat(ours, wide)
    place = np.arange(len(left)) - np.repeat(np.cumsum(wide) - wide, wide)
    docs, codes, times = [doc_a[left]], [ids_a[left] << 32 | ids_b[first_b[group_a[left]] + place]], [np.ones(len(left), np.int64)]
    for g in np.flatnonzero(~small).tolist():
        ua, ca = np.unique(ids_a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
        ub, cb = np.unique(ids_b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
        codes.append((ua[:, None] << 32 | ub[None, :]).ravel())
        times.append((ca[:, None] * cb[None, :]).ravel())
        docs.append(np.full(len(codes[-1]), doc_a[first_a[g]]))
    docs, codes, times = map(np.concatenate, (docs, codes, times))
    order = np.lexsort((codes, docs))
    docs, codes, times = docs[order], codes[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (codes[1:] != codes[:-1])])) if len(docs) else np.zeros(0, np.int64)
    times = np.add.reduceat(times, new) if len(new) else times
    return n_a, n_b, n_groups, n_links, shas, docs[new], codes[new], times


def _sliced(text: list[str]):
    """Ranges of texts of about ``SLICE_BYTES``."""
    low, size = 0, 0
    for k, t in enumerate(text):
        if k > low and size + len(t) > SLICE_BYTES:
            yield low, k
            low, size = k, 0
        size += len(t)
    if len(text) > low:
        yield low, len(text)


def _block(number: int, doc_ids: list, text: list[str], m: Merges, lengths: np.ndarray, p: Pieces) -> dict:
    facts, docs, codes, times = [[] for _ in range(5)], [], [], []
    for low, high in _sliced(text):
        *found, d, c, k = align(text[low:high], m, lengths, p)
        for column, values in zip(facts, found, strict=True):
            column.extend(values if isinstance(values, list) else values.tolist())
        docs.append(d + low)
        codes.append(c)
        times.append(k)
    docs, codes, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, codes, times))
    unique, inverse = np.unique(codes, return_inverse=True)
    times = times.astype(np.uint16) if not len(times) or times.max() < 1 << 16 else times
    return {
        "block": number, "codes": unique.astype("<i8").tobytes(), "held": np.bincount(inverse, minlength=len(unique)).astype("<u4").tobytes(),
        "rows": np.bincount(docs, minlength=len(text)).astype("<u4").tobytes(), "pairs": inverse.astype("<u4").tobytes(), "times": times.tobytes(),
        "doc_id": doc_ids, **dict(zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256"), facts, strict=True)),
    }


_BLOCK = pa.schema(
    [("block", pa.int64()), *((c, pa.binary()) for c in ("codes", "held", "rows", "pairs", "times"))]
    + [(c, pa.list_(pa.int64())) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", pa.list_(pa.string()))]
)


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each block of documents: facts of each document, and the block's linked id pairs."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        m, lengths, p = byte_merges(path_a), _lengths(path_a), pieces(path_b)
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            row = _block(part << 32 | k, batch.column(0).to_pylist(), string_column(batch.column(1)).to_pylist(), m, lengths, p)
            yield pa.RecordBatch.from_pylist([row], schema=_BLOCK)
        give_back()

    return texts(docs).mapInArrow(run, BLOCKS)


def _rows(stored: DataFrame, column: str) -> DataFrame:
    """The blocks' pairs as rows (block, place, code, held)."""

    def run(batches):
        for batch in batches:
            for block, codes, held in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                codes, held = np.frombuffer(codes.as_py(), "<i8"), np.frombuffer(held.as_py(), "<u4")
                for low in range(0, len(codes), ROWS):
                    part = codes[low : low + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block.as_py())), pa.array(np.arange(low, low + len(part))), pa.array(part), pa.array(held[low : low + ROWS].astype(np.int64))], names=["block", "place", "code", "held"])

    return stored.select("block", "codes", "held").mapInArrow(run, "block long, place long, code long, held long").select(*column.split())


def pair_counts(stored: DataFrame) -> DataFrame:
    """(code, count, best): in how many documents an id pair is linked, and whether that is its A id's highest.

    Summed before the shuffle; the window holds the pairs of one A id, which are as many as the other vocabulary has ids at most.
    """
    counts = _rows(stored, "code held").groupBy("code").agg(F.sum("held").alias("count"))
    w = Window.partitionBy(F.shiftright("code", 32))
    return counts.withColumn("best", F.col("count") == F.max("count").over(w))


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _answered(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents with what its pairs' counts add up to."""
    place = right.column("place").to_numpy()
    counts, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
    counts[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
    out = []
    for row in left.to_pylist():
        pairs, stops = np.frombuffer(row["pairs"], "<u4"), np.cumsum(np.frombuffer(row["rows"], "<u4").astype(np.int64))
        times = np.frombuffer(row["times"], "<u2" if len(row["times"]) == 2 * len(pairs) else "<i8").astype(np.int64)
        sums = [_segments(_running(times * x[pairs]), stops) for x in (best, counts)]
        columns = [pa.array(row["doc_id"], pa.int64()), *(pa.array(row[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), *map(pa.array, sums), pa.array(row["groups_sha256"], pa.string())]
        out.append(pa.table(columns, names=[c.split()[0] for c in _RESULT.split(", ")]))
    return pa.concat_tables(out) if out else pa.table([pa.array([], pa.string() if "sha" in c else pa.int64()) for c in _RESULT.split(", ")], names=[c.split()[0] for c in _RESULT.split(", ")])


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: tokens of both kinds, groups, links, links whose pair is its A id's most common, and the links' counts summed.

    Tokenizer A (byte-level merges) sees a space and the text, B (sentencepiece) the text; special tokens' strings are plain text.

    Defined results: null and empty texts, and texts whose tokens do not spell a space and the text, have no tokens: zeros and
    an empty hash; repeated rows are documents each; ties for an A id's highest count are all best; an empty table gives
    an empty one; other columns are ignored. A group without inner cuts is counted by distinct ids, so that no text makes
    all its pairs.
    """
    spark = docs.sparkSession
    stored = materialize(blocks(docs, path_a, path_b), "aligned")
    with number_batches(spark):
        counted = pair_counts(stored)
        asked = materialize(_rows(stored, "block place code").join(counted, "code").select("block", "place", "count", "best"), "pairs")
    whole = stored.drop("codes", "held").groupBy("block").cogroup(asked.groupBy("block"))
    return whole.applyInArrow(_answered, _RESULT)
