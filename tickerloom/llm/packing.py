"""Best-fit packing of documents into token sequences, under conflicts.

A bin holds ``capacity`` tokens and two bitmaps: the sources and the duplicate clusters it already
has. Open bins are ordered by residual. An item looks for the successor of its length among the
residuals and walks on until it meets a compatible bin, which is then the tightest one; if none is
left it opens a bin. Items go by decreasing length.

Items are dealt to shards by a hash, about ``SHARD_ROWS`` documents each, and every shard packs
alone: the work is linear in the corpus, and a task holds one shard's lengths, never texts. Equal
items are counted before they are dealt, and a count goes to shards in parts.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free, texts
from .components import salted
from .jaccard import links_and_roots
from .tokens import tokenizer

#: Tokens of a sequence.
CAPACITY = 2048
#: Documents a shard has in the mean.
SHARD_ROWS = 2048
#: n-gram width and similarity that make two documents near copies.
NEAR_WORDS = 5
NEAR_PERCENT = 80

PACKED = "doc_id long, piece long, start long, n_tokens long, shard long, bin long, offset long, bin_tokens long"


def best_fit(lengths, sources, clusters, capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and the tokens in each bin; items come in the order to pack them.

    Two items of one source, or of one duplicate cluster, never share a bin; None conflicts with nothing.
    """
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    cluster_bit = {c: 1 << i for i, c in enumerate(dict.fromkeys(c for c in clusters if c is not None))}
    residuals: list[tuple[int, int]] = []  # (residual, bin), ascending
    has_source, has_cluster, filled, bins, offsets = [], [], [], [], []
    for n, source, cluster in zip(lengths, sources, clusters, strict=True):
        s, c = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        i = bisect_left(residuals, (n, -1))
        while i < len(residuals) and (has_source[residuals[i][1]] & s or has_cluster[residuals[i][1]] & c):
            i += 1
        if i < len(residuals):
            b = residuals.pop(i)[1]
        else:
            b = len(filled)
            filled.append(0)
            has_source.append(0)
            has_cluster.append(0)
        bins.append(b)
        offsets.append(filled[b])
        filled[b] += n
        has_source[b] |= s
        has_cluster[b] |= c
        insort(residuals, (capacity - filled[b], b))
    return bins, offsets, filled


def pack(items: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pack rows of doc_id, n_tokens, source, cluster; one row per piece of a document.

    A document longer than ``capacity`` is cut: whole sequences, then a rest that is packed. Result:
    doc_id, piece (from 0), start (of the piece in the document), n_tokens (of the piece), shard,
    bin (within the shard), offset (in the bin), bin_tokens.

    Defined results: a null or negative length counts as 0; a document of no tokens is one piece of
    length 0; a null source or cluster conflicts with nothing; equal lengths go in the order of
    doc_id, then source and cluster; repeated rows are packed each (they share a source, so never a
    bin); an empty table gives an empty table; other columns are ignored. Rows of one doc_id, or
    without any, are dealt like others: equal rows go in parts of ``shard_rows``.
    """
    spark = items.sparkSession
    bounded_batches(spark)
    rows = items.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.lit(0)).alias("n_tokens"),
        F.col("source").cast("string").alias("source"),
        F.col("cluster").cast("long").alias("cluster"),
    )
    shards = max(1, -(-rows.count() // shard_rows))
    item = ["doc_id", "source", "cluster", "n_tokens"]
    counted = rows.groupBy(*item).agg(F.count("*").alias("copies"))
    parts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("copies") / shard_rows) - 1))
    dealt = counted.withColumn("part", parts).select(
        *item,
        F.least(F.lit(shard_rows), F.col("copies") - F.col("part") * shard_rows).alias("copies"),
        F.pmod(F.xxhash64(*item, "part"), F.lit(shards)).alias("shard"),
    )

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        table = table.sort_by([(c, "ascending") for c in item])
        table = table.take(pa.array(np.repeat(np.arange(len(table)), table["copies"].to_numpy())))
        done, base = [], 0
        # a shard swollen by parts of large counts is packed in parts, so that the search stays short
        for low in range(0, len(table), 4 * shard_rows):
            part = table.slice(low, 4 * shard_rows)
            n = part["n_tokens"].to_numpy()
            pieces = np.maximum(-(-n // capacity), 1)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.minimum(n[row] - piece * capacity, capacity)
            order = np.lexsort((piece, row, -length))
            sources, clusters = part["source"].to_pylist(), part["cluster"].to_pylist()
            bins, offsets, filled = best_fit(length[order].tolist(), [sources[r] for r in row[order]], [clusters[r] for r in row[order]], capacity)
            ids = part["doc_id"].take(pa.array(row[order]))
            done.append(pa.table({"doc_id": ids, "piece": piece[order], "start": piece[order] * capacity, "n_tokens": length[order], "shard": pa.array([shard] * len(order), pa.int64()), "bin": pa.array([base + b for b in bins], pa.int64()), "offset": pa.array(offsets, pa.int64()), "bin_tokens": pa.array([filled[b] for b in bins], pa.int64())}))
            base += len(filled)
        return pa.concat_tables(done)

    return dealt.groupBy("shard").applyInArrow(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pack whole documents (doc_id, text, source) by their token counts.

    The duplicate clusters are the components of the similarity join (``NEAR_WORDS`` words,
    ``NEAR_PERCENT``), so near copies, which may differ in case, white space or single words, never
    share a sequence. A text of white space alone clusters with equal texts; an empty or null text
    (0 tokens) has no cluster. ``pack`` takes any other clusters. Set keys, lengths and sources are
    written down once, then shuffled.
    """
    bounded_batches(docs.sparkSession)
    rows = texts(docs, "source").withColumn("blank", F.when(F.col("text") != "", F.xxhash64("text")))
    # one pass over the texts makes the sets, their index entries and the token counts
    classes, _, roots = links_and_roots(rows.select("doc_id", "text", "source", "blank"), NEAR_WORDS, NEAR_PERCENT, lambda: tokenizer(tokenizer_path).count_column)
    free()
    stored = classes.select("doc_id", "source", "blank", F.when(F.col("n") > 0, F.col("k")).alias("set_key"), "n_tokens")
    found = salted(stored, roots.withColumnRenamed("k", "set_key"), ["set_key"], "doc_id", "left")
    return pack(found.withColumn("cluster", F.coalesce("root", "set_key", "blank")), capacity, shard_rows)
