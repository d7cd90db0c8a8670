"""Exact Jaccard self-join of documents over word n-grams, by universe partition and pigeonhole.

A document is the set of hashes of its word n-grams. Sets are put in size bands; for a band, the
largest symmetric difference H of a pair at the similarity asked for follows from its greatest
size. The universe of hashes is cut into segments, each with a budget of 1 (its subset is indexed)
or 2 (so are the subset's one-deletion neighbours). Where the budgets add up to H + 1, two similar
sets agree in at least one index entry, because if every segment differed by its budget or more
the sets would differ by more than H; with H + 1 + g segments of budget 1 they agree in at least
g + 1. A set also makes entries for the bands above in which it may be the smaller side.

*Allocation by cost.* Short sets weigh one-deletion neighbours (more entries) against longer, more
selective segments at the corpus's own rate of repeated n-grams. Long sets take the slack g that
lets a set of which ``COVERED`` is text shared with many others (a licence, a quoted passage) have
no more than g segments filled by that text alone.

Entries with the same key form a bucket. They travel in blocks: a task sorts its entries by shard (a
range of the key hashes) and sends each shard one run of numbers, and a shard finds its buckets by
sorting. Of a bucket that is large in a task already, ``SMALL`` + 1 members go to the shard, which
then knows it as large, and the others go round it: no shard holds a hot bucket's members.

* Small buckets are compared pair by pair; a pair must meet in g + 1 buckets to go on.
* A set in no more than g large buckets leaves them: whatever it is similar to, it meets that in a
  small bucket too. The rest are verified against their bucket's least member, one candidate for
  each entry, however large the bucket.
* What goes on is checked against a sketch (counts of the hashes by range; their differences bound
  the symmetric difference from below), then exactly, on the sets.
* Large buckets that do not end up in one component are refined by a second, independent partition
  with more slack. What is open after that are sets near the bound of each other; they are compared
  in blocks, across components only, and only links leave a block.

So no link between components is lost, and no bucket whose members already hang together is
expanded into its pairs.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, free, give_back, materialize, number_batches, slices, small_plans, texts
from .components import components, salted
from .textops import chain, longs, mix, word_hashes

#: Members up to which a bucket is compared pair by pair.
SMALL = 16
#: Share of a set that may be text common to many without keeping it in large buckets.
COVERED = 0.6
#: Slack of the second partition, as a share of H + 1.
SLACK_AGAIN = 2.0
#: From this H on, bands take slack in place of deletions.
LONG = 8
#: n-grams of a block in the comparison of clusters.
BLOCK_ITEMS = 1 << 20
#: Pairs that one replica of a centre serves in verification.
CENTRE_PAIRS = 2000
#: Candidate keys that are broadcast (16 bytes each); beyond, texts are fetched by a join.
KEYS_BROADCAST = 500_000
#: One hash in so many is counted for the rate of repeated n-grams.
RATE_SAMPLE = 256
#: Cost of a collision, in index entries.
COLLISION = 40.0
#: Largest set whose second deletions are indexed where H is 2 (segments would be too short).
TINY = 16
#: Low bits of an entry that hold its band.
BAND_MASK = np.uint64(127)
#: Entries that a task deals out at once, and n-grams of the corpus for each shard of the index.
ENTRIES = 1 << 18
SHARD_GRAMS = 1 << 19


def bands(percent: int, limit: int) -> list[tuple[int, int]]:
    """Size bands (least, greatest) that cover sizes up to ``limit``."""
    out, low, ratio = [], 1, (percent / 100) ** -2.5
    while low <= limit:
        high = max(low, int(low * ratio))
        out.append((low, high))
        low = high + 1
    return out


@functools.lru_cache(maxsize=4096)
def allocation(low: int, high: int, percent: int, rate: float, again: bool = False) -> tuple[int, int, int, int]:
    """A band's segments: how many, how many of them (the first) have a deeper budget, that budget,
    and in how many buckets a similar pair meets at least."""
    h = 2 * high * (100 - percent) // (100 + percent)
    if h == 0:
        return 1, 0, 1, 1
    if h == 1:
        return 1, 1, 2, 1
    if h == 2 and high <= TINY:
        return 1, 1, 3, 1
    size = (low + high) / 2
    if h >= LONG:
        share = SLACK_AGAIN if again else 0.05
        while not again and share < SLACK_AGAIN:
            length = size / (h + 1) / (1 + share)
            if share / (1 + share) >= math.exp(-(1 - COVERED) * length) - math.exp(-length):
                break
            share += 0.05
        g = math.ceil(share * (h + 1))
        return h + 1 + g, 0, 1, g + 1
    best = None
    for deep in range((h + 1) // 2 + 1):
        m = h + 1 - deep
        each = size / m
        cost = m + deep * each + COLLISION * ((m - deep) * rate**each + deep * (1 + each) * rate ** max(each - 1, 0))
        if best is None or cost < best[0]:
            best = (cost, deep, m)
    _, deep, m = best
    return m, deep, 2, 1


@functools.lru_cache(maxsize=4096)
def schemes(n: int, percent: int) -> tuple[tuple[int, int, int], ...]:
    """(band number, least, greatest) of the bands in which a set of n makes entries."""
    found = []
    for number, (low, high) in enumerate(bands(percent, max(n * 100 // percent + 1, 1))):
        if high >= n and -(-percent * low // 100) <= n:
            found.append((number, low, high))
    return tuple(found)


def sets(column, width: int) -> list[np.ndarray]:
    """Each text's distinct n-grams, as sorted 64-bit hashes; a shorter text is one n-gram, an empty one none."""
    words, first = word_hashes(column)
    grams = chain(words, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            found = np.sort(grams[a : b - width + 1])
            new = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=new[1:])
            out.append(found[new])
        else:
            out.append(chain(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _elements(values: np.ndarray) -> np.ndarray:
    return mix(values + np.uint64(0x6A09E667F3BCC909))


def set_keys(values: np.ndarray) -> tuple[int, int]:
    """Two 64-bit fingerprints of a set (as signed integers)."""
    e = _elements(values)
    return int(mix(e.sum(keepdims=True)).view(np.int64)[0]), int(mix(mix(e).sum(keepdims=True) + np.uint64(len(values))).view(np.int64)[0])


def _sums(x: np.ndarray) -> np.ndarray:
    """Running sums, from 0 on."""
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return total


def keyed(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two fingerprints of each set, as ``set_keys`` gives them, and the running sums of the elements of all."""
    edges = np.cumsum([0, *map(len, found)])
    e = _elements(np.concatenate([np.zeros(0, np.uint64), *found]))
    total, again = _sums(e), _sums(mix(e))
    k = mix(total[edges[1:]] - total[edges[:-1]])
    k2 = mix(again[edges[1:]] - again[edges[:-1]] + np.diff(edges).astype(np.uint64))
    return k.view(np.int64), k2.view(np.int64), total


@functools.lru_cache(maxsize=256)
def _salt(m: int, number: int, level: int) -> np.ndarray:
    return mix(np.arange(m, dtype=np.uint64) + np.uint64((number << 40) + (level << 32)))


@functools.lru_cache(maxsize=4096)
def _kind(n: int, percent: int) -> tuple[bool, bool]:
    """Whether the entries of a set of n depend on the corpus's rate of repeated n-grams; whether all its bands are long."""
    h = [(2 * high * (100 - percent) // (100 + percent), high) for _, _, high in schemes(n, percent)]
    return any(2 < x < LONG or x == 2 and high > TINY for x, high in h), all(x >= LONG for x, _ in h)


def signatures(values: np.ndarray, percent: int, rate: float, level: int = 0, voids: list | None = None) -> np.ndarray:
    """All index entries of a set under partition ``level`` (0 or 1); the low bits of each are its band.

    With ``voids``, segments of long bands in which the set has no n-gram make no entries: all sets that
    have none there would meet in one bucket. Their number is appended instead, as (tag, number), for
    each band.
    """
    if level:
        values = np.sort(mix(values + np.uint64(level * 0x632BE59BD9B4E019 & (1 << 64) - 1)))
    elements = _elements(values)
    total = _sums(elements)
    _bands_checked(percent, len(values))
    high = values >> np.uint64(32)
    out = []
    for number, low, top in schemes(len(values), percent):
        m, deep, budget, need = allocation(low, top, percent, rate, level > 0)
        # a segment is a range of the hashes, so a run of the sorted set
        edges = np.searchsorted(high * np.uint64(m) >> np.uint64(32), np.arange(m + 1, dtype=np.uint64))
        sums, salt = total[edges[1:]] - total[edges[:-1]], _salt(m, number, level)
        if voids is not None and need > 1:
            filled = edges[1:] > edges[:-1]
            empty = m - int(np.count_nonzero(filled))
            if empty:
                voids.append(((number << 32) + need, min(empty, need)))
                sums, salt = sums[filled], salt[filled]
        found = [mix(sums + salt)]
        if deep:
            members = np.arange(edges[deep])
            of = np.repeat(np.arange(deep), np.diff(edges[: deep + 1]))
            found.append(mix(sums[of] - elements[members] + salt[of]))
            if budget == 3:
                pairs = np.array(list(itertools.combinations(range(len(values)), 2)), np.int64).reshape(-1, 2)
                found.append(mix(sums[0] - elements[pairs[:, 0]] - elements[pairs[:, 1]] + salt[0]))
            found = [np.unique(np.concatenate(found))]
        out.append(found[0] & ~BAND_MASK | np.uint64(number))
    return np.concatenate(out)


def _long_entries(values: np.ndarray, total: np.ndarray, edges: np.ndarray, rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
    """``signatures`` with ``voids`` for many sets whose bands are all long: (entries, number of them by row, voids by row).

    ``values``, ``total``: the sets' n-grams and running sums of their elements; ``edges``: where each set lies; ``rows``: which are meant.
    """
    by_band: dict[tuple[int, int, int], list[int]] = {}
    for i, n in enumerate((edges[rows + 1] - edges[rows]).tolist()):
        _bands_checked(percent, n)
        for band in schemes(n, percent):
            by_band.setdefault(band, []).append(i)
    voids: list[list[tuple[int, int]]] = [[] for _ in rows]
    sigs, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for (number, low, top), of in sorted(by_band.items()):
        m, _, _, need = allocation(low, top, percent, 0.0)
        a, n = edges[rows[of]], edges[rows[of] + 1] - edges[rows[of]]
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(a - first, n)
        segment = ((values[at] >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64) + np.repeat(np.arange(len(of)) * m, n)
        counts = np.bincount(segment, minlength=len(of) * m)
        filled = np.flatnonzero(counts)
        stop = np.cumsum(counts)[filled] + (a - first)[filled // m]
        sums = total[stop] - total[stop - counts[filled]]
        sigs.append(mix(sums + _salt(m, number, 0)[filled % m]) & ~BAND_MASK | np.uint64(number))
        owners.append(np.asarray(of)[filled // m])
        for i, empty in zip(of, (m - np.bincount(filled // m, minlength=len(of))).tolist(), strict=True):
            if empty:
                voids[i].append(((number << 32) + need, min(empty, need)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(sigs)[order], np.bincount(owner, minlength=len(rows)), voids


def _bands_checked(percent: int, n: int) -> None:
    """Entries have room for so many bands; a set beyond them would share none."""
    last = schemes(n, percent)[-1][0]
    if last > int(BAND_MASK):
        raise ValueError(f"sets of {n} n-grams at {percent} % need {last + 1} size bands; {int(BAND_MASK) + 1} are there")


def needs(percent: int, rate: float, level: int = 0) -> np.ndarray:
    """For each band, in how many buckets a similar pair meets at least."""
    all_bands = bands(percent, 1 << 40)[: int(BAND_MASK) + 1]
    return np.array([allocation(low, high, percent, rate, level > 0)[3] for low, high in all_bands], np.int64)


def sketch(values: np.ndarray) -> bytes:
    """Counts of a set's hashes in ranges, about three hashes to a range; a power of two of ranges."""
    bits = max(3, (len(values) // 3).bit_length())
    return np.bincount((values >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype("<u2").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, from their sketches."""
    x, y = (np.frombuffer(s, "<u2").astype(np.int64) for s in (a, b))
    while len(x) > len(y):
        x = x.reshape(-1, 2).sum(1)
    while len(y) > len(x):
        y = y.reshape(-1, 2).sum(1)
    return int(np.abs(x - y).sum())


#: Columns of a set's index entries: those that do not depend on the rate, else the set itself; and its empty segments by band.
SIGNED = "sigs binary, items binary, tags array<long>, voids array<long>"


def _signed(rows: list[tuple | None]) -> list[pa.Array]:
    """The columns ``SIGNED`` of (sigs, items, voids) or None."""
    sigs, items, voids = zip(*((r or (None, None, ())) for r in rows), strict=True) if rows else ((), (), ())
    lists = [pa.array([[x[i] for x in v] for v in voids], pa.list_(pa.int64())) for i in (0, 1)]
    return [pa.array(sigs, pa.binary()), pa.array(items, pa.binary()), *lists]


def _classes(docs: DataFrame, width: int, percent: int, counter=None) -> DataFrame:
    """Per document: fingerprints, size and sketch of its set, its share of the counted hashes, and index entries.

    Equal sets of one task make entries once. Further columns of ``docs`` (doc_id, text, ...) are kept; where
    ``counter`` is given, which makes a function of a column of texts, its numbers are the column ``n_tokens``.
    """
    more = docs.schema.fields[2:]
    schema = ", ".join(["doc_id long, k long, k2 long, n long, counted array<long>, sketch binary", SIGNED, *(f"{f.name} {f.dataType.simpleString()}" for f in more), *["n_tokens long"] * (counter is not None)])
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        seen: set[int] = set()
        count = counter() if counter else None
        for batch in slices(batches):
            found = sets(batch.column(1), width)
            k, k2, total = keyed(found)
            signed: list[tuple | None] = [None] * len(found)
            long = []
            for i, (v, key) in enumerate(zip(found, k.tolist(), strict=True)):
                if not len(v) or key in seen:
                    continue
                seen.add(key)
                by_rate, all_long = _kind(len(v), percent)
                if all_long:
                    long.append(i)
                    continue
                voids: list = []
                sig = signatures(v, percent, 0.0, 0, voids)
                signed[i] = (None, v.tobytes(), voids) if by_rate else (sig.tobytes(), None, voids)
            if long:
                sig, counts, empty = _long_entries(np.concatenate(found), total, np.cumsum([0, *map(len, found)]), np.array(long), percent)
                stop = np.cumsum(counts).tolist()
                for i, low, high, voids in zip(long, [0, *stop[:-1]], stop, empty, strict=True):
                    signed[i] = (sig[low:high].tobytes(), None, voids)
            counted = [v[: np.searchsorted(v, np.uint64((1 << 64) // RATE_SAMPLE))].view(np.int64) for v in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(k), pa.array(k2), pa.array([len(v) for v in found], pa.int64()), pa.array(counted, pa.list_(pa.int64())), pa.array([sketch(v) for v in found], pa.binary()), *_signed(signed)]
                + batch.columns[2:]
                + ([pa.array(count(batch.column(1)), pa.int64())] if count else []),
                names=names,
            )
        give_back()

    return materialize(docs.mapInArrow(run, schema), "jaccard-classes")


def with_set_key(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` with ``set_key``: the fingerprint (k) of each text's set, null where the set is empty."""
    schema = T.StructType([*docs.schema.fields, T.StructField("set_key", T.LongType())])

    def run(batches):
        for batch in slices(batches):
            found = sets(batch.column(batch.schema.names.index("text")), width)
            keys = pa.array([set_keys(v)[0] if len(v) else None for v in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, "set_key"])

    return docs.mapInArrow(run, schema)


def _rate(classes: DataFrame) -> float:
    """Share of n-gram occurrences (one in RATE_SAMPLE hashes counted) that other sets have too, copies aside."""
    counts = classes.select("k", F.explode("counted").alias("v")).distinct().groupBy("v").count()
    row = counts.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("count") > 1, F.col("count"))).alias("again")).first()
    return round((row.again or 0) / row.n, 2) if row.n else 0.0


def _pairs_within(sig: np.ndarray, k: np.ndarray, band: np.ndarray) -> np.ndarray:
    """All (k, k', band) within runs of equal ``sig``, none longer than SMALL."""
    starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    sizes = np.diff(np.r_[starts, len(sig)])
    found = [np.zeros((0, 3), np.int64)]
    for n in range(2, SMALL + 1):
        rows = starts[sizes == n][:, None] + np.arange(n)
        i, j = np.triu_indices(n, 1)
        if len(rows):
            found.append(np.stack([k[rows[:, i]].ravel(), k[rows[:, j]].ravel(), band[rows[:, i]].ravel()], 1))
    return np.concatenate(found)


def _deal(sig: np.ndarray, k: np.ndarray, shards: int, spare: int) -> pa.RecordBatch:
    """Entries as rows (shard, sigs, ks); of a bucket with more than SMALL + 1 members here the rest goes to row -1 - ``spare``."""
    shard = ((sig.view(np.uint64) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    cells = max(1 << 12, 1 << len(sig).bit_length())
    cell = (sig >> 7) & (cells - 1)
    heavy = np.flatnonzero(np.bincount(cell, minlength=cells)[cell] > SMALL)
    if len(heavy):
        order = heavy[np.lexsort((k[heavy], sig[heavy]))]
        new = np.r_[True, sig[order][1:] != sig[order][:-1]]
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        shard[order[place > SMALL]] = -1 - spare
    order = np.argsort(shard.astype(np.int16) if shards < 1 << 15 else shard, kind="stable")  # short numbers are sorted by digits
    dealt = shard[order]
    first = np.flatnonzero(np.r_[True, dealt[1:] != dealt[:-1]][: len(dealt)])
    names = dealt[first]
    offsets = pa.array(np.r_[first, len(order)] * 8, pa.int32()).buffers()[1]
    packed = [pa.Array.from_buffers(pa.binary(), len(names), [None, offsets, pa.py_buffer(np.ascontiguousarray(x[order]).tobytes())]) for x in (sig, k)]
    return pa.RecordBatch.from_arrays([pa.array(names), *packed], names=["shard", "sigs", "ks"])


def _meet(sig: np.ndarray, k: np.ndarray, aside: bool, need: np.ndarray) -> pa.Table:
    """Pairs in small buckets of (sig, k) and members of large ones; with ``aside``, all are known to be in large ones.

    Output (kind, x, y, tag, n): kind 0 is a pair (x, y) met in n buckets of a band, kind 1 the member y of
    bucket x; a tag holds the band and the number of buckets that a similar pair must share in it. Equal
    entries count once.
    """

    def out(kind, x, y, band, n):
        return pa.table({"kind": pa.array(np.full(len(x), kind, np.int8)), "x": x, "y": y, "tag": (band << 32) + need[band], "n": n})

    order = np.argsort(sig)
    met = np.zeros(len(order), bool)
    same = sig[order][1:] == sig[order][:-1]
    met[1:] = same
    met[:-1] |= same  # entries alone in their bucket need no further look
    rows = order if aside else order[met]
    rows = rows[np.lexsort((k[rows], sig[rows]))]
    sig, k = sig[rows], k[rows]
    once = np.r_[True, (sig[1:] != sig[:-1]) | (k[1:] != k[:-1])][: len(sig)]
    sig, k = sig[once], k[once]
    band = sig & np.int64(BAND_MASK)
    starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]][: len(sig)])
    large = np.repeat(np.diff(np.r_[starts, len(sig)]) > SMALL, np.diff(np.r_[starts, len(sig)])) | aside
    members = out(1, sig[large], k[large], band[large], np.ones(int(large.sum()), np.int64))
    pairs = _pairs_within(sig[~large], k[~large], band[~large])
    if not len(pairs):
        return members
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0], pairs[:, 2]))]
    new = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]).any(1)])
    x, y, of = (np.ascontiguousarray(c) for c in pairs[new].T)
    return pa.concat_tables([members, out(0, x, y, of, np.diff(np.r_[new, len(pairs)]))])


def _candidates(signed: DataFrame, percent: int, rate: float, shards: int, level: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(pairs to verify: a, b; members of large buckets: sig, k) from sets' entries (k and the columns ``SIGNED``).

    The empty segments that a set shares with others of its band count as large buckets it is in; where they
    matter, they are one bucket a band.
    """
    need_of = needs(percent, rate, level)

    def run(table: pa.Table) -> pa.Table:
        sig, k = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table[c]]) for c in ("sigs", "ks"))
        return _meet(sig, k, table["shard"][0].as_py() < 0, need_of)

    spark = signed.sparkSession
    entries = _entries(signed, percent, rate, shards, level)
    with number_batches(spark):
        met = materialize(entries.groupBy("shard").applyInArrow(run, "kind byte, x long, y long, tag long, n long"), f"{name}-meetings")
    del entries
    free()  # the entries are most of what is on disk
    voids = signed.where("size(tags) > 0").select("k", F.explode(F.arrays_zip("tags", "voids")).alias("v")).select("k", F.col("v.tags").alias("tag"), F.col("v.voids").alias("e"))
    need = F.col("tag").bitwiseAND((1 << 32) - 1)
    with small_plans(spark):
        hot = met.where("kind = 1").select(F.col("x").alias("sig"), F.col("y").alias("k"), "tag").distinct()
        both = hot.select("k", "tag", F.lit(1).cast("long").alias("h"), F.lit(0).cast("long").alias("e")).unionAll(voids.select("k", "tag", F.lit(0).cast("long").alias("h"), "e"))
        inside = materialize(both.groupBy("k", "tag").agg((F.sum("h") + F.max("e")).alias("z")), f"{name}-inside", few=True)
        staying = inside.where(F.col("z") >= need).select("k", "tag")
        hot = hot.unionAll(voids.select(F.xxhash64("tag").alias("sig"), "k", "tag").distinct())
        hot = materialize(hot.join(staying, ["k", "tag"], "left_semi").select("sig", "k"), f"{name}-large", few=True)
    pairs = met.where("kind = 0").groupBy(F.col("x").alias("a"), F.col("y").alias("b"), "tag").agg(F.sum("n").alias("n"))
    # what meets in one bucket of a band that asks for more can only reach it in large buckets
    za, zb = (inside.select(F.col("k").alias(c), "tag", F.col("z").alias(f"z{c}")) for c in "ab")
    both = F.least(F.coalesce("za", F.lit(0)), F.coalesce("zb", F.lit(0)))
    enough = pairs.join(za, ["a", "tag"], "left").join(zb, ["b", "tag"], "left").where(F.col("n") + both >= need)
    centres = hot.groupBy("sig").agg(F.min("k").alias("a"))
    stars = _matched(hot.select("sig", "k"), centres).where("value <> found").select(F.col("found").alias("a"), F.col("value").alias("b"))
    found = enough.select("a", "b").unionAll(stars).distinct()
    return materialize(found, f"{name}-candidates"), hot


def _dealt(held: list[tuple[np.ndarray, np.ndarray]], shards: int) -> pa.RecordBatch:
    sig, k = (np.concatenate(side) for side in zip(*held, strict=True))
    return _deal(sig.view(np.int64), k, shards, int(k[0]) % shards)


def _entries(signed: DataFrame, percent: int, rate: float, shards: int, level: int) -> DataFrame:
    """Dealt entries of sets; those that depend on the rate are made here."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for k, sigs, items in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if sigs.is_valid:
                    sig = np.frombuffer(sigs.as_buffer(), np.uint64)
                else:
                    sig = signatures(np.frombuffer(items.as_buffer(), np.uint64), percent, rate, level, [])
                held.append((sig, np.full(len(sig), k)))
                size += len(sig)
            if size >= ENTRIES:
                yield _dealt(held, shards)
                held, size = [], 0
        if held:
            yield _dealt(held, shards)
        give_back()

    return signed.where("sigs is not null or items is not null").select("k", "sigs", "items").mapInArrow(run, "shard long, sigs binary, ks binary")


def _signed_again(stored: DataFrame, percent: int, rate: float) -> DataFrame:
    """Entries of stored sets (k, items) under the second partition."""

    def run(batches):
        for batch in batches:
            rows = []
            for items in batch.column(1):
                voids: list = []
                rows.append((signatures(np.frombuffer(items.as_buffer(), np.uint64), percent, rate, 1, voids).tobytes(), None, voids))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_signed(rows)], names=["k", "sigs", "items", "tags", "voids"])

    return materialize(stored.select("k", "items").mapInArrow(run, f"k long, {SIGNED}"), "jaccard-again")


def _likely(pairs: DataFrame, kinds: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and sketches (columns n and sketch of ``kinds``, by k) do not rule out."""
    sides = [kinds.select(F.col("k").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab"]
    rows = pairs.join(sides[0], "a").join(sides[1], "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    def run(batches):
        for batch in batches:
            a, b, na, nb, sa, sb = (batch.column(i) for i in range(6))
            bound = ((na.to_numpy() + nb.to_numpy()) * (100 - percent)) // (100 + percent)
            keep = [least_difference(x.as_py(), y.as_py()) <= h for x, y, h in zip(sa, sb, bound.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = rows.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")
    with small_plans(pairs.sparkSession):
        return materialize(found.distinct(), "jaccard-likely")


def _paired(rep: np.ndarray, k: np.ndarray) -> np.ndarray:
    """One number for a document and a set key."""
    return mix(np.asarray(rep, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(k, np.int64).view(np.uint64))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _texts_of(docs: DataFrame, kinds: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """(k, n, items) of the sets with the given keys, each from its document with the least id."""
    spark = docs.sparkSession
    chosen = materialize(kinds.join(keys, "k", "left_semi").select("k", "rep"), "jaccard-reps")
    rows = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("rep"), "text")
    shared = None
    if chosen.count() <= KEYS_BROADCAST:
        rows = rows.join(F.broadcast(chosen.select("rep").distinct()), "rep", "left_semi")
        table = chosen.toArrow()
        rep, k = table["rep"].to_numpy(), table["k"].to_numpy()
        shared = spark.sparkContext.broadcast(np.unique(_paired(rep, k)))
    else:
        rows = rows.join(chosen.select("rep").distinct(), "rep", "left_semi")

    def run(batches):
        for batch in slices(batches):
            out = []
            found = sets(batch.column(1), width)
            keys = keyed(found)[0]
            wanted = np.ones(len(found), bool) if shared is None else _among(_paired(batch.column(0).to_numpy(), keys), shared.value)
            for k, v, chosen_ in zip(keys.tolist(), found, wanted, strict=True):
                if len(v) and chosen_:
                    out.append((k, len(v), v.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["k", "n", "items"])
        give_back()

    found = rows.mapInArrow(run, "k long, n long, items binary")
    if shared is None:
        found = found.join(keys, "k", "left_semi").dropDuplicates(["k"])
    found = materialize(found, "jaccard-sets")
    if shared is not None:
        shared.unpersist()
    return found


def _verify(fits: DataFrame, stored: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by exact intersection.

    Sets travel to the centre a, whose own set is sent once for each CENTRE_PAIRS of its pairs.
    """
    replicas = fits.groupBy("a").agg((1 + F.floor(F.count("*") / CENTRE_PAIRS)).cast("long").alias("copies"))
    dealt = fits.join(replicas, "a").select("a", F.pmod(F.xxhash64("b"), F.col("copies")).alias("copy"), "b")
    sides = dealt.join(stored.select(F.col("k").alias("b"), "items"), "b").select("a", "copy", F.lit(1).alias("side"), "b", "items")
    centres = replicas.join(stored.select(F.col("k").alias("a"), "items"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("b"), "items")

    def run(batches):
        key, centre = None, None
        for batch in batches:
            found = []
            for a, copy, side, b, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                other = np.frombuffer(items, np.uint64)
                if side == 0:
                    key, centre = (a, copy), other
                    continue
                if key != (a, copy):
                    raise RuntimeError("a candidate came without its centre")
                small, large = (centre, other) if len(centre) <= len(other) else (other, centre)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                if 100 * both >= percent * (len(small) + len(large) - both):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    together = centres.unionAll(sides).repartition("a", "copy").sortWithinPartitions("a", "copy", "side")
    with small_plans(fits.sparkSession):
        return materialize(together.mapInArrow(run, "a long, b long").distinct(), "jaccard-links")


def _matched(rows: DataFrame, table: DataFrame, known_only: bool = False) -> DataFrame:
    """Different (value, found) of ``rows`` (key, value) looked up in ``table`` (one row a key: key, found).

    A key without a row finds itself, or with ``known_only`` nothing.

    A member of a large bucket has a row for each of its buckets, most of which find the same; so rows travel
    packed, each pack meets its part of the table, and only what differs within a pack comes out.
    """
    spark = rows.sparkSession
    parts = max(1, -(-rows.count() // SHARD_GRAMS))
    names = "part int, keys binary, numbers binary"

    def packed(keys, numbers, part):
        for p in np.unique(part).tolist():
            of = part == p
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x[of].tobytes()], pa.binary()) for x in (keys, numbers))], names=["part", "keys", "numbers"])

    def pack(batches):
        held, size = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append([c.to_numpy() for c in batch.columns])
                size += len(batch)
            if held and (size >= ENTRIES or batch is None):
                yield from packed(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, size = [], 0

    def look_up(batches):
        for batch in batches:
            for keys, numbers, known, found in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                keys, numbers, known, found = (np.frombuffer(x or b"", np.int64) for x in (keys, numbers, known, found))
                order = np.argsort(known)
                known, found, out = known[order], found[order], keys.copy()
                if len(known):
                    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    same = known[at] == keys
                    out = np.where(same, found[at], keys)
                if known_only:
                    same = same if len(known) else np.zeros(len(keys), bool)
                    numbers, out = numbers[same], out[same]
                order = np.lexsort((out, numbers))
                numbers, out = numbers[order], out[order]
                new = np.r_[True, (numbers[1:] != numbers[:-1]) | (out[1:] != out[:-1])][: len(out)]
                yield pa.RecordBatch.from_arrays([pa.array(numbers[new]), pa.array(out[new])], names=["value", "found"])

    def dealt(df):
        key, number = df.columns
        return df.select(key, number, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")).mapInArrow(pack, names)

    def whole(group: pa.Table) -> pa.Table:
        return pa.table({"part": group["part"][:1], **{c: pa.array([b"".join(x.as_py() for x in group[c])], pa.binary()) for c in ("keys", "numbers")}})

    known = dealt(table).groupBy("part").applyInArrow(whole, names).select("part", F.col("keys").alias("known"), F.col("numbers").alias("found"))
    # packs are dealt out anew, so that packing and looking up do not run in one task
    met = dealt(rows).repartition(F.xxhash64("keys")).join(known, "part", "left").select("part", "keys", "numbers", "known", "found")
    with number_batches(spark):
        return materialize(met.mapInArrow(look_up, "value long, found long"), "jaccard-matched").distinct()


def _mixed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The large buckets of ``rows`` (sig, k) that still hold several components."""
    with small_plans(rows.sparkSession):
        held = _matched(rows.select("k", "sig"), roots.select("k", "root"))
        ends = held.groupBy(F.col("value").alias("sig")).agg(F.min("found").alias("low"), F.max("found").alias("high"))
        return materialize(ends.where("low < high").select("sig"), "jaccard-mixed", few=True)


def _members(rows: DataFrame, mixed: DataFrame) -> DataFrame:
    """The different members (k) of the buckets ``mixed``."""
    with small_plans(rows.sparkSession):
        found = _matched(rows.select("sig", "k"), mixed.select("sig", F.lit(0).cast("long").alias("found")), known_only=True)
        return materialize(found.select(F.col("value").alias("k")).distinct(), "jaccard-members", few=True)


def _open(rows: DataFrame, mixed: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (k, root) of the buckets ``mixed``, each with the least member (a) of every such bucket it is in.

    Copies share hundreds of buckets and mostly one least member, so the rows stay near the number of
    members instead of that of index entries.
    """
    with small_plans(rows.sparkSession):
        least = rows.groupBy("sig").agg(F.min("k").alias("found")).join(mixed, "sig", "left_semi")
        met = _matched(rows.select("sig", "k"), least, known_only=True).select(F.col("found").alias("a"), F.col("value").alias("k"))
        members = materialize(met, "jaccard-members", few=True)
        return materialize(members.join(roots, "k", "left").select("a", "k", F.coalesce("root", "k").alias("root")), "jaccard-open", few=True)


def _links_between(left: pa.Table, right: pa.Table | None, percent: int) -> list[tuple[int, int]]:
    """Links across components between two blocks of sets (or, without ``right``, within one).

    Sketches rule out most pairs; the rest are intersected, unless a link found before has already
    joined their components. So no more links come out than members went in.
    """

    def side(table):
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["items"]]
        sketches = [np.frombuffer(sketch(x), "<u2").astype(np.int32) for x in items]
        return table["k"].to_pylist(), table["root"].to_pylist(), np.array([len(x) for x in items]), np.array([len(x) for x in sketches]), sketches, items

    ours = side(left)
    theirs = ours if right is None else side(right)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    found = []
    for level in np.unique(ours[3]).tolist():
        for other in (level // 2, level, level * 2):  # sets of similar sizes have sketches within one halving
            columns = np.flatnonzero(theirs[3] == other)
            if not len(columns):
                continue
            width = min(level, other)
            matrix = np.stack([theirs[4][j].reshape(width, -1).sum(1) for j in columns])
            n = theirs[2][columns]
            for i in np.flatnonzero(ours[3] == level).tolist():
                mine = ours[2][i]
                near = (np.abs(matrix - ours[4][i].reshape(width, -1).sum(1)).sum(1) <= (n + mine) * (100 - percent) // (100 + percent)) & (100 * np.minimum(n, mine) >= percent * np.maximum(n, mine))
                for j in columns[near].tolist():
                    if right is None and j <= i:
                        continue
                    a, b = find(ours[1][i]), find(theirs[1][j])
                    if a != b:
                        both = len(np.intersect1d(ours[5][i], theirs[5][j], assume_unique=True))
                        if 100 * both >= percent * (mine + theirs[2][j] - both):
                            parent[max(a, b)] = min(a, b)
                            found.append((ours[0][i], theirs[0][j]))
    return found


def _in_blocks(rows: DataFrame, stored: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across components of the clusters that ``rows`` (a, k, root) form.

    A cluster is what hangs together by shared buckets, that is, by their least members. Its members are dealt to blocks by a hash,
    about BLOCK_ITEMS n-grams to each, and each pair of blocks is one group: no group grows with the
    cluster, and only links leave it.
    """
    clusters = components(rows.select("a", F.col("k").alias("b")), "jaccard-clusters").withColumnRenamed("root", "cluster")
    members = rows.select("k", "root").distinct().join(clusters, "k").join(stored, "k")
    sizes = members.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_ITEMS).cast("int").alias("blocks"))
    dealt = members.join(sizes, "cluster").withColumn("i", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = dealt.select("k", "root", "items", "cluster", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), (F.col("i") <= F.col("j")).alias("first"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        same = table["lo"][0].as_py() == table["hi"][0].as_py()
        first = table.filter(table["first"])
        found = _links_between(first, None if same else table.filter(pc.invert(table["first"])), percent)
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    with small_plans(rows.sparkSession):
        return materialize(placed.groupBy("cluster", "lo", "hi").applyInArrow(run, "a long, b long"), "jaccard-more")


def links_and_roots(docs: DataFrame, width: int, percent: int, counter=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, links between classes, roots): enough links to give every component of the join.

    ``docs`` (doc_id, text, ...) and ``counter`` are those of ``_classes``, which tells what ``classes`` has.
    """
    free()
    classes = _classes(docs, width, percent, counter)
    rate = _rate(classes)
    kinds = classes.where("n > 0").groupBy("k").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    kinds = materialize(kinds, "jaccard-kinds")
    shards = max(1, -(-(kinds.agg(F.sum("n")).first()[0] or 0) // SHARD_GRAMS))
    free()
    tried, large = _candidates(classes, percent, rate, shards, 0, "jaccard")
    free()
    fits = _likely(tried, kinds, percent)
    keys = fits.select(F.col("a").alias("k")).unionAll(fits.select(F.col("b").alias("k"))).unionAll(large.select("k")).distinct()
    stored = _texts_of(docs, kinds, keys, width)
    links = _verify(fits, stored, percent)
    free()
    roots = components(links, "jaccard-roots")

    def verified(pairs: DataFrame):
        """Pairs not tried before are; links and roots follow."""
        nonlocal tried, links, roots
        turned = tried.select(F.col("a").alias("b"), F.col("b").alias("a"))
        new = materialize(pairs.join(tried, ["a", "b"], "left_anti").join(turned, ["a", "b"], "left_anti"), "jaccard-new")
        if new.isEmpty():
            return
        more = _verify(_likely(new, kinds, percent), stored, percent)
        tried = materialize(tried.unionAll(new), "jaccard-tried")
        if not more.isEmpty():
            links = materialize(links.unionAll(more), "jaccard-links")
            roots = components(links, "jaccard-roots")

    mixed = _mixed(large, roots)
    if not mixed.isEmpty():
        again = stored.join(_members(large, mixed), "k", "left_semi")
        pairs, large = _candidates(_signed_again(again, percent, rate), percent, rate, shards, 1, "jaccard-again")
        verified(pairs)
        mixed = _mixed(large, roots)
    if not mixed.isEmpty():
        rows = _open(large, mixed, roots)
        # near the bound even two partitions leave doubt: the sets of a cluster are compared, in blocks
        more = _in_blocks(rows, stored, percent)
        if not more.isEmpty():
            links = materialize(links.unionAll(more), "jaccard-links")
            roots = components(links, "jaccard-roots")
    return classes, links, roots


def similarity_classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document (doc_id, text): doc_id, n_shingles, component_id and n_links.

    Two documents link when 100 * |A and B| >= percent * |A or B| over their sets of ``width``-word
    n-grams; component_id is the least doc_id reachable by links. Words are runs of characters
    other than space and 0x09-0x0D, A-Z folded; fewer than ``width`` words are one n-gram.
    n_links counts the verified links of the document's text kept for connectivity.

    n-grams are compared by 64-bit hash. Defined results: a text that is null, empty or without
    words has an empty set, links with nothing and is its own component; equal texts link; repeated
    rows are each returned; rows with a null doc_id take part, the least id being null only where
    all are; an empty table gives an empty table; texts are read whole; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = texts(docs)
    classes, links, roots = links_and_roots(rows, width, percent)
    both = links.select(F.col("a").alias("k")).unionAll(links.select(F.col("b").alias("k"))).groupBy("k").agg(F.count("*").alias("n_links"))
    linked = roots.join(both, "k", "left")
    # without a link, a set is known by both fingerprints; copies of one text may be a large share of all rows
    marked = salted(classes.where("n > 0").select("doc_id", "k", "k2", "n"), linked, ["k"], "doc_id", "left")
    filled = marked.withColumn("k2", F.when(F.col("root").isNull(), F.col("k2")).otherwise(0)).withColumn("root", F.coalesce("root", "k"))
    least = filled.groupBy("root", "k2").agg(F.min("doc_id").alias("component_id"))
    named = salted(filled, least, ["root", "k2"], "doc_id")
    alone = classes.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")).unionAll(alone)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: one with the least doc_id. Same columns.

    Rows are told apart by doc_id and set, so where different texts share a doc_id each is judged by
    itself and every component keeps a row. A row with a null doc_id is kept, as nothing names it; of
    rows that repeat both doc_id and set (or have one doc_id and no words) one is kept.
    """
    bounded_batches(docs.sparkSession)
    classes, _, roots = links_and_roots(texts(docs), width, percent)
    filled = F.col("n") > 0
    found = salted(classes.where("doc_id is not null"), roots, ["k"], "doc_id", "left")
    found = materialize(found.select("doc_id", F.when(filled, F.col("k")).alias("set_key"), F.when(filled, F.coalesce("root", "k")).alias("root")), "jaccard-kept")
    named = found.where("root is not null")
    chosen = named.groupBy("root").agg(F.min(F.struct("doc_id", "set_key")).alias("c")).select("c.*")
    pairs = materialize(named.select("doc_id", "set_key").distinct().join(chosen, ["doc_id", "set_key"], "left_anti"), "jaccard-gone")

    def sent(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.count() <= KEYS_BROADCAST else table

    gone = sent(pairs.select("doc_id").distinct())
    repeated = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = sent(materialize(repeated, "jaccard-repeated"))
    once = docs.join(repeated, "doc_id", "left_anti").join(gone, "doc_id", "left_anti").select(*docs.columns)
    # the row travels as one column, so that no name of its own can clash with those used here
    rows = docs.join(repeated, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kept = with_set_key(rows, width).join(pairs, ["doc_id", "set_key"], "left_anti").dropDuplicates(["doc_id", "set_key"])
    return once.unionByName(kept.select("row.*"))
