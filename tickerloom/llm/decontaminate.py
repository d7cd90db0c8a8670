"""Benchmark decontamination by embedding edit distance into Hamming distance.

Items and texts are compared as lower-case words (letters, digits and bytes beyond ASCII) joined
by single spaces.

1. *Windows.* Each run of ``SEED`` characters that a text shares with an item opens an item-sized
   window of the text, aligned with the item at that run, however many items share it. An edit
   destroys at most ``GRAM`` of an item's short grams, so a window that holds too few of them
   cannot be within the bound and is dropped; this counting loses nothing.
2. *CGK embedding.* Seeded random walks read window and item from the run outwards, in both
   directions: a step puts out the character under the pointer and moves on if a random bit of
   (walk, step, character) says so. Small edit distance becomes small Hamming distance between the
   outputs, most of all near the run, where both walks begin in step.
3. *Bit sampling.* Each of ``tables`` hashes is ``SAMPLED`` output positions; a window is a
   candidate if one hash agrees. Their number follows from the recall aimed at, for windows whose
   outputs agree in ``ALIKE`` of the positions.
4. *Verification.* The exact edit distance of the item to the best stretch around the window
   (bit-parallel, semi-global) must be at most ``max_edit`` of the item's length.

Embedding a window at every word would cost thousands of CPU seconds a GB, so windows open at shared
runs only. Of copies whose characters are edited at random up to the bound, hardly one has no
such run; ``tests/llm`` measures the recall of all four steps.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, materialize, project, slices, string_column, work_path
from .textops import mix, raw

#: Edit distance allowed, as a share of the item's length.
MAX_EDIT = 0.2
#: Characters of a shared run.
SEED = 10
#: Items shorter than so many seeds take shorter ones, a quarter of their length, but not below LEAST_SEED.
SEEDS_IN_ITEM = 4
LEAST_SEED = 6
#: Characters of the grams counted in a window, bits of the map that holds their hashes, and characters a map covers.
GRAM = 3
GRAM_BITS = 1 << 12
MAP_CHARS = 64
WALKS = 2
#: A first look at a window: of so many steps of one walk on each side, the share that has to agree. Nine in ten windows
#: of other texts end here.
LOOK_STEPS = 8
LOOK = 0.375
#: Steps of a walk on each side of the run; where the item ends on one side, as many more are read on the other.
STEPS = 24
SAMPLED = 8
#: Recall aimed at for windows whose embeddings agree in ``ALIKE`` of the positions. Of copies with a fifth of their
#: characters edited, 98 in 100 agree in 0.48 of them at their best run; other windows seldom reach 0.35.
RECALL = 0.99
ALIKE = 0.45
#: Bytes of benchmark text that are broadcast at once (about 30 times as much with its index); a larger benchmark is taken in blocks.
BLOCK_BYTES = 2 << 20

#: Windows embedded, runs opened, and characters hashed at once.
WINDOWS = 1 << 13
OPENED = 1 << 20
PART = 1 << 16

_INSIDE = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_VALUE = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x2545F4914F6CDD1D))
_BASE = 0x9E3779B97F4A7C15
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
LEAK = "array<struct<item_id:long,distance:long,start:long,stop:long>>"


def tables_for(recall: float = RECALL, alike: float = ALIKE, sampled: int = SAMPLED) -> int:
    """Hash tables needed so that at least one agrees with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - alike**sampled))


def sampled_positions(tables: int) -> np.ndarray:
    """The positions of each table (tables x SAMPLED), distinct within a table, of 2 * WALKS * STEPS."""
    n = 2 * WALKS * STEPS
    order = mix(np.arange(tables * n, dtype=np.uint64) + np.uint64(77 << 32)).reshape(tables, n)
    return np.argsort(order, axis=1)[:, :SAMPLED]


def _moves() -> np.ndarray:
    """For each side and walk, step and character, whether the pointer moves on; at a text's end (0) it stays."""
    shape = (2, WALKS, 2 * STEPS, 256)
    bits = mix(np.arange(math.prod(shape), dtype=np.uint64) + np.uint64(1 << 40)).reshape(shape) >> np.uint64(63)
    bits[..., 0] = 0
    return bits.astype(np.int32)


def embed(values: np.ndarray, at: np.ndarray, moves: np.ndarray, step: int) -> np.ndarray:
    """CGK outputs of walks over ``values`` that begin at ``at`` and go on by ``step`` (1 or -1): steps x rows."""
    out = np.empty((len(moves), len(at)), np.uint8)
    at = at.astype(np.int32)
    for j, table in enumerate(moves * np.int32(step)):
        out[j] = values[at]
        at += table[out[j]]
    return out


def grams(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` values, put together from runs of powers of two."""
    piece, size, out, done = values, 1, None, 0
    while size <= width:
        if width & size:
            if out is None:
                out = piece
            else:
                n = min(len(out), max(len(piece) - done, 0))
                out = out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + piece[done : done + n]
            done += size
        if 2 * size > width:
            break
        n = max(len(piece) - size, 0)
        piece = piece[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + piece[size : size + n]
        size *= 2
    return out[: max(len(values) - width + 1, 0)]


def plain_texts(column) -> tuple[np.ndarray, np.ndarray]:
    """All rows as words with one space behind each, a 0 before the first row and behind every row; and the rows' ends."""
    data, offsets = raw(column)
    ends = offsets[1:] + np.arange(1, len(offsets))
    data = np.insert(np.concatenate([np.zeros(1, np.uint8), data]), offsets[1:] + 1, 0)
    inside = _INSIDE[data]
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    kept[0] = kept[ends] = True
    out = np.where(inside, _FOLD[data], np.uint8(32))
    out[0] = out[ends] = 0
    out = out[kept]
    return out, np.flatnonzero(out == 0)[1:]


def best_distance(pattern: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any stretch of ``text``, and where that stretch ends."""
    m = len(pattern)
    if not m:
        return 0, 0
    where: dict[int, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        equal = where.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | ~(horizontal | plus) & full, plus & horizontal
        score += bool(up & top) - bool(down & top)
        if score < best:
            best, end = score, j + 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(vertical | up) & full, up & vertical
    return best, end


def gram_maps(values: np.ndarray) -> np.ndarray:
    """For each ``MAP_CHARS`` characters, a map of hashed bits of the grams that begin there: maps x 64-bit words."""
    n = -(-len(values) // MAP_CHARS)
    out = np.empty((n, GRAM_BITS // 64), np.uint64)
    per = PART // MAP_CHARS
    for low in range(0, n, per):
        part = values[low * MAP_CHARS : (low + per) * MAP_CHARS + GRAM - 1]
        bit = (grams(_VALUE[part], GRAM) * _SPREAD >> np.uint64(64 - GRAM_BITS.bit_length() + 1)).astype(np.int64)
        there = np.zeros((min(per, n - low), GRAM_BITS), bool)
        there.reshape(-1)[np.arange(len(bit)) // MAP_CHARS * GRAM_BITS + bit] = True
        out[low : low + per] = np.packbits(there, axis=1).view(np.uint64)
    return out


class Seeds:
    """The runs of one length in a block of items: sorted hashes, where each occurs, and a table of hash bits."""

    def __init__(self, width: int, found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.width = width
        h, item, offset, before = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h, kind="stable")
        h, self.item, self.offset, before = h[order], item[order].astype(np.int32), offset[order].astype(np.int32), before[order]
        self.keys, self.begin, self.count = np.unique(h, return_index=True, return_counts=True)
        # the character before a run, where it is one and the same in all items (else 0)
        least, most = np.minimum.reduceat(before, self.begin), np.maximum.reduceat(before, self.begin)
        self.before = np.where(least == most, least, np.uint8(0))
        self.shift = np.uint64(64 - min(24, max(16, (32 * len(self.keys)).bit_length())))
        self.near = np.zeros(1 << int(64 - self.shift), bool)
        self.near[(self.keys * _SPREAD >> self.shift).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the text (``_VALUE`` of its characters) a run begins, and which one it is."""
        places, which = [], []
        for low in range(0, len(values), PART):
            h = grams(values[low : low + PART + self.width - 1], self.width)
            at = np.flatnonzero(self.near[(h * _SPREAD >> self.shift).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            same = self.keys[k] == h[at]
            places.append(at[same] + low)
            which.append(k[same])
        return (np.concatenate(places), np.concatenate(which)) if places else (np.zeros(0, np.int64),) * 2


class Items:
    """A block of benchmark items: their different plain texts, the runs that open windows, and the tables."""

    def __init__(self, rows: list[tuple[int | None, str | None]], max_edit: float = MAX_EDIT, recall: float = RECALL):
        self.max_edit = max_edit
        values, ends = plain_texts(pa.array([r[1] or "" for r in rows], pa.string()))
        texts = [values[a + 1 : b].tobytes().rstrip(b" ") for a, b in zip(np.r_[0, ends], ends, strict=False)]
        named: dict[bytes, list[tuple[int, int | None]]] = {}
        for place, (row, text) in enumerate(zip(rows, texts, strict=True)):
            if text:
                named.setdefault(text, []).append((place, row[0]))
        self.texts, self.ids = list(named), list(named.values())
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.values = np.frombuffer(b"\0" + b"\0".join(self.texts) + b"\0", np.uint8)
        self.starts = np.concatenate([[1], 1 + np.cumsum(self.sizes + 1)])[: len(self.texts)]
        width = np.where(self.sizes >= SEEDS_IN_ITEM * SEED, SEED, np.maximum(np.minimum(self.sizes, LEAST_SEED), self.sizes // SEEDS_IN_ITEM))
        self.seeds = [self._seeds(w, np.flatnonzero(width == w)) for w in np.unique(width).tolist()]
        maps = [np.bitwise_or.reduce(gram_maps(np.frombuffer(t, np.uint8)), axis=0) for t in self.texts]
        self.maps = np.stack(maps) if maps else np.zeros((0, GRAM_BITS // 64), np.uint64)
        self.bound = (max_edit * self.sizes).astype(np.int64)
        self.least = np.bitwise_count(self.maps).sum(axis=1, dtype=np.int64) - GRAM * self.bound
        self.moves, self.positions = _moves(), sampled_positions(tables_for(recall))

    def _seeds(self, width: int, members: np.ndarray) -> Seeds:
        found = []
        for i in members.tolist():
            text = np.frombuffer(self.texts[i], np.uint8)
            h = grams(_VALUE[text], width)
            found.append((h, np.full(len(h), i), np.arange(len(h)), np.r_[np.uint8(0), text[: len(h) - 1]]))
        return Seeds(width, found)

    def opened(self, values: np.ndarray):
        """Windows, in parts: (item, first character of the run in it, that character's place in the text, characters of a seed).

        A shared run opens its window at its first seed only: the character before differs, or one side has none.
        """
        hashed, maps = _VALUE[values], None
        for seeds in self.seeds:
            place, key = seeds.find(hashed)
            known = seeds.before[key]
            first = (known == 0) | (values[place - 1] != known)
            place, key = place[first], key[first]
            ahead = np.cumsum(seeds.count[key])
            cut = 0
            while cut < len(place):
                stop = max(cut + 1, int(np.searchsorted(ahead, (ahead[cut - 1] if cut else 0) + OPENED, "right")))
                part, many = slice(cut, stop), seeds.count[key[cut:stop]]
                entry = np.repeat(seeds.begin[key[part]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                at, item, offset = np.repeat(place[part], many), seeds.item[entry], seeds.offset[entry]
                before = self.values[self.starts[item] + offset - 1]
                new = np.flatnonzero((before == 0) | (before != values[at - 1]))
                new = new[self._look(values, item[new], offset[new], at[new], seeds.width)]
                at, item, offset = at[new], item[new], offset[new]
                maps = gram_maps(values) if maps is None else maps
                kept = self._enough(maps, item, at - offset)
                yield item[kept], offset[kept], at[kept], np.full(len(kept), seeds.width)
                cut = stop

    def _look(self, values: np.ndarray, item: np.ndarray, offset: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Whether the first steps of one walk agree in ``LOOK`` of those that lie in the item."""
        out = np.empty(len(item), bool)
        for cut in range(0, len(item), WINDOWS):
            part = slice(cut, cut + WINDOWS)
            base, place = self.starts[item[part]] + offset[part], at[part]
            there, same = 0, 0
            for step, moves, ours, theirs in ((1, self.moves[0, 0], base + width, place + width), (-1, self.moves[1, 0], base - 1, place - 1)):
                mine, other = (embed(v, x, moves[:LOOK_STEPS], step) for v, x in ((self.values, ours), (values, theirs)))
                there = there + (mine != 0).sum(axis=0)
                same = same + ((mine == other) & (mine != 0)).sum(axis=0)
            out[part] = same >= LOOK * there
        return out

    def _enough(self, maps: np.ndarray, item: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The windows, of items that begin there, with at least as many of the item's grams as copies within the bound have."""
        kept = []
        for cut in range(0, len(item), WINDOWS):
            i, b = item[cut : cut + WINDOWS], begin[cut : cut + WINDOWS]
            low = np.maximum(b - self.bound[i], 0) // MAP_CHARS
            span = np.minimum((b + self.sizes[i] + self.bound[i]) // MAP_CHARS, len(maps) - 1) - low
            order = np.argsort(-span, kind="stable")
            i, low, span = i[order], low[order], span[order]
            held = maps[low]
            for j in range(1, int(span[0]) + 1):
                n = int(np.searchsorted(-span, -j, "right"))
                held[:n] |= maps[low[:n] + j]
            shared = np.bitwise_count(held & self.maps[i]).sum(axis=1, dtype=np.int64)
            kept.append(np.sort(order[shared >= self.least[i]]) + cut)
        return np.concatenate(kept) if kept else np.zeros(0, np.int64)

    def agreement(self, values: np.ndarray, item: np.ndarray, offset: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Where the embeddings of window and item agree: positions x windows. What a run has beyond its first seed counts."""
        base = self.starts[item] + offset
        sides = []
        for side, step in ((0, 1), (1, -1)):
            begin, place = (base + width, at + width) if step == 1 else (base - 1, at - 1)
            for walk in range(WALKS):
                ours, theirs = embed(self.values, begin, self.moves[side, walk], step), embed(values, place, self.moves[side, walk], step)
                sides.append((ours != 0, ours == theirs))
        out = np.empty((2 * WALKS * STEPS, len(item)), bool)
        for walk in range(WALKS):
            for side in (0, 1):
                there, same = sides[side * WALKS + walk]
                other_there, other_same = sides[(1 - side) * WALKS + walk]
                # beyond the item's end on one side, the other side is read on; beyond both there is nothing to compare
                beyond = np.where(other_there[STEPS:], other_same[STEPS:], True)
                low = (2 * walk + side) * STEPS
                out[low : low + STEPS] = np.where(there[:STEPS], same[:STEPS], beyond)
        return out

    def candidates(self, values: np.ndarray):
        """(item, place of its beginning in the text) of the windows of which one table agrees."""
        for found in self.opened(values):
            for low in range(0, len(found[0]), WINDOWS):
                item, offset, at, width = (x[low : low + WINDOWS] for x in found)
                bits = np.packbits(self.agreement(values, item, offset, at, width), axis=1)
                hit = np.zeros(bits.shape[1], np.uint8)
                for first in range(0, len(self.positions), 64):
                    hit |= np.bitwise_or.reduce(np.bitwise_and.reduce(bits[self.positions[first : first + 64]], axis=1), axis=0)
                alike = np.unpackbits(hit)[: len(item)].astype(bool)
                if alike.any():
                    yield item[alike], at[alike] - offset[alike]

    def leaks(self, column) -> list[list[tuple]]:
        """For each text: (item_id, distance, start, stop) of every item found, best window each; places in the plain text."""
        values, ends = plain_texts(column)
        out: list[list[tuple]] = [[] for _ in range(len(ends))]
        found = list(self.candidates(values)) if self.texts else []
        if not found:
            return out
        item, begin = (np.concatenate(x) for x in zip(*found, strict=True))
        # a window's row is that of its shared run; its beginning may lie before the row's
        row = np.searchsorted(ends, np.maximum(begin, 1) + self.sizes[item] // 2)
        row = np.minimum(row, len(ends) - 1)
        first = np.r_[1, ends[:-1] + 1]
        best: dict[tuple[int, int], tuple] = {}
        for r, i, low, high in self._regions(row, item, begin):
            bound = int(self.max_edit * self.sizes[i])
            low, high = max(int(first[r]), low - bound), min(int(ends[r]), high + int(self.sizes[i]) + bound)
            distance, stop = best_distance(self.texts[i], values[low:high].tobytes())
            if distance <= bound and ((r, i) not in best or distance < best[r, i][0]):
                stop += low - int(first[r])
                best[r, i] = (distance, max(stop - int(self.sizes[i]), 0), stop)
        for (r, i), (distance, start, stop) in best.items():
            out[r] += [(place, item_id, distance, start, stop) for place, item_id in self.ids[i]]
        return [[leak[1:] for leak in sorted(leaks, key=lambda x: x[0])] for leaks in out]

    def _regions(self, row: np.ndarray, item: np.ndarray, begin: np.ndarray):
        """(row, item, least and greatest beginning) of windows of one item that lie within its edit bound of each other."""
        order = np.lexsort((begin, item, row))
        row, item, begin = row[order], item[order], begin[order]
        near = np.maximum((self.max_edit * self.sizes[item]).astype(np.int64), 1)
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > begin[:-1] + near[1:])])
        last = np.r_[new[1:], len(row)] - 1
        yield from zip(row[new].tolist(), item[new].tolist(), begin[new].tolist(), begin[last].tolist(), strict=True)


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, recall: float = RECALL, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``leaks``: the benchmark items found in each whole text, an array of
    struct(item_id, distance, start, stop), by item in the benchmark's order.

    Defined results: a null or empty text has none; an item without a word (or null) is never
    found; equal items are each reported; repeated rows alike; other columns pass through (one
    named leaks is replaced; the text goes with ``keep_text=False``); empty tables on either side
    give no leaks. The benchmark is read by the driver in blocks of at most about ``BLOCK_BYTES``, one
    at a time: each is matched in one narrow pass over the documents, without a shuffle or a join, and
    between blocks the documents are written, so that no worker holds two blocks.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = project(benchmark, item_id="long", text="string").where("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-size // BLOCK_BYTES))
    out, before = docs.drop("leaks").withColumn("leaks", F.expr(f"cast(array() as {LEAK})")), None
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text")
        items = spark.sparkContext.broadcast(Items([(r.item_id, r.text) for r in part.collect()], max_edit, recall))
        out = _match(out, items, keep_text or block < blocks - 1)
        if block < blocks - 1:
            after = work_path(spark, "leaks")
            out = materialize(out, "leaks", after)
            items.unpersist()
            if before:
                discard(spark, before)
            before = after
    return out


def _match(docs: DataFrame, items, keep_text: bool) -> DataFrame:
    schema = T.StructType([f for f in docs.schema.fields if keep_text or f.name != "text"])
    leak = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for batch in slices(batches):
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            before = columns["leaks"].to_pylist()
            found = items.value.leaks(string_column(columns["text"]))
            rows = [(b or []) + [dict(zip(("item_id", "distance", "start", "stop"), map(_plain, leak_), strict=True)) for leak_ in f] for b, f in zip(before, found, strict=True)]
            columns["leaks"] = pa.array(rows, leak)
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def _plain(value):
    return None if value is None else int(value)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: contaminated, n_items, item_ids (ascending) and the least distance found."""
    found = find_leaks(project(docs, doc_id="long", text="string"), benchmark, keep_text=False)
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.size("leaks").cast("long").alias("n_items"),
        F.sort_array(F.col("leaks.item_id")).alias("item_ids"),
        F.array_min(F.col("leaks.distance")).alias("least_distance"),
    )
