"""Language-model scoring with a hidden Markov model over words.

The base is a smoothed unigram model over words (A-Z folded, split at white space) and an end
token. On it sits a hidden Markov model: state s gives word w with probability r_s(w) * p(w), where
p is the unigram probability and r_s(w) the word's emission ratio, so

    log P(text) = base score + log of the forward sum over the emission ratios.

Nothing that is gathered has a fixed size. Counts and emissions of all training words are kept
distributed, in shards of the word hashes, and grow with the corpus:

1. *Counts.* Tasks count words and send each shard one run of numbers.
2. *Blocks.* Texts are written once as blocks of about ``BLOCK_TOKENS`` word numbers, each with the
   hashes of its words beyond the ``HEAVY`` most frequent ones, whose counts are broadcast.
3. *Training* is Baum-Welch over whole texts: each task runs scaled forward-backward over its blocks and
   adds up expected counts, whose sums give the next model, until the likelihood stops rising. It
   begins with one text in ``WARM`` and goes on over all. Meanwhile words beyond the ``OWN`` most
   frequent ones share emissions by class.
4. *Emissions.* A last pass counts, for each of those words, how often each state gave it; the sums a
   word are its own emission, drawn towards the states' overall shares where it is seldom.
5. *Scores.* Blocks ask the shards for the words they hold; with the answers the forward recursion
   is exact. In training as in scoring, runs of ``RUN`` tokens become scaled transfer matrices,
   multiplied in order, so that what lies before and behind a run is carried over exactly.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free, give_back, materialize, slices
from .textops import longs, mix, word_hashes

STATES = 4
#: Training ends when the log-likelihood of a token rises by less than this (nats).
RISE = 1e-3
#: Before it goes over all texts, training goes over one in so many.
WARM = 16
#: Tokens of a run, which one transfer matrix stands for.
RUN = 128
#: Words with a broadcast count at most, and those of them with an emission of their own while training.
HEAVY = 400_000
OWN = 32_768
SHARED = 32_767
ALPHA = 0.1
#: Probability of staying in a state before training, and weights of the priors in the updates.
STAY = 0.9
PRIOR = 50.0
KAPPA = 5.0
#: The end token's stand-in among word hashes.
END = np.uint64(0x0E4D0E4D0E4D0E4D)
#: Distinct words a task holds before it passes counts on.
HELD = 1_500_000
#: Tokens of a block, and of the texts that forward-backward takes together.
BLOCK_TOKENS = 1 << 19
GROUP_TOKENS = 1 << 18
#: Bytes of text for each shard of the word hashes.
SHARD_BYTES = 1 << 25
#: Blocks are read back a few at a time.
SMALL_GROUPS = {"compression": "zstd", "parquet.block.size": str(8 << 20)}


class HashIndex:
    """Positions of 64-bit keys by open addressing; built and asked in whole arrays."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, int(len(keys) * 2.5).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.rows = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), mix(keys) & self.mask
        while len(left):
            free = self.rows[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            taken = left[free][first]
            self.rows[at], self.keys[at] = taken, keys[taken]
            placed = self.rows[slot] == left
            left, slot = left[~placed], (slot[~placed] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        left, slot = np.arange(len(keys)), mix(keys) & self.mask
        while len(left):
            row = self.rows[slot]
            same = (self.keys[slot] == keys[left]) & (row >= 0)
            out[left[same]] = row[same]
            on = ~same & (row >= 0)
            left, slot = left[on], (slot[on] + np.uint64(1)) & self.mask
        return out


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end token, and each text's first position (rows + 1)."""
    words, first = word_hashes(column)
    at = first + np.arange(len(first))
    out = np.empty(len(words) + len(first) - 1, np.uint64)
    keep = np.ones(len(out), bool)
    keep[at[1:] - 1] = False
    out[keep], out[~keep] = words, END
    return out, at


def _merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sums by word of (words, values, ...); values are numbers or rows of numbers."""
    words, *values = (np.concatenate(c) for c in zip(*held, strict=True))
    keys, inverse = np.unique(words, return_inverse=True)
    sums = [np.bincount(inverse, v, len(keys)) if v.ndim == 1 else np.stack([np.bincount(inverse, v[:, s], len(keys)) for s in range(v.shape[1])], 1) for v in values]
    return keys, *sums


def _sharded(shards: int, words: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """The shards that ascending ``words`` fall into, and for each the bytes of its words and values."""
    shard = ((words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    names, first = np.unique(shard, return_index=True)
    bounds = np.r_[first, len(words)]
    return names, [[np.ascontiguousarray(x[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] for x in (words, *values)]


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The numbers of all rows of a binary column."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def shards_for(docs: DataFrame) -> int:
    """Shards for the words of ``docs``, by the bytes of their texts."""
    return max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))


def count_words(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """Counts of all tokens of ``docs`` (column text), in shards: rows (shard, words, counts), numbers packed, words ascending."""
    shards = shards or shards_for(docs)

    def sent(held):
        words, counts = _merged(held)
        names, packed = _sharded(shards, words, counts.astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(p, pa.binary()) for p in packed)], names=["shard", "words", "counts"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            words, _ = tokens(batch.column(0))
            held.append(np.unique(words, return_counts=True))
            size += len(held[-1][0])
            if size > 2 * HELD:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > HELD:
                    yield sent(held)
                    held, size = [], 0
        if held:
            yield sent(held)
        give_back()

    def total(table: pa.Table) -> pa.Table:
        words, counts = _merged([(_joined(table["words"], np.uint64), _joined(table["counts"], np.int64))])
        return pa.table({"shard": table["shard"][:1], "words": pa.array([words.tobytes()], pa.binary()), "counts": pa.array([counts.astype(np.int64).tobytes()], pa.binary())})

    found = docs.select("text").mapInArrow(run, "shard long, words binary, counts binary")
    return found.groupBy("shard").applyInArrow(total, "shard long, words binary, counts binary")


@dataclass
class Vocabulary:
    """Totals, the frequent words with their counts and classes, and each class's unigram mass."""

    n: int
    v: int
    index: HashIndex
    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    mass: np.ndarray

    @property
    def divisor(self) -> float:
        return self.n + ALPHA * (self.v + 1)

    @property
    def rare(self) -> int:
        return len(self.mass) - 1

    def classes_of(self, rows: np.ndarray) -> np.ndarray:
        """The classes of frequent words by their rows; what is no such row (-1, or a block's own word) is rare."""
        table = np.append(self.classes, self.rare)
        return table[np.where((rows < 0) | (rows >= len(self.classes)), len(self.classes), rows)]


def vocabulary(counts: DataFrame, heavy: int = HEAVY) -> Vocabulary:
    """Read off the totals and the words frequent enough that at most ``heavy`` are."""

    def ladder_of(batches):
        for batch in batches:
            c, words = np.unique(_joined(pa.chunked_array([batch.column(0)]), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(words)], names=["c", "words"])

    steps = counts.select("counts").mapInArrow(ladder_of, "c long, words long").groupBy("c").agg(F.sum("words").alias("words"))
    ladder = sorted(((r.c, r.words) for r in steps.collect()), reverse=True)
    n, v = sum(c * k for c, k in ladder), sum(k for _, k in ladder)
    least, room = ladder[0][0] + 1 if ladder else 1, heavy
    for c, k in ladder:
        if k > room:
            break
        least, room = c, room - k

    def frequent(batches):
        for batch in batches:
            words, c = (_joined(pa.chunked_array([batch.column(i)]), kind) for i, kind in enumerate((np.uint64, np.int64)))
            yield pa.RecordBatch.from_arrays([longs(words[c >= least]), pa.array(c[c >= least])], names=["w", "c"])

    table = counts.select("words", "counts").mapInArrow(frequent, "w long, c long").toArrow()
    words, c = table["w"].to_numpy().view(np.uint64), table["c"].to_numpy()
    order = np.lexsort((words, -c))
    words, c = words[order], c[order]
    shared = OWN + (mix(words) % np.uint64(SHARED)).astype(np.int64)
    classes = np.where(np.arange(len(words)) < OWN, np.arange(len(words)), shared)
    mass = np.bincount(classes, c + ALPHA, OWN + SHARED + 1)
    mass[-1] = n + ALPHA * (v + 1) - mass[:-1].sum()  # all other known words, and the unseen one
    return Vocabulary(n, v, HashIndex(words), words, c, classes, mass / mass.sum() if mass.sum() else mass + 1 / len(mass))


@dataclass
class Hmm:
    """Start and transition probabilities, the emission ratios phi_s(class) / p(class), and the states' shares of all tokens."""

    start: np.ndarray
    move: np.ndarray
    ratio: np.ndarray
    share: np.ndarray | None = None


def untrained(vocab: Vocabulary, states: int = STATES, seed: int = 5) -> Hmm:
    cells = np.arange(len(vocab.mass) * states, dtype=np.uint64) + np.uint64(seed << 32)
    tilt = 0.5 + (mix(cells) >> np.uint64(11)).astype(float).reshape(-1, states) / 2.0**53
    phi = vocab.mass[:, None] * tilt
    move = np.full((states, states), (1 - STAY) / max(states - 1, 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    return Hmm(np.full(states, 1 / states), move, _ratios(phi / phi.sum(0), vocab.mass))


def _ratios(phi: np.ndarray, mass: np.ndarray) -> np.ndarray:
    return np.where(mass[:, None] > 0, phi / np.where(mass > 0, mass, 1)[:, None], 1.0)


def _runs(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of runs of at most RUN tokens within each text, longest first, and their texts."""
    sizes = np.diff(first)
    many = -(-sizes // RUN)
    text = np.repeat(np.arange(len(sizes)), many)
    place = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    starts = first[text] + place * RUN
    return starts, np.minimum(first[text + 1] - starts, RUN), text


def expected(hmm: Hmm, classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and (class, state) pairs of whole texts by scaled forward-backward."""
    return _counted(hmm, classes, first)[:3]


def _borders(hmm: Hmm, classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, text: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run, the state probabilities its first token meets, and what follows its last token (up to a factor)."""
    k = len(hmm.start)
    enter, leave = np.tile(hmm.start, (len(starts), 1)), np.ones((len(starts), k))
    many = np.bincount(text)[text]
    split = np.flatnonzero(many > 1)
    if not len(split):
        return enter, leave
    split = split[np.argsort(-lengths[split], kind="stable")]
    slot = np.full(len(starts), -1)
    slot[split] = np.arange(len(split))
    through = np.eye(k) * hmm.ratio[classes[starts[split]]][:, None, :]
    for t in range(1, int(lengths[split[0]])):
        m = int(np.searchsorted(-lengths[split], -t, "left"))
        step = (through[:m].reshape(-1, k) @ hmm.move).reshape(m, k, k) * hmm.ratio[classes[starts[split[:m]] + t]][:, None, :]
        through[:m] = step / step.sum((1, 2))[:, None, None]
    by_rank = split[np.argsort(rank[split], kind="stable")]
    bounds = np.searchsorted(rank[by_rank], np.arange(int(rank.max()) + 2))
    for r in range(1, len(bounds) - 1):
        now = by_rank[bounds[r] : bounds[r + 1]]
        vector = np.einsum("ni,nij->nj", enter[now - 1], through[slot[now - 1]]) @ hmm.move
        enter[now] = vector / vector.sum(1, keepdims=True)
    for r in range(len(bounds) - 2, 0, -1):
        now = by_rank[bounds[r] : bounds[r + 1]]
        vector = np.einsum("nij,nj->ni", through[slot[now]], leave[now]) @ hmm.move.T
        leave[now - 1] = vector / vector.sum(1, keepdims=True)
    return enter, leave


def _counted(hmm: Hmm, classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """``expected``, and the log of the forward sums of all texts over the emission ratios."""
    start, moves, gamma, log = posteriors(hmm, classes, first)
    emits = [np.bincount(classes, gamma[:, s], len(hmm.ratio)) for s in range(len(hmm.start))]
    return start, moves, np.stack(emits, 1), log


def posteriors(hmm: Hmm, classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts and moves, each token's state probabilities, and the log of the forward sums."""
    k = len(hmm.start)
    starts, lengths, text = _runs(first)
    moves, found = np.zeros((k, k)), np.zeros((len(classes), k))
    if not len(starts):
        return np.zeros(k), moves, found, 0.0
    rank = np.arange(len(text)) - np.searchsorted(text, text)
    enter, leave = _borders(hmm, classes, starts, lengths, text, rank)
    order = np.argsort(-lengths, kind="stable")
    run_of, starts, lengths, enter, leave = order, starts[order], lengths[order], enter[order], leave[order]
    steps = int(lengths[0])
    active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(steps)]  # runs longer than t
    forward, scales, log = [], [], 0.0
    for t in range(steps):
        emit = hmm.ratio[classes[starts[: active[t]] + t]]
        a = (forward[-1][: active[t]] @ hmm.move if t else enter) * emit
        scale = a.sum(1, keepdims=True)
        forward.append(a / scale)
        scales.append(scale)
        log += float(np.log(scale).sum())
    last = np.empty((len(starts), k))
    beta = np.zeros((0, k))
    for t in range(steps - 1, -1, -1):
        back = leave[: active[t]].copy()
        m = active[t + 1] if t + 1 < steps else 0
        if m:
            ahead = hmm.ratio[classes[starts[:m] + t + 1]] * beta / scales[t + 1]
            moves += hmm.move * (forward[t][:m].T @ ahead)
            back[:m] = ahead @ hmm.move.T
        last[run_of[m : active[t]]] = forward[t][m:]
        back[m:] /= (forward[t][m:] * back[m:]).sum(1, keepdims=True)
        beta = back
        gamma = forward[t] * back
        gamma /= gamma.sum(1, keepdims=True)
        found[starts[: active[t]] + t] = gamma
    # moves from the last token of a run to the first of the text's next one
    begun = np.empty((len(starts), k))
    begun[run_of] = hmm.ratio[classes[starts]] * beta
    on = np.flatnonzero(rank > 0)
    before, ahead = last[on - 1], begun[on]
    moves += hmm.move * (before.T @ (ahead / ((before @ hmm.move) * ahead).sum(1, keepdims=True)))
    return gamma[rank[run_of] == 0].sum(0), moves, found, log


def log_ratio(hmm: Hmm, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log of the forward sum over emission ratios of each whole text, exactly, scaled."""
    k = len(hmm.start)
    starts, lengths, text = _runs(first)
    order = np.argsort(-lengths, kind="stable")
    place = starts[order]
    steps = int(lengths.max()) if len(lengths) else 0
    through, logs = np.tile(np.eye(k), (len(order), 1, 1)), np.zeros(len(order))
    for t in range(steps):
        m = int(np.searchsorted(-lengths[order], -t, "left"))
        step = (through[:m].reshape(-1, k) @ hmm.move).reshape(m, k, k) * hmm.ratio[classes[place[:m] + t]][:, None, :]
        scale = step.sum((1, 2))
        through[:m] = step / scale[:, None, None]
        logs[:m] += np.log(scale)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    rank = np.arange(len(text)) - np.searchsorted(text, text)
    # before the first token the state is drawn, not moved to: undo one move
    at_start = np.linalg.solve(hmm.move.T, hmm.start)
    state, out = np.tile(at_start, (len(first) - 1, 1)), np.zeros(len(first) - 1)
    for r in range(int(rank.max()) + 1 if len(rank) else 0):
        now = np.flatnonzero(rank == r)
        vector = np.einsum("ni,nij->nj", state[text[now]], through[back[now]])
        scale = vector.sum(1)
        out[text[now]] += np.log(scale) + logs[back[now]]
        state[text[now]] = vector / scale[:, None]
    return out


BLOCK = "block long, doc_ids binary, known_ids binary, held binary, sizes binary, codes binary, others binary"


def encode(rows: DataFrame, vocab) -> DataFrame:
    """Rows (doc_id, held_out, text) as blocks.

    A block's codes (int32) are rows of the vocabulary or, from its size on, places among ``others``, the
    ascending hashes of the block's other words; ``sizes`` are the texts' tokens. A text is never cut.
    ``vocab`` is a broadcast Vocabulary.
    """

    def packed(number, ids, held, sizes, codes, rare):
        codes, rare = np.concatenate(codes), np.concatenate(rare)
        others, place = np.unique(rare, return_inverse=True)
        codes[codes < 0] = len(vocab.value.words) + place
        known = np.array([i is not None for i in ids], bool)
        values = np.array([i or 0 for i in ids], np.int64), known, np.array(held, bool), np.array(sizes, np.int64), codes, others
        return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([v.tobytes()], pa.binary()) for v in values)], names=[f.split()[0] for f in BLOCK.split(", ")])

    def run(batches):
        number, size = TaskContext.get().partitionId() << 32, 0
        ids, held, sizes, codes, rare = [], [], [], [], []
        for batch in slices(batches):
            words, first = tokens(batch.column(2))
            at = vocab.value.index.find(words)
            ids += batch.column(0).to_pylist()
            held += batch.column(1).to_pylist()
            sizes += np.diff(first).tolist()
            codes.append(at)
            rare.append(words[at < 0])
            size += len(words)
            if size >= BLOCK_TOKENS:
                yield packed(number, ids, held, sizes, codes, rare)
                number, size = number + 1, 0
                ids, held, sizes, codes, rare = [], [], [], [], []
        if ids:
            yield packed(number, ids, held, sizes, codes, rare)
        give_back()

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, BLOCK)


def _groups(row: dict, held: bool, share: int = 1):
    """The codes and first positions of a block's texts, in groups of about GROUP_TOKENS; without ``held`` those
    to learn from (of which one in ``share``)."""
    sizes, codes = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["codes"], np.int32)
    ends = np.cumsum(sizes)
    chosen = np.ones(len(sizes), bool) if held else ~np.frombuffer(row["held"], bool)
    if share > 1:
        # by id and length, so that a text is chosen or not wherever it lies
        ids = np.frombuffer(row["doc_ids"], np.uint64)
        chosen &= mix(mix(ids) + sizes.view(np.uint64)) % np.uint64(share) == 0
    texts = np.flatnonzero(chosen)
    group = (np.cumsum(sizes[texts]) - sizes[texts]) // GROUP_TOKENS
    for part in np.split(texts, np.flatnonzero(np.diff(group)) + 1) if len(texts) else ():
        n = sizes[part]
        first = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(first[-1]) + np.repeat(ends[part] - n - first[:-1], n)
        yield codes[at], first


def _rows(batches):
    for batch in batches:
        for i in range(len(batch)):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def _sampled(blocks: DataFrame, share: int) -> DataFrame:
    """Blocks of one in ``share`` of the texts to learn from."""

    def run(batches):
        for row in _rows(batches):
            groups = list(_groups(row, False, share))
            if groups:
                sizes, codes = np.concatenate([np.diff(first) for _, first in groups]), np.concatenate([c for c, _ in groups])
                values = np.zeros(len(sizes), bool), sizes, codes
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), *(pa.array([v.tobytes()], pa.binary()) for v in values)], names=["block", "held", "sizes", "codes"])
        give_back()

    return blocks.select("block", "doc_ids", "held", "sizes", "codes").mapInArrow(run, "block long, held binary, sizes binary, codes binary")


def _pass(blocks: DataFrame, vocab, hmm: Hmm) -> tuple[np.ndarray, np.ndarray]:
    """Sums of expected counts over all partitions, by (x, state): classes, then -1 - s the moves from s, the starts, and the log."""
    states = len(hmm.start)
    fields = ["x", *(f"e{s}" for s in range(states))]
    shared = blocks.sparkSession.sparkContext.broadcast(hmm)

    def run(batches):
        vocab_, hmm_ = vocab.value, shared.value
        start, moves, emits, log = np.zeros(states), np.zeros((states, states)), np.zeros((len(vocab_.mass), states)), np.zeros(states)
        for row in _rows(batches):
            for codes, first in _groups(row, False):
                more = _counted(hmm_, vocab_.classes_of(codes), first)
                start, moves, emits = start + more[0], moves + more[1], emits + more[2]
                log[0] += more[3]
        give_back()
        seen = np.flatnonzero(emits.any(1))
        x = np.concatenate([seen, -1 - np.arange(states), [-1 - states, -2 - states]])
        e = np.concatenate([emits[seen], moves, start[None], log[None]])
        yield pa.RecordBatch.from_arrays([pa.array(x), *(pa.array(np.ascontiguousarray(e[:, s])) for s in range(states))], names=fields)

    sums = blocks.select("block", "held", "sizes", "codes").mapInArrow(run, ", ".join(["x long", *(f"{f} double" for f in fields[1:])])).groupBy("x").agg(*[F.sum(f).alias(f) for f in fields[1:]])
    table = sums.toArrow()
    shared.unpersist()
    return table["x"].to_numpy(), np.stack([table[f].to_numpy() for f in fields[1:]], 1) if len(table) else np.zeros((0, states))


def train(docs: DataFrame, vocab: Vocabulary, states: int = STATES, iterations: int | None = None) -> Hmm:
    """Baum-Welch over all rows of ``docs`` (column text).

    Rounds go on until the log-likelihood of a token rises by less than ``RISE``, first over one text in
    ``WARM``, then over all; or for ``iterations`` over all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    rows = docs.select(F.lit(0).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), "text")
    return _trained(materialize(encode(rows, shared), "lm-blocks", **SMALL_GROUPS), shared, states, iterations)


def _trained(blocks: DataFrame, shared, states: int, iterations: int | None) -> Hmm:
    vocab = shared.value
    hmm = untrained(vocab, states)
    if not vocab.n:
        return hmm
    for share in (WARM, 1) if iterations is None else (1,):
        before, part = -np.inf, blocks if share == 1 else materialize(_sampled(blocks, share), "lm-warm", few=True)
        for _ in itertools.count() if iterations is None else range(iterations):
            x, e = _pass(part, shared, hmm)
            is_log = x == -2 - states
            log, n = e[is_log, 0].sum(), e[x >= 0].sum()
            if not n or iterations is None and log - before < RISE * n:
                break
            before = log
            hmm = _updated(vocab, hmm, x[~is_log], e[~is_log])
    return hmm


def _held(emits: np.ndarray, total: np.ndarray, share: np.ndarray) -> np.ndarray:
    """How much more than its share a state has of each row, drawn towards 1, so that few occurrences decide little."""
    return (emits + KAPPA * share) / ((total + KAPPA) * share)


def _updated(vocab: Vocabulary, hmm: Hmm, x: np.ndarray, e: np.ndarray) -> Hmm:
    k = len(hmm.start)
    emits, moves, start = np.zeros((len(vocab.mass), k)), np.zeros((k, k)), np.zeros(k)
    emits[x[x >= 0]] = e[x >= 0]
    for row, values in zip(x[x < 0], e[x < 0], strict=True):
        if row == -1 - k:
            start = values
        else:
            moves[-1 - row] = values
    share = (emits.sum(0) + PRIOR / k) / (emits.sum() + PRIOR)
    phi = vocab.mass[:, None] * _held(emits, emits.sum(1, keepdims=True), share)
    phi /= phi.sum(0)
    moves = moves + PRIOR * hmm.move
    start = start + PRIOR / k
    return Hmm(start / start.sum(), moves / moves.sum(1, keepdims=True), _ratios(phi, vocab.mass), share)


@dataclass
class Emissions:
    """Of the words without an emission of their own in training: what the shards hold, the frequent ones' values, and the scale.

    ``table`` has rows (shard, words, counts, held), numbers packed, words ascending. A word's ratio is
    ``scale`` times its row of held; a word that training has not seen has 1 there.
    """

    table: DataFrame
    frequent: np.ndarray
    scale: np.ndarray


def emissions(blocks: DataFrame, shared, hmm: Hmm, shards: int) -> Emissions:
    """One pass over the training texts: how often each state gave each word beyond the ``OWN`` most frequent ones."""
    spark, vocab, states = blocks.sparkSession, shared.value, len(hmm.start)
    share = np.full(states, 1 / states) if hmm.share is None else hmm.share
    model = spark.sparkContext.broadcast(hmm)

    def run(batches):
        vocab_, hmm_ = shared.value, model.value
        heavy = len(vocab_.words)
        for row in _rows(batches):
            others = np.frombuffer(row["others"], np.uint64)
            size = heavy + len(others)
            times, given = np.zeros(size, np.int64), np.zeros((size, states))
            for codes, first in _groups(row, False):
                gamma = posteriors(hmm_, vocab_.classes_of(codes), first)[2]
                times += np.bincount(codes, minlength=size)
                for s in range(states):
                    given[:, s] += np.bincount(codes, gamma[:, s], size)
            seen = np.flatnonzero(times)
            seen = seen[seen >= min(OWN, heavy)]
            if len(seen):
                words = np.where(seen < heavy, np.append(vocab_.words, np.uint64(0))[np.minimum(seen, heavy)], np.append(others, np.uint64(0))[np.maximum(seen - heavy, 0)])
                order = np.argsort(words)
                names, packed = _sharded(shards, words[order], times[seen][order], given[seen][order].astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(p, pa.binary()) for p in packed)], names=["shard", "words", "counts", "given"])
        give_back()

    def total(table: pa.Table) -> pa.Table:
        given = _joined(table["given"], np.float32).reshape(-1, states)
        words, counts, given = _merged([(_joined(table["words"], np.uint64), _joined(table["counts"], np.int64), given)])
        held = _held(given, counts[:, None], share)
        mass = ((counts + ALPHA)[:, None] / vocab_divisor * held).sum(0)
        values = words, counts.astype(np.int64), held.astype(np.float32), mass
        return pa.table({"shard": table["shard"][:1], **{n: pa.array([v.tobytes()], pa.binary()) for n, v in zip(("words", "counts", "held", "mass"), values, strict=True)}})

    vocab_divisor = vocab.divisor
    found = blocks.select("block", "held", "sizes", "codes", "others").mapInArrow(run, "shard long, words binary, counts binary, given binary")
    table = materialize(found.groupBy("shard").applyInArrow(total, "shard long, words binary, counts binary, held binary, mass binary"), "lm-emissions", **SMALL_GROUPS)
    model.unpersist()
    # the words share what the model gives to all of them, in proportion to p(w) * held; the unseen one has held 1
    beyond = hmm.ratio[OWN:] * vocab.mass[OWN:, None]
    masses = [np.frombuffer(r.mass, np.float64) for r in table.select("mass").collect()]
    scale = beyond.sum(0) / (np.sum(masses, axis=0) + ALPHA / vocab.divisor)
    return Emissions(table, _of_frequent(table, shared, states), scale)


def _of_frequent(table: DataFrame, shared, states: int) -> np.ndarray:
    """The emissions of the broadcast words that have one, by their rows; 1 for the others."""

    def run(batches):
        for row in _rows(batches):
            at = shared.value.index.find(np.frombuffer(row["words"], np.uint64))
            held = np.frombuffer(row["held"], np.float32).reshape(-1, states)[at >= 0]
            yield pa.RecordBatch.from_arrays([pa.array(at[at >= 0].astype(np.int64)), *(pa.array(np.ascontiguousarray(held[:, s])) for s in range(states))], names=["row", *(f"h{s}" for s in range(states))])

    got = table.select("words", "held").mapInArrow(run, ", ".join(["row long", *(f"h{s} float" for s in range(states))])).toArrow()
    out = np.ones((len(shared.value.words), states), np.float32)
    if len(got):
        out[got["row"].to_numpy()] = np.stack([got[f"h{s}"].to_numpy() for s in range(states)], 1)
    return out


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, ratio double"


def _scored(blocks: DataFrame, shared, hmm: Hmm, found: Emissions, shards: int) -> DataFrame:
    """Rows SCORED of all texts. Blocks ask the shards for their other words; answers come back a block."""
    spark, states = blocks.sparkSession, len(hmm.start)
    vocab = shared.value
    ratio = np.where(np.arange(len(vocab.words))[:, None] < OWN, hmm.ratio[vocab.classes], found.scale * found.frequent) if len(vocab.words) else np.zeros((0, states))
    model = spark.sparkContext.broadcast((Hmm(hmm.start, hmm.move, ratio.astype(np.float32)), found.scale))

    def ask(batches):
        for row in _rows(batches):
            words = np.frombuffer(row["others"], np.uint64)
            if len(words):
                names, packed = _sharded(shards, words)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([row["block"]] * len(names), pa.int64()), pa.array(packed[0], pa.binary())], names=["shard", "block", "words"])

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        words, counts = _joined(held["words"], np.uint64), _joined(held["counts"], np.int64)
        values = _joined(held["held"], np.float32).reshape(-1, states)
        blocks_, wanted, got_c, got_h = [], [], [], []
        for block, packed in zip(asked["block"].to_pylist(), asked["words"], strict=True):
            ask_ = np.frombuffer(packed.as_buffer(), np.uint64)
            c, h = np.zeros(len(ask_), np.int64), np.ones((len(ask_), states), np.float32)
            if len(words):
                at = np.minimum(np.searchsorted(words, ask_), len(words) - 1)
                same = words[at] == ask_
                c[same], h[same] = counts[at[same]], values[at[same]]
            blocks_.append(block)
            wanted.append(ask_.tobytes())
            got_c.append(c.tobytes())
            got_h.append(h.tobytes())
        return pa.table({"block": pa.array(blocks_, pa.int64()), "words": pa.array(wanted, pa.binary()), "counts": pa.array(got_c, pa.binary()), "held": pa.array(got_h, pa.binary())})

    def score_block(texts: pa.Table, answers: pa.Table) -> pa.Table:
        vocab_, (hmm_, scale) = shared.value, model.value
        parts = []
        words, counts = _joined(answers["words"], np.uint64), _joined(answers["counts"], np.int64)
        order = np.argsort(words)
        held = _joined(answers["held"], np.float32).reshape(-1, states)[order]
        c = np.concatenate([vocab_.counts, counts[order]])
        logs = np.log10((c + ALPHA) / vocab_.divisor)
        whole = Hmm(hmm_.start, hmm_.move, np.concatenate([hmm_.ratio, scale * held]))
        for row in texts.to_pylist():
            ids, known, out_of = (np.frombuffer(row[n], kind) for n, kind in (("doc_ids", np.int64), ("known_ids", bool), ("held", bool)))
            done = 0
            for codes, first in _groups(row, True):
                n = len(first) - 1
                of = np.repeat(np.arange(n), np.diff(first))
                now = slice(done, done + n)
                parts.append(
                    pa.table({
                        "doc_id": pa.array(ids[now], mask=~known[now]), "held_out": out_of[now], "n_tokens": np.diff(first),
                        "n_known": np.bincount(of, c[codes] > 0, n).astype(np.int64), "base": np.bincount(of, logs[codes], n), "ratio": log_ratio(whole, codes, first) / np.log(10),
                    })
                )
                done += n
        return pa.concat_tables(parts)

    asked = blocks.select("block", "others").mapInArrow(ask, "shard long, block long, words binary")
    answers = asked.groupBy("shard").cogroup(found.table.select("shard", "words", "counts", "held").groupBy("shard")).applyInArrow(answer, "block long, words binary, counts binary, held binary")
    answers = answers.withColumnRenamed("held", "held_values").select("block", "words", "counts", F.col("held_values").alias("held"))
    return blocks.drop("others").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score_block, SCORED)


def score(docs: DataFrame, held_out: Column, states: int = STATES, iterations: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text), learning from the rows that are not held out.

    Result: doc_id, held_out, n_tokens (words and the end), n_known (tokens seen in training),
    train_tokens, base_score (sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1)))), score (the
    model's log10 probability of the text).

    Defined results: a null or empty text is the end token alone; a null ``held_out`` counts as
    false; repeated rows are each scored (and counted in training each time); equal counts at the
    edge of the frequent words stay together beyond it; an empty table gives an empty table; without
    training rows every token is unseen; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shards = shards_for(rows)
    counts = materialize(count_words(rows.where(~F.col("held_out")), shards), "lm-counts", **SMALL_GROUPS)
    shared = spark.sparkContext.broadcast(vocabulary(counts, heavy))
    free()
    blocks = materialize(encode(rows, shared), "lm-blocks", **SMALL_GROUPS)
    hmm = _trained(blocks, shared, states, iterations)
    found = emissions(blocks, shared, hmm, shards)
    free()
    out, base = _scored(blocks, shared, hmm, found, shards), F.col("base")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(shared.value.n).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("ratio")).alias("score"))
