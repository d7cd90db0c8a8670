"""Language identification, word first.

A word (a run of letters, lower case) that the training documents know is scored by its log
frequency in each language. An unseen word falls back to its character 5-grams, marked where they
begin or end the word; if none of them is known, to 4-grams, and so on down to single letters.
A document's score per language is the sum over all its words.

The model is fitted on a bounded sample of the labelled rows: ``TRAIN_DOCS`` documents in
expectation (all, where there are fewer), chosen by a hash of their id. It keeps the most frequent
words (about ``WORDS``) and n-grams of each length (about ``GRAMS``), so what is broadcast has a fixed
size for a given number of languages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, give_back, materialize, project, string_column
from .textops import hash_spans, mix, spans

TRAIN_DOCS = 10_000
WORDS = 100_000
GRAMS = 40_000
LONGEST = 5
SMOOTH = 0.1
#: Words after which more text no longer sharpens the score.
FULL_WORDS = 12
#: Characters handled at once; longer texts are taken in pieces, cut between words.
PIECE = 1 << 18
UNDETERMINED = "und"

_tables: dict = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its hash value."""
    if not _tables:
        _tables["alpha"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _tables["value"] = mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x51ED270B)) | np.uint64(1)
    return _tables["alpha"], _tables["value"]


def _pieces(texts) -> list[tuple[list[int], list[str]]]:
    """Rows' lower-cased texts in groups of about PIECE characters."""
    groups, rows, parts, held = [], [], [], 0
    for i, text in enumerate(texts):
        text = (text or "").lower()
        while text:
            cut = len(text)
            if cut > PIECE:
                cut = max(text.rfind(" ", 0, PIECE), text.rfind("\n", 0, PIECE)) + 1 or PIECE
            rows.append(i)
            parts.append(text[:cut])
            held, text = held + cut, text[cut:]
            if held >= PIECE:
                groups.append((rows, parts))
                rows, parts, held = [], [], 0
    if rows:
        groups.append((rows, parts))
    return groups


def _words(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, word starts, ends, word hashes, and the part each word is in."""
    alpha, value = _letters()
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    starts, ends, first = spans(points, offsets, alpha)
    return points, starts, ends, hash_spans(points, starts, ends, value), np.repeat(np.arange(len(parts)), np.diff(first))


def _grams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the words, and the index of each one's word."""
    value = _letters()[1]
    many = np.maximum(ends - starts - n + 1, 0)
    word = np.repeat(np.arange(len(starts)), many)
    inside = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)
    at = starts[word] + inside
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + value[points[at + k]]
    h += (inside == 0).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + (inside == many[word] - 1).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    return mix(h), word


def _count(batches):
    """Counts of words (n = 0) and n-grams by language, combined within each piece."""
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for rows, parts in _pieces(t.as_py() for t in string_column(batch.column(0))):
            points, starts, ends, words, part = _words(parts)
            names, code = np.unique(langs[np.array(rows)].astype(str), return_inverse=True)
            lang = code[part]
            for n in range(LONGEST + 1):
                keys, word = (words, np.arange(len(words))) if n == 0 else _grams(points, starts, ends, n)
                of = lang[word]
                for k, name in enumerate(names):
                    h, c = np.unique(keys[of == k], return_counts=True)
                    if len(h):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n)), pa.array(h.view(np.int64)), pa.array([str(name)] * len(h)), pa.array(c.astype(np.int64))], names=["n", "h", "lang", "c"])


class Model:
    """Per n: sorted keys and a row of log frequencies by language for each."""

    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]]):
        self.langs, self.tables = langs, tables

    def look_up(self, n: int, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        known = self.tables[n][0]
        if not len(known):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, at, -1)

    def _sums(self, n: int, rows: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
        hit = rows >= 0
        values = self.tables[n][1][rows[hit]]
        return np.stack([np.bincount(owner[hit], values[:, k], owners) for k in range(len(self.langs))], 1) if len(self.langs) else np.zeros((owners, 0))

    def word_scores(self, points, starts, ends, words) -> np.ndarray:
        """Per word and language: the log frequency at the longest level that knows it; 0 if none does."""
        out = np.zeros((len(words), len(self.langs)))
        rows = self.look_up(0, words)
        out[rows >= 0] = self.tables[0][1][rows[rows >= 0]]
        left = np.flatnonzero(rows < 0)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            keys, word = _grams(points, starts[left], ends[left], n)
            rows = self.look_up(n, keys)
            known = np.bincount(word[rows >= 0], minlength=len(left))
            sums = self._sums(n, rows, word, len(left))
            done = known > 0
            out[left[done]] = sums[done] / known[done, None]
            left = left[~done]
        return out

    def predict(self, texts: list) -> list[tuple[str, float]]:
        """Language and score (0 to 1) of each text."""
        total, n_words = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for rows, parts in _pieces(texts):
            points, starts, ends, words, part = _words(parts)
            row = np.array(rows)[part]
            scores = self.word_scores(points, starts, ends, words)
            n_words += np.bincount(row, minlength=len(texts))
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(row, scores[:, k], len(texts))
        out = []
        for scores, n in zip(total, n_words, strict=True):
            if n == 0 or not self.langs:
                out.append((UNDETERMINED, 0.0))
                continue
            scaled = scores * (min(n, FULL_WORDS) / n)
            chance = np.exp(scaled - scaled.max())
            best = int(np.argmax(chance))
            out.append((self.langs[best], float(chance[best] / chance.sum())))
        return out


def _frequent(totals: DataFrame) -> Column:
    """Which rows (n, h, c) are among the most frequent of their level.

    The counts that occur, few of them, tell the least count a level has room for; of the words that have
    just that count, a share fixed by their hash is taken. No task gathers a level.
    """
    ladder: dict[int, list[tuple[int, int]]] = {}
    for row in totals.groupBy("n", "c").agg(F.count("*").alias("rows")).collect():
        ladder.setdefault(row.n, []).append((row.c, row.rows))
    kept = F.lit(False)
    for n, steps in ladder.items():
        room, least, share = WORDS if n == 0 else GRAMS, 0, 0.0
        for c, rows in sorted(steps, reverse=True):
            least = c
            if rows > room:
                share = room / rows
                break
            least, share, room = c, 1.0, room - rows
        edge = F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < int(share * (1 << 20))
        kept |= (F.col("n") == n) & ((F.col("c") > least) | ((F.col("c") == least) & edge))
    return kept


def fit(docs: DataFrame, where: Column | None = None, train_docs: int = TRAIN_DOCS) -> Model:
    """The model from rows of ``docs`` (text, lang, doc_id) that hold both, and meet ``where``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = project(docs.where(where) if where is not None else docs, doc_id="long", text="string", lang="string").where("text is not null and lang is not null")
    n = rows.count()
    if n > train_docs:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(train_docs / n * (1 << 20)))
    counts = rows.select("text", "lang").mapInArrow(_count, "n long, h long, lang string, c long").groupBy("n", "h", "lang").agg(F.sum("c").alias("c"))
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    totals = counts.groupBy("n", "h").agg(F.sum("c").alias("c"), *[F.sum(F.when(F.col("lang") == name, F.col("c")).otherwise(0)).alias(f"c{k}") for k, name in enumerate(langs)])
    totals = materialize(totals, "langid-counts", few=True)  # read twice: for the least counts, and for what reaches them
    table = totals.where(_frequent(totals)).toArrow() if langs else pa.table({"n": pa.array([], pa.int64()), "h": pa.array([], pa.int64())})
    level, h = table["n"].to_numpy(), table["h"].to_numpy().view(np.uint64)
    freq = np.stack([table[f"c{k}"].to_numpy() for k in range(len(langs))], 1).astype(float) if langs else np.zeros((0, 0))
    tables = []
    for k in range(LONGEST + 1):
        mine = level == k
        order = np.argsort(h[mine])
        c = freq[mine][order]
        tables.append((h[mine][order], np.log((c + SMOOTH) / (c.sum(0) + SMOOTH * (len(c) + 1))).astype(np.float32)))
    return Model(langs, tables)


def identify(docs: DataFrame, model: Model, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language of each whole text and its score.

    Only the text is read. Defined results: ``und`` and score 0 for a text that is null or has no
    letter (or if the model has no language); equal scores go to the language first in
    alphabetical order; repeated rows are each predicted alike; other columns pass through (those
    named like the two new ones are replaced); an empty table gives an empty table; long texts are
    read whole, in pieces. One narrow pass.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = docs.drop(pred, score)
    schema = T.StructType([*kept.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = shared.value.predict([t.as_py() for t in string_column(batch.column(batch.schema.names.index("text")))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=schema.names)
        give_back()

    return kept.mapInArrow(run, schema)
