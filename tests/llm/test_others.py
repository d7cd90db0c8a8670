"""Decontamination, packing, language ID, language-model scores, archives and the pipeline."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import decontaminate, langid, lm, packing, warc
from tickerloom.llm.common import crc_remainder

from .conftest import PROSE


def edits(a, t):
    """Least edit distance of ``a`` to any stretch of ``t``, by the plain table, a row at a time."""
    t, at = np.frombuffer(t, np.uint8), np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, np.int64)
    for i, x in enumerate(a, 1):
        new = np.r_[i, np.minimum(row[1:] + 1, row[:-1] + (t != x))]
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def test_best_distance():
    r = random.Random(1)
    for _ in range(60):
        p = bytes(r.choice(b"abc") for _ in range(r.randint(0, 30)))
        t = bytes(r.choice(b"abc") for _ in range(r.randint(0, 40)))
        assert decontaminate.best_distance(p, t)[0] == edits(p, t)


def _bench(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


def test_recall_of_edited_copies(spark):
    items = [(r.item_id, r.text) for r in _bench(spark).collect()]
    block, r, hit = decontaminate.Items(items), random.Random(2), 0
    texts, wanted = [], []
    for k in range(120):
        i, text = r.choice(items)
        words = text.split(" ")
        copy = " ".join(r.choice(["xyz", "thon", ""]) if r.random() < 0.06 else w for w in words)
        texts.append(" ".join(f"p{k}q{j}" for j in range(50)) + " " + copy + " tail of the text.")
        wanted.append(i)
    for found, i in zip(block.leaks(pa.array(texts)), wanted, strict=True):
        hit += i in [f[0] for f in found]
    assert hit / 120 >= 0.95
    assert not any(block.leaks(pa.array([" ".join(f"p{j}" for j in range(500)), PROSE[0]])))


def _plain(text):
    return " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())).encode()


def _at_random(r, text, rate):
    out = []
    for c in text:
        kind = r.randrange(3) if r.random() < rate else 3
        out += [[r.choice("abcdefghij klmnop")], [], [c, r.choice("abcdefghij klmnop")], [c]][kind]
    return "".join(out)


def _in_words(r, text, every, insert):
    words = text.split(" ")
    for k in range(0, len(words), every):
        at = r.randrange(len(words[k]) + insert) if len(words[k]) + insert else 0
        words[k] = words[k][:at] + "x" + words[k][at + 1 - insert :]
    return " ".join(words)


@pytest.mark.parametrize("edit", [0.06, 0.1, 0.14, 0.18, 0.2, "insert 3", "substitute 3", "insert 2", "substitute 2", "substitute 1"])
def test_recall_up_to_the_bound(spark, edit):
    """Of edited copies that brute-force edit distance puts within the bound, nine in ten are found, however the edits lie."""
    items = [(r.item_id, r.text) for r in _bench(spark).collect()]
    block, r = decontaminate.Items(items), random.Random(str(edit))
    docs = [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect() if x.text]
    texts, wanted = [], []
    for _ in range(150):
        i, text = r.choice(items)
        copy = _at_random(r, text, edit) if isinstance(edit, float) else _in_words(r, text, int(edit[-1]), edit[0] == "i")
        around = r.choice(docs)[:400], r.choice(docs)[:400]
        whole = f"{around[0]} {copy} {around[1]}"
        if edits(_plain(text), _plain(whole)) <= decontaminate.MAX_EDIT * len(_plain(text)):
            texts.append(whole)
            wanted.append(i)
    found = block.leaks(pa.array(texts))
    assert len(texts) >= 60 or edit in (0.2, "substitute 1", "insert 2", "substitute 2")
    hit = sum(i in [f[0] for f in leaks] for leaks, i in zip(found, wanted, strict=True))
    assert hit >= 0.9 * len(texts), (hit, len(texts))
    for text, leaks, i in zip(texts, found, wanted, strict=True):
        for item_id, distance, start, stop in leaks:
            if item_id == i:
                assert distance == edits(_plain(dict(items)[i]), _plain(text)) and 0 <= start < stop <= len(_plain(text)) + 1


def _filler(r, size):
    """Items of prose in which common words come back, ``size`` characters in all."""
    common = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    out, n = [], 0
    while n < size:
        out.append((10**6 + len(out), " ".join(r.choice(common) for _ in range(r.randint(20, 60)))))
        n += len(out[-1][1])
    return out


@pytest.mark.parametrize("size", [0, 300_000, 2_000_000])
@pytest.mark.parametrize("edit", [0.06, 0.14, 0.18])
def test_recall_does_not_fall_with_the_benchmark(spark, edit, size):
    items = [(r.item_id, r.text) for r in _bench(spark).collect()]
    r = random.Random(f"{edit} {size}")
    block = decontaminate.Items(items + _filler(r, size))
    texts, wanted = [], []
    for _ in range(120):
        i, text = r.choice(items)
        copy = _at_random(r, text, edit)
        if edits(_plain(text), _plain(copy)) <= decontaminate.MAX_EDIT * len(_plain(text)):
            texts.append(f"{PROSE[0]} {copy} {PROSE[1]}")
            wanted.append(i)
    hit = sum(i in [f[0] for f in leaks] for leaks, i in zip(block.leaks(pa.array(texts)), wanted, strict=True))
    assert len(texts) >= 60 and hit >= 0.9 * len(texts), (hit, len(texts))


@pytest.mark.parametrize("n", [20, 60, 300])
def test_recall_of_edited_items_that_share_a_template(n):
    """The template is left alone, the words of an item's own are edited."""
    r = random.Random(n)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))
    template = "read the passage below and choose the one statement that follows from what the author says"
    own = [" ".join(word() for _ in range(18)) for _ in range(n)]
    block = decontaminate.Items([(i, f"{template} {o}") for i, o in enumerate(own)])
    texts, wanted = [], []
    for k in range(120):
        i, every = r.randrange(n), 4 + k % 3
        copy = f"{template} {''.join('x' if j % every == 0 and c != ' ' else c for j, c in enumerate(own[i]))}"
        if edits(f"{template} {own[i]}".encode(), copy.encode()) <= int(decontaminate.MAX_EDIT * len(f"{template} {own[i]}")):
            texts.append(f"{PROSE[0]} {copy} {PROSE[1]}")
            wanted.append(i)
    hit = sum(i in [f[0] for f in leaks] for leaks, i in zip(block.leaks(pa.array(texts)), wanted, strict=True))
    assert len(texts) >= 100 and hit >= 0.9 * len(texts), (hit, len(texts))


def test_edited_copies_with_a_benchmark_in_blocks(spark, monkeypatch):
    """What is found does not depend on how items are dealt to blocks."""
    r = random.Random(12)
    items = [(x.item_id, x.text) for x in _bench(spark).collect()]
    rows = [(k, f"{PROSE[0]} {_at_random(r, items[k % len(items)][1], 0.12)} {PROSE[1]}") for k in range(80)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = []
    for limit in (2 << 20, 4000):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        found.append({(x.doc_id, tuple(sorted(leak.item_id for leak in x.leaks))) for x in decontaminate.find_leaks(docs, bench).collect()})
    assert found[0] == found[1]
    wanted = {k: items[k % len(items)][0] for k, t in rows if edits(_plain(items[k % len(items)][1]), _plain(t)) <= decontaminate.MAX_EDIT * len(_plain(items[k % len(items)][1]))}
    hit = sum(wanted[k] in ids for k, ids in found[0] if k in wanted)
    assert hit >= 0.9 * len(wanted)


def test_items_that_share_a_phrase():
    """A phrase of many items opens no windows for items with words of their own; the work stays linear."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))
    phrase = "which of the following statements about the passage is not true"
    items = [(i, f"{phrase} {' '.join(word() for _ in range(25))}") for i in range(2000)]
    block = decontaminate.Items(items)
    texts = pa.array([f"{word()} {phrase} {word()} {k}" for k in range(200)] + [items[7][1], items[1999][1].upper()])
    values, _ = decontaminate.plain_texts(texts)
    assert sum(len(found[0]) for found in block.opened(values)) < 5 * len(texts)
    assert [[leak[:2] for leak in leaks] for leaks in block.leaks(texts)][-3:] == [[], [(7, 0)], [(1999, 0)]]


def test_short_and_odd_items():
    rows = [(1, "ab"), (2, "a" * 300), (3, "Yes, no?"), (4, ""), (5, "!!"), (6, "yes no")]
    block = decontaminate.Items(rows)
    got = block.leaks(pa.array(["x ab y", "a" * 500, "say YES... no!", "", "\0", "ab", "yes", None]))
    assert [[leak[:2] for leak in leaks] for leaks in got] == [[(1, 0)], [(2, 0)], [(3, 0), (6, 0)], [], [], [(1, 0)], [], []]
    assert decontaminate.Items([]).leaks(pa.array(["a"])) == [[]]


def test_leaks(spark, frame, odd_rows, monkeypatch):
    bench = spark.createDataFrame([(7, PROSE[0]), (8, PROSE[0]), (9, None), (10, ""), (None, "two words")], "item_id long, text string")
    plain = lambda s: " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (s or "").lower()))
    for limit in (1 << 20, 40):  # also in blocks
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        got = decontaminate.find_leaks(frame(odd_rows, clash=True), bench).collect()
        for r in got:
            ids = {leak.item_id for leak in r.leaks}
            want = {i for i, t in ((7, PROSE[0]), (8, PROSE[0]), (None, "two words")) if plain(t) in plain(r.text)}
            assert ids == want
    assert decontaminate.report(frame(odd_rows).limit(0), bench).count() == 0
    assert decontaminate.report(frame(odd_rows), bench.limit(0)).where("contaminated").count() == 0


def test_best_fit_is_best_fit():
    r = random.Random(4)
    for _ in range(30):
        items = sorted(((r.randint(0, 50), r.choice("abcdef") if r.random() < 0.9 else None, r.randint(0, 20) if r.random() < 0.9 else None) for _ in range(80)), key=lambda x: -x[0])
        bins, offsets, filled = packing.best_fit(*zip(*items, strict=True), 60)
        held = []
        for (n, s, c), b, o in zip(items, bins, offsets, strict=True):
            fits = [(60 - h["n"], i) for i, h in enumerate(held) if h["n"] + n <= 60 and (s is None or s not in h["s"]) and (c is None or c not in h["c"])]
            want = min(fits)[1] if fits else len(held)
            if want == len(held):
                held.append({"n": 0, "s": set(), "c": set()})
            assert (b, o) == (want, held[want]["n"])
            held[want]["n"] += n
            held[want]["s"].add(s)
            held[want]["c"].add(c)
        assert filled == [h["n"] for h in held]


def test_packing(spark, frame, odd_rows):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    got = packing.pack_documents(frame(odd_rows, clash=True), path, capacity=64, shard_rows=4).collect()
    assert len({(r.doc_id) for r in got}) == len({r[0] for r in odd_rows})
    by_bin = collections.defaultdict(list)
    for r in got:
        by_bin[r.shard, r.bin].append(r)
    for rows in by_bin.values():
        rows.sort(key=lambda r: (r.offset, r.n_tokens))
        assert rows[0].offset == 0 and all(a.offset + a.n_tokens == b.offset for a, b in zip(rows, rows[1:], strict=False))
        assert sum(r.n_tokens for r in rows) == rows[0].bin_tokens <= 64
    assert packing.pack_documents(frame(odd_rows).limit(0), path).count() == 0


def test_packing_deals_out_hot_ids(spark):
    """Equal rows, with one id or none, and many rows of one id: no shard holds more than its share."""
    ids = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.lit(8))
    lengths = F.when(F.col("id") % 3 == 1, F.col("id") % 1000).otherwise(F.lit(5))
    items = spark.range(60_000).select(ids.alias("doc_id"), lengths.alias("n_tokens"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("cluster"))
    got = packing.pack(items, shard_rows=500)
    shards = [r.n for r in got.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert sum(shards) == 60_000 and max(shards) <= 8 * 500 and len(shards) >= 60
    counts = {r.doc_id: (r.n, r.t) for r in got.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}
    assert counts[7] == counts[None] == (20_000, 100_000) and counts[8][0] == 20_000
    bins = got.groupBy("shard", "bin").agg(F.sum("n_tokens").alias("t"), F.max("bin_tokens").alias("b"))
    assert bins.where(f"t <> b OR b > {packing.CAPACITY}").count() == 0


def test_near_copies_never_share_a_sequence(spark, frame):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    words = [f"word{i}" for i in range(60)]
    one_word = " ".join([*words[:59], "other"])
    copies = [" ".join(words), " ".join(words).upper(), "  ".join(words), "\n".join(words), one_word]
    rows = [(i, t, None, None) for i, t in enumerate(copies)] + [(10 + i, f"short text {i}", None, None) for i in range(5)]
    rows += [(7, copies[0], None, None), (7, "unlike all others", None, None), (None, copies[1], None, None), (20, " \t", None, None), (21, " \t", None, None)]
    got = packing.pack_documents(frame(rows), path).collect()
    assert len(got) == len(rows)
    bins = collections.Counter((r.shard, r.bin) for r in got if r.n_tokens > 50)
    assert len(bins) == sum(bins.values()) == 7
    assert len({(r.shard, r.bin) for r in got if r.doc_id in (20, 21)}) == 2


def test_language(spark, frame, odd_rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = crc_remainder("doc_id", 5) == 0
    model = langid.fit(docs, ~held)
    got = langid.identify(docs.where(held), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97 and all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in langid.identify(frame(odd_rows, clash=True), model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (1, 2, 3, 9, 12))
    assert langid.identify(frame(odd_rows).limit(0), model).count() == 0
    nothing = langid.fit(frame([(1, None, "en")]))
    assert [r.lang_pred for r in langid.identify(frame([(1, "abc")]), nothing).collect()] == ["und"]


def test_language_backs_off(spark, frame):
    model = langid.fit(frame([(1, "strength length", "en"), (2, "école élève", "fr")]))
    known, unseen = model.predict(["strength"])[0], model.predict(["lengthy", "élevé"])
    assert known[0] == "en" and [u[0] for u in unseen] == ["en", "fr"]
    assert model.predict(["strength " * (langid.PIECE // 9 + 10)])[0][0] == "en"


def plain_language(train, texts):
    """The scorer in plain Python: words by log frequency, unseen ones by the mean over their longest known n-grams."""
    letters = re.compile(r"[^\W\d_]+")
    counts = [collections.Counter() for _ in range(langid.LONGEST + 1)]

    def grams(word, n):
        return [(i == 0, i == len(word) - n, word[i : i + n]) for i in range(len(word) - n + 1)]

    langs = sorted({lang for _, lang in train})
    for text, lang in train:
        for word in letters.findall(text.lower()):
            counts[0].update([(lang, word)])
            for n in range(1, langid.LONGEST + 1):
                counts[n].update((lang, g) for g in grams(word, n))
    known = [{key for _, key in c} for c in counts]
    total = [{x: sum(v for (lang, _), v in c.items() if lang == x) for x in langs} for c in counts]

    def log(n, lang, key):
        return math.log((counts[n][lang, key] + langid.SMOOTH) / (total[n][lang] + langid.SMOOTH * (len(known[n]) + 1)))

    out = []
    for text in texts:
        words, sums = letters.findall(text.lower()), dict.fromkeys(langs, 0.0)
        for word in words:
            level, keys = 0, [word] if word in known[0] else []
            for n in range(langid.LONGEST, 0, -1):
                if keys:
                    break
                level, keys = n, [g for g in grams(word, n) if g in known[n]]
            for lang in langs:
                sums[lang] += sum(log(level, lang, k) for k in keys) / max(len(keys), 1)
        scale = min(len(words), langid.FULL_WORDS) / max(len(words), 1)
        chance = {x: math.exp((v - max(sums.values())) * scale) for x, v in sums.items()}
        best = max(langs, key=lambda x: chance[x])
        out.append((best, chance[best] / sum(chance.values())))
    return out


def test_language_against_plain_scorer(spark, frame):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.text, r.lang) for r in docs.orderBy("doc_id").limit(25).collect()]
    train = [(t[:3000], x) for t, x in rows if t and x and t.isascii() is not None][:20]
    texts = [t[:400] for t, _ in rows if t and re.search(r"[^\W\d_]", t[:400])] + ["Unbekannt xqz", "éè", "a"]
    model = langid.fit(frame([(i, t, x) for i, (t, x) in enumerate(train)]))
    for (lang, score), (want, chance) in zip(model.predict(texts), plain_language(train, texts), strict=True):
        assert (lang == want or abs(score - chance) < 1e-3) and abs(score - chance) < 1e-3


def test_frequent_words_fit_the_room(spark, monkeypatch):
    monkeypatch.setattr(langid, "WORDS", 50)
    monkeypatch.setattr(langid, "GRAMS", 10)
    table = spark.createDataFrame([(0, i, 5 if i < 20 else 2) for i in range(500)] + [(1, i, i) for i in range(40)] + [(2, 1, 1)], "n long, h long, c long")
    got = [(r.n, r.h) for r in table.where(langid._frequent(table)).collect()]
    assert {h for n, h in got if n == 0} >= set(range(20)) and abs(sum(n == 0 for n, _ in got) - 50) < 20
    assert sorted(h for n, h in got if n == 1) == list(range(30, 40)) and (2, 1) in got


def lm_base(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), "\n"] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    c = collections.Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for t, h in zip(toks, held, strict=True)]


@pytest.mark.parametrize("heavy", [lm.HEAVY, 3])
def test_lm_base(spark, frame, odd_rows, heavy):
    rows = [(r[0], r[1]) for r in odd_rows] + [(i, f"w{i} w{i % 7} The the") for i in range(100, 160)]
    got = lm.score(frame(rows, clash=True), crc_remainder("doc_id", 10) == 0, heavy=heavy).collect()
    shown = sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert shown == sorted((*w[:4], round(w[4], 6)) for w in lm_base(rows))
    assert all(math.isfinite(r.score) for r in got)
    assert lm.score(frame(rows).limit(0), F.lit(False)).count() == 0
    assert lm.score(frame(rows), F.lit(True)).where("n_known > 0 or train_tokens > 0").count() == 0


def test_hmm_is_exact():
    r = np.random.default_rng(5)
    k, x = 3, 7
    hmm = lm.Hmm(r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), r.random((x, k)) + 0.1)
    sizes = [1, 5, lm.RUN, lm.RUN + 1, 3 * lm.RUN + 17]
    first = np.concatenate([[0], np.cumsum(sizes)])
    classes = r.integers(0, x, first[-1])
    got = lm.log_ratio(hmm, classes, first)
    for i, n in enumerate(sizes):
        seq, total = classes[first[i] : first[i] + n], 0.0
        a = hmm.start * hmm.ratio[seq[0]]
        for s in seq[1:]:
            total, a = total + math.log(a.sum()), (a / a.sum()) @ hmm.move * hmm.ratio[s]
        assert abs(got[i] - total - math.log(a.sum())) < 1e-8


def test_baum_welch_counts():
    """Expected counts of short runs against enumeration of all state paths."""
    import itertools

    r = np.random.default_rng(6)
    k, x = 2, 3
    hmm = lm.Hmm(r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), r.random((x, k)) + 0.1)
    first, classes = np.array([0, 3, 7, 8]), r.integers(0, x, 8)
    start, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((x, k))
    for a, b in zip(first[:-1], first[1:], strict=True):
        weights = {}
        for path in itertools.product(range(k), repeat=b - a):
            w = hmm.start[path[0]] * hmm.ratio[classes[a], path[0]]
            for i in range(1, b - a):
                w *= hmm.move[path[i - 1], path[i]] * hmm.ratio[classes[a + i], path[i]]
            weights[path] = w
        for path, w in weights.items():
            p = w / sum(weights.values())
            start[path[0]] += p
            for i, s in enumerate(path):
                emits[classes[a + i], s] += p
                if i:
                    moves[path[i - 1], s] += p
    got = lm.expected(hmm, classes, first)
    for g, w in zip(got, (start, moves, emits), strict=True):
        np.testing.assert_allclose(g, w, atol=1e-10)


def test_training_carries_states_across_runs(monkeypatch):
    r = np.random.default_rng(7)
    k, x = 3, 5
    hmm = lm.Hmm(r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), r.random((x, k)) + 0.1)
    first = np.cumsum([0, 1, 9, 4, 30, 2])
    classes = r.integers(0, x, first[-1])
    whole = lm._counted(hmm, classes, first)
    monkeypatch.setattr(lm, "RUN", 4)
    got = lm.expected(hmm, classes, first)
    for g, w in zip(got, whole[:3], strict=True):
        np.testing.assert_allclose(g, w, atol=1e-10)
    assert abs(got[0].sum() - 5) < 1e-9 and abs(got[1].sum() - (first[-1] - 5)) < 1e-9
    logs = lm.log_ratio(hmm, classes, first).sum()
    assert abs(whole[3] - logs) < 1e-8 and abs(lm._counted(hmm, classes, first)[3] - logs) < 1e-8


def test_training_goes_on_until_the_likelihood_stops_rising(spark, frame, monkeypatch):
    docs = frame([(i, "a b c " * 40 + "x y z " * 40) for i in range(20)])
    vocab = lm.vocabulary(lm.count_words(docs))
    rounds, updated = [], lm._updated
    monkeypatch.setattr(lm, "_updated", lambda *a: rounds.append(1) or updated(*a))
    hmm = lm.train(docs, vocab)
    assert len(rounds) > 3
    words, first = lm.tokens(pa.array(["a b c " * 40 + "x y z " * 40]))
    classes = vocab.classes_of(vocab.index.find(words))
    more = lm.train(docs, vocab, iterations=len(rounds) + 1)
    assert lm.log_ratio(more, classes, first)[0] - lm.log_ratio(hmm, classes, first)[0] < 2 * lm.RISE * len(words)


@pytest.mark.parametrize("heavy", [lm.HEAVY, 30])
def test_every_state_is_a_distribution(spark, frame, monkeypatch, heavy):
    """Over all training words and the unseen one, each state's probabilities sum to one; rare words have emissions of their own."""
    monkeypatch.setattr(lm, "OWN", 8)
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 150)
    r = random.Random(12)
    texts = [" ".join(f"{'xy'[i % 2]}{int(r.paretovariate(0.6)) % 200}" for _ in range(r.randint(1, 60))) for i in range(80)]
    docs = frame(list(enumerate(texts)))
    counts = lm.count_words(docs, 3).cache()
    shared = spark.sparkContext.broadcast(lm.vocabulary(counts, heavy))
    rows = docs.select("doc_id", F.lit(False).alias("held_out"), "text")
    blocks = lm.encode(rows, shared).cache()
    hmm = lm._trained(blocks, shared, 3, 6)
    found = lm.emissions(blocks, shared, hmm, 3)
    vocab, total = shared.value, np.zeros(3)
    have = {}
    for row in found.table.collect():
        words, c, h = (np.frombuffer(row[n], kind) for n, kind in (("words", np.uint64), ("counts", np.int64), ("held", np.float32)))
        have.update(zip(words.tolist(), zip(c.tolist(), h.reshape(-1, 3), strict=True), strict=True))
    for row in counts.collect():
        for w, c in zip(np.frombuffer(row.words, np.uint64).tolist(), np.frombuffer(row.counts, np.int64).tolist(), strict=True):
            at = int(vocab.index.find(np.array([w], np.uint64))[0])
            p = (c + lm.ALPHA) / vocab.divisor
            if 0 <= at < 8:
                total += p * hmm.ratio[vocab.classes[at]]
            else:
                assert have[w][0] == c and (at < 0 or np.allclose(found.frequent[at], have[w][1]))
                total += p * found.scale * have[w][1]
    total += lm.ALPHA / vocab.divisor * found.scale
    np.testing.assert_allclose(total, 1, atol=1e-5)
    assert len(have) + min(8, len(vocab.words)) == vocab.v


@pytest.mark.parametrize(("heavy", "tokens"), [(lm.HEAVY, lm.BLOCK_TOKENS), (30, 200), (0, 50)])
def test_scores_do_not_depend_on_blocks(spark, frame, monkeypatch, heavy, tokens):
    """The score of each text against the forward recursion over its words' ratios, however the work is cut."""
    monkeypatch.setattr(lm, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(lm, "GROUP_TOKENS", tokens // 2)
    r = random.Random(13)
    texts = [" ".join(f"{'xy'[i % 2]}{int(r.paretovariate(0.6)) % 300}" for _ in range(r.randint(0, 80))) for i in range(90)]
    df = frame(list(enumerate(texts)))
    rows = df.select("doc_id", (F.col("doc_id") % 3 == 0).alias("held_out"), "text")
    got = {x.doc_id: x for x in lm.score(df, F.col("doc_id") % 3 == 0, iterations=3, heavy=heavy).collect()}
    shared = spark.sparkContext.broadcast(lm.vocabulary(lm.count_words(rows.where("not held_out"), 2), heavy))
    blocks = lm.encode(rows, shared).cache()
    hmm = lm._trained(blocks, shared, lm.STATES, 3)
    found = lm.emissions(blocks, shared, hmm, 2)
    have = {}
    for row in found.table.collect():
        words, h = np.frombuffer(row.words, np.uint64), np.frombuffer(row.held, np.float32).reshape(-1, lm.STATES)
        have.update(zip(words.tolist(), h, strict=True))
    for i, text in enumerate(texts):
        words, first = lm.tokens(pa.array([text]))
        at = shared.value.index.find(words)
        ratio = np.array([hmm.ratio[shared.value.classes[a]] if 0 <= a < lm.OWN else found.scale * have.get(int(w), np.ones(lm.STATES)) for a, w in zip(at, words, strict=True)])
        want = lm.log_ratio(lm.Hmm(hmm.start, hmm.move, ratio), np.arange(len(words)), first)[0] / math.log(10)
        assert abs(got[i].score - got[i].base_score - want) < 1e-4 * (1 + abs(want)), (i, text)


def test_scores_are_a_function_of_the_table(spark, sf_dir):
    """The query's own path, warm rounds included, whatever the partitions and the order of rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ways = [docs, docs.repartition(7, "doc_id"), docs.repartition(3), docs.orderBy(F.desc("doc_id")).coalesce(1)]
    found = [{r.doc_id: (r.score, r.base_score) for r in lm.score(w, crc_remainder("doc_id", 10) == 0).collect()} for w in ways]
    for other in found[1:]:
        assert other.keys() == found[0].keys()
        assert all(abs(a - b) <= 1e-9 * abs(b) for i, x in other.items() for a, b in zip(x, found[0][i], strict=True))


def test_archives(spark):
    body = "<html>" + "é" * 80
    rows = [(1, "http://a.org/x", body), (2, "https://B.org:8080/y?z=1", body), (3, None, body), (4, "http://a.org/x", None), (5, "http://a.org/x", ""), (None, "bad\r\nurl \x1f", body), (7, "http://[bad", "short"), (8, "http://a.org/x", "short"), (9, "http://c.net", "WARC/1.1\r\n\r\n" + body)]
    rows += [(100 + i, "http://hot.com/", f"{body}{i % 3}") for i in range(700)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as first", "3 as key")).collect()
    first = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(p, first.get(h, p))
    import hashlib

    want = []
    for p, _, h in rows:
        data, f = (h or "").encode(), first.get(h)
        again = p is not None and f is not None and f < p
        want.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", f if again else None))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


class Counted:
    """A file that notes what is read of it."""

    def __init__(self, data):
        self.data, self.reads = data, []

    def read_at(self, n, offset):
        self.reads.append((offset, n))
        return self.data[offset : offset + n]


def test_read_ranges():
    r = random.Random(5)
    data = bytes(r.getrandbits(8) for _ in range(300_000))
    places = sorted((r.randrange(299_000), r.randint(1, 900)) for _ in range(200))
    file = Counted(data)
    assert list(warc.read_ranges(file, places)) == [data[o : o + n] for o, n in places]
    file, far = Counted(bytes(60_000_000)), [(k * 6_000_000 + 5, 1000) for k in range(10)]
    assert [len(x) for x in warc.read_ranges(file, far)] == [1000] * 10 and file.reads == far
    file, near = Counted(bytes(50_000_000)), [(k * 1_000_000, 1_000_000) for k in range(40)]
    assert len(list(warc.read_ranges(file, near))) == 40 and all(n <= warc.READ_BYTES for _, n in file.reads) and len(file.reads) == 10


def test_addresses_of_ranges(tmp_path):
    (tmp_path / "x").write_bytes(b"1")
    assert all(warc.reads_ranges(f"{p}{tmp_path}/x") for p in ("file:", "file://"))
    assert not warc.reads_ranges(f"file:{tmp_path}/y") and not warc.reads_ranges("viewfs://a/b")
    assert warc.range_uri("s3a://b/k") == "s3://b/k" and warc.range_uri("file:/a") == warc.range_uri("file:///a") == "file:///a"


@pytest.mark.parametrize("ranges", [True, False])
def test_look_up_of_few_pages(spark, tmp_path, monkeypatch, ranges):
    """Large pages make several archive files; ten pages are found in them, with and without range reads."""
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    if not ranges:
        monkeypatch.setattr(warc, "reads_ranges", lambda file: False)
    r = random.Random(6)
    big = [f"<p>{r.getrandbits(8 * 300_000):x}</p>" for _ in range(6)] + ["<p>" + "ab " * 1_700_000]
    pages = spark.createDataFrame([(i, f"http://h{i % 5}.org/{i}", big[i] if i < len(big) else f"page {i} " * 30) for i in range(400)], "page_id long, url string, html string").repartition(2)
    base = f"file://{tmp_path}/w"
    warc.write_archives(pages, f"{base}/archives")
    files = warc._listed(spark, f"{base}/archives").select("length").collect()
    assert len(files) >= 4 and max(f.length for f in files) < 3 << 20
    warc.write_index(spark, f"{base}/archives", f"{base}/index")
    wanted = pages.where("page_id in (0, 3, 6, 17, 90, 91, 200, 333, 398, 399)")
    got = warc.read_records(spark, f"{base}/archives", warc.locate(spark.read.parquet(f"{base}/index"), warc.capture_keys(wanted))).collect()
    assert sorted((x.page_id, x.payload_bytes) for x in got) == sorted((x.page_id, len(x.html)) for x in wanted.collect())


def test_index_blocks():
    blocks = []
    entries = sorted((f"k{i // 3:04d}", "f", i, 1) for i in range(2000))
    for low in range(0, 2000, warc.BLOCK):
        part = entries[low : low + warc.BLOCK]
        blocks.append((part[0][0], zlib.compress("\n".join("\x1f".join(map(str, e)) for e in part).encode())))
    d = warc.Directory(blocks)
    for i in range(0, 667):
        assert d.find(f"k{i:04d}") == [(e[1], e[2], e[3]) for e in entries if e[0] == f"k{i:04d}"]
    assert d.find("a") == d.find("k0001x") == d.find("z") == []


def test_pipeline(spark, frame, tmp_path):
    import corpus_pipeline as P

    bench = [(1, PROSE[1])]
    rows = [(1, PROSE[0], "en", "a"), (2, PROSE[0], "en", "b"), (3, "x " + PROSE[1] + " y", "fr", "a"), (4, None, None, "a"), (5, "12 34", None, "a"), (6, PROSE[2] + " mail a@b.com", "de", None), (6, PROSE[2] + " mail a@b.com", "de", None)]
    for extra in (False, True):
        d = tmp_path / str(extra)
        frame(rows, clash=extra).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
        docs = spark.read.parquet(str(d / "documents.parquet"))
        kept = []
        for _, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, str(d)).cache()
            assert docs.columns == P.COLUMNS
            kept.append(sorted(r.doc_id for r in docs.collect()))
        assert kept == [[1, 2, 3, 6, 6], [1, 3, 6], [1, 6], [1, 6]]
        assert {r.doc_id: r.text for r in docs.collect()}[6].endswith("mail <EMAIL>")
        assert sorted({r.doc_id for r in P.run(spark, str(d)).collect()}) == [1, 6]
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(d)).count() == 0
