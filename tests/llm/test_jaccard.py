import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tickerloom.llm import jaccard
from tickerloom.llm.components import components


def brute(rows, width, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, x in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(low))
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(repr((d, len(sets[i]), least.get(find(i)))) for i, (d, _) in enumerate(rows))


def got(df, width, percent):
    return sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard.similarity_classes(df, width, percent).collect())


def corpus(seed, n=70):
    """Near copies by chains of edits, a passage that many share, and short texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [r.choice(words) for _ in range(40)]
    out, texts = [], []
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.5:
            t = list(r.choice(texts))
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = r.choice(words)
        elif kind < 0.7:
            t = passage + [r.choice(words) for _ in range(r.randint(0, 30))]
        else:
            t = [r.choice(words) for _ in range(r.choice([1, 2, 3, 8, 15, 60, 200]))]
        texts.append(t)
        out.append((i, " ".join(t)))
    return out


@pytest.mark.parametrize(("seed", "width", "percent", "small", "block"), [(1, 3, 90, 16, 1 << 20), (2, 5, 80, 16, 1 << 20), (3, 5, 80, 2, 99), (4, 3, 90, 2, 99), (5, 2, 70, 3, 999)])
def test_against_brute_force(spark, frame, monkeypatch, seed, width, percent, small, block):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK_ITEMS", block)
    rows = corpus(seed)
    assert got(frame(rows), width, percent) == brute(rows, width, percent)


def test_texts_by_join(spark, frame, monkeypatch):
    monkeypatch.setattr(jaccard, "KEYS_BROADCAST", 0)
    rows = corpus(6, 40)
    assert got(frame(rows), 3, 90) == brute(rows, 3, 90)


def test_odd_rows(spark, frame, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows]
    assert got(frame(odd_rows, clash=True), 5, 80) == brute(rows, 5, 80)
    assert jaccard.similarity_classes(frame(odd_rows).limit(0)).count() == 0
    kept = jaccard.keep_one(frame(odd_rows))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 8, 9, 10, 11, 12, 13, 14]
    assert kept.columns == frame([]).columns


def test_keep_one_of_repeated_ids(spark, frame):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (2, b.upper()), (3, c), (3, a), (4, c), (4, b), (5, ""), (5, None), (6, a), (7, "d e f")]
    kept = jaccard.keep_one(frame(rows, clash=True)).collect()
    assert sorted((r.doc_id, (r.text or "").lower()) for r in kept) == [(1, a), (2, b), (3, c), (5, ""), (7, "d e f")]


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_similar_sets_share_entries(percent):
    r = np.random.default_rng(percent)
    for n in [*range(1, 40), 100, 333]:
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        for _ in range(4):
            lose, gain = r.integers(0, max(1, n * (100 - percent) // 100 + 1), 2)
            b = np.unique(np.concatenate([a[: len(a) - lose], r.integers(0, 2**63, gain).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
                continue
            for level in (0, 1):
                sa, sb = (set(jaccard.signatures(x, percent, 0.3, level).tolist()) for x in (a, b))
                need, met = jaccard.needs(percent, 0.3, level), collections.Counter(s & 127 for s in sa & sb)
                assert any(m >= need[band] for band, m in met.items()), (n, lose, gain)
            assert jaccard.least_difference(jaccard.sketch(a), jaccard.sketch(b)) <= len(a) + len(b) - 2 * both


def test_meetings(monkeypatch):
    """Dealt entries against a plain count of buckets, whatever the shards and the tasks."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    r = random.Random(3)
    for _ in range(60):
        buckets = [r.getrandbits(55) << 8 | 5 for _ in range(r.randint(0, 9))]
        rows = [(s - (1 << 62), k) for s in buckets for k in {r.randint(0, 40) for _ in range(r.choice([1, 2, 4, 5, 9, 30]))} for _ in range(r.choice([1, 2]))]
        r.shuffle(rows)
        shards, tasks = r.choice([1, 3, 50]), r.choice([1, 2, 5])
        by_shard = collections.defaultdict(list)
        for t in range(tasks):
            part = sorted(set(rows[t::tasks]))
            if part:
                sig, k = (np.array([x[i] for x in part], np.int64) for i in range(2))
                for shard, sigs, ks in zip(*(c.to_pylist() for c in jaccard._dealt([(sig.view(np.uint64), k)], shards).columns), strict=True):
                    by_shard[shard].append((np.frombuffer(sigs, np.int64), np.frombuffer(ks, np.int64)))
        pairs, members = collections.Counter(), set()
        for shard, parts in by_shard.items():
            met = jaccard._meet(*(np.concatenate(c) for c in zip(*parts, strict=True)), shard < 0, np.arange(128) + 100)
            for kind, x, y, tag, n in zip(*(c.to_pylist() for c in met.columns), strict=True):
                assert tag == (5 << 32) + 105
                members |= {(x, y)} if kind else set()
                pairs.update({(x, y): n} if not kind else {})
        groups = collections.defaultdict(set)
        for s, k in rows:
            groups[s].add(k)
        assert members == {(s, k) for s, ks in groups.items() if len(ks) > 4 for k in ks}
        want = collections.Counter((a, b) for ks in groups.values() if len(ks) <= 4 for a in ks for b in ks if a < b)
        assert pairs == want


def test_too_many_bands():
    with pytest.raises(ValueError, match="bands"):
        jaccard.signatures(np.arange(20_000, dtype=np.uint64), 99, 0.3)


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 103), (103, 101), (200, 200), (100, 103)]
    got = {r.k: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_components_in_tasks(spark, monkeypatch, most):
    from tickerloom.llm import components as C

    monkeypatch.setattr(C, "TASK_LINKS", most)
    r = random.Random(9)
    links = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(110)] + [(500, 500 + i) for i in range(1, 60)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {x.k: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}


def test_empty_segments_make_no_entries():
    """Unrelated long sets meet nowhere; similar ones meet often enough with the empty segments that are only counted."""
    r = np.random.default_rng(8)
    for level in (0, 1):
        need = jaccard.needs(80, 0.3, level)
        for n in (60, 300, 900):
            a, b = (np.unique(r.integers(0, 1 << 63, n, np.uint64)) for _ in "ab")
            near = np.sort(np.concatenate([a[n // 10 :], b[: n // 10]]))  # 0.82 similar
            found = []
            for x in (a, b, near):
                voids = []
                found.append((set(jaccard.signatures(x, 80, 0.3, level, voids).tolist()), dict(voids)))
            (sa, va), (sb, _), (sn, vn) = found
            assert va and not sa & sb
            met = collections.Counter(int(s) & 127 for s in sa & sn)
            shared = [t for t in va if t in vn and met[t >> 32] + min(va[t], vn[t]) >= need[t >> 32]]
            assert shared


def test_long_entries_are_the_signatures():
    """Entries of many sets at once are those of each alone, and so are fingerprints."""
    r = np.random.default_rng(9)
    found = [np.unique(r.integers(0, 1 << 63, n, np.uint64)) for n in (0, 5, 40, 71, 333, 2000, 333)]
    k, k2, total = jaccard.keyed(found)
    assert [jaccard.set_keys(v) for v in found] == list(zip(k.tolist(), k2.tolist(), strict=True))
    rows = np.array([2, 3, 4, 5, 6])
    sig, counts, voids = jaccard._long_entries(np.concatenate(found), total, np.cumsum([0, *map(len, found)]), rows, 80)
    for i, part, empty in zip(rows, np.split(sig, np.cumsum(counts)[:-1]), voids, strict=True):
        want: list = []
        assert set(jaccard.signatures(found[i], 80, 0.3, 0, want).tolist()) == set(part.tolist())
        assert sorted(empty) == sorted(want)
