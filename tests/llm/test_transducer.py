"""The streaming encoder against the library, its lookahead against brute force, and the alignment against plain loops."""

import collections
import hashlib
import itertools
import random

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from tickerloom.llm import alignment, transducer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPECIAL = [(20, "a<|endoftext|> b<|endoftext|><|endoftext|>", None, None), (21, "low ▁ line", None, None), (22, "日本語、です。 it's   we'll\n\n x", None, None), (23, "\x00﻿  é é \U0001f469‍\U0001f4bb", None, None)]


@pytest.fixture(scope="module")
def merges():
    return transducer.merges(A)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(A)


def _plain(rules, data):
    out = [bytes([b]) for b in data]
    for u, v in rules:
        k = 0
        while k < len(out) - 1:
            if (out[k], out[k + 1]) == (u, v):
                out[k : k + 2] = [u + v]
            k += 1
    return out


def test_lookahead_holds_for_random_rules():
    """No continuation moves a boundary that lies further back than the lookahead."""
    r, moved = random.Random(3), 0
    for _ in range(60):
        known, rules = [b"a", b"b"], []
        for _ in range(r.randint(1, 7)):
            u, v = r.choice(known), r.choice(known)
            if u + v not in known:
                known.append(u + v)
                rules.append((u, v))
        enough = transducer.sufficient_lookahead(rules)
        for _ in range(60):
            p, s = (bytes(r.choice(b"ab") for _ in range(r.randint(0, n))) for n in (30, 8))
            cut = [set(itertools.accumulate(map(len, _plain(rules, x)))) for x in (p, p + s)]
            differ = [d for d in cut[0] ^ cut[1] if d <= len(p)]
            assert all(len(p) - d <= enough for d in differ), (rules, p, s)
            moved += any(d < len(p) for d in differ)
    assert moved > 100


@pytest.mark.parametrize("letters", ["a", "ab", "- =", "0123456789", " ", "\n ", " a", "etaoin '", "é日!"])
def test_chunks_give_what_the_library_gives(merges, library, letters):
    r = random.Random(letters)
    for n, step in ((50, 7), (9000, 1000), (20_000, 5001), (30_000, 30_000)):
        text = "".join(r.choice(letters) for _ in range(n))
        want = library.encode(text, add_special_tokens=False).ids
        assert [i for c in transducer.encode(merges, text) for i in c] == want
        if transducer._PLAIN.fullmatch(text):
            encoder, got, held = transducer.Encoder(merges), [], 0
            for low in range(0, n, step):
                got += encoder.feed(text[low : low + step], low + step >= n)
                held = max(held, len(encoder.tail) + len(encoder.text))
            assert got == want and held <= max(transducer.LONG, merges.lookahead + 200) + step


def test_round_trip_of_documents(spark, sf_dir, frame, odd_rows, library):
    docs = frame(odd_rows + SPECIAL, clash=True).select("doc_id", "text", "n_tokens").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 1000 doc_id", "text", "'x' n_tokens"))
    want = []
    for row in docs.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((row.doc_id, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text))))
    got = [tuple(r) for r in transducer.digest(docs, A).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert transducer.digest(docs.limit(0), A).collect() == []


def test_decoder_waits_for_whole_characters(merges, library):
    ids = library.encode("a\U0001f469‍日é").ids
    decoder = transducer.Decoder(merges)
    assert "".join([decoder.feed([i]) for i in ids] + [decoder.feed((), True)]) == "a\U0001f469‍日é"
    assert decoder.feed(ids[1:2], True) == library.decode(ids[1:2])


def _brute(texts):
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, hash, by loops over tokens."""
    lib, sp, m = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), transducer.merges(A)
    lib.encode_special_tokens = True
    spell = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    links, facts = [], []
    for t in texts:
        groups = []
        if t:
            a, b = lib.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
            ends = [list(itertools.accumulate(len(f(i)) for i in x)) for x, f in ((a, lambda i: m.bytes[i]), (b, spell))]
            if b"".join(map(spell, b)) == (" " + t).encode():
                low = [0, 0]
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    high = [e.index(cut, k) + 1 for e, k in zip(ends, low, strict=True)]
                    groups.append((a[low[0] : high[0]], b[low[1] : high[1]]))
                    low = high
        pairs = collections.Counter(p for x, y in groups for p in itertools.product(x, y))
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        links.append(pairs)
        facts.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), pairs.total(), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    counts = collections.Counter(p for x in links for p in x)
    best = collections.Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [(*f[:4], sum(n for p, n in x.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in x.items()), f[4]) for x, f in zip(links, facts, strict=True)]


def test_alignment_against_loops(spark, sf_dir, frame, odd_rows):
    docs = frame(odd_rows + SPECIAL, clash=True).select("doc_id", "text", "k", "n").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 1000 doc_id", "text", "1L k", "2L n"))
    rows = docs.collect()
    got = [tuple(r) for r in alignment.aligned(docs.repartition(5), A, B).collect()]
    want = [(r.doc_id, *f) for r, f in zip(rows, _brute([r.text for r in rows]), strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 150 and alignment.aligned(docs.limit(0), A, B).collect() == []


def test_wide_groups_and_slices(merges, odd_rows, monkeypatch):
    """Groups counted by distinct ids, and texts in small slices, give the same."""
    text = [t or "" for _, t, *_ in odd_rows + SPECIAL] + [""]
    lengths, p = alignment._lengths(A), alignment.pieces(B)
    whole = alignment._block(1, [*range(len(text))], text, merges, lengths, p)
    monkeypatch.setattr(alignment, "MANY_LINKS", 1)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 300)
    parts = alignment._block(1, [*range(len(text))], text, merges, lengths, p)
    assert parts == whole and sum(whole["n_links"]) > sum(whole["n_groups"]) > 1000
