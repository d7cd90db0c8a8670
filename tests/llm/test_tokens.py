import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from tickerloom.llm.token_store import Dac, dac_encode, read_store, token_store, write_store  # noqa: E402
from tickerloom.llm.tokens import Tokenizer, count_tokens  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return Tokenizer(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'stredlvm.,-!09Aé½—<|>"), st.characters(codec="utf-8")), max_size=60))
def test_same_as_library(own, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert own.ids(text).tolist() == want and own.count(text) == len(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["word", "mot", "слово", "слова", "单词", "a_b", "naïve", "don't", "x\u00a0y", "\u200b", "😀", "½", "9", "é\u0301", "\x1c", "ab\u2028"]), max_size=12), st.sampled_from([" ", "  ", "\n", " \t"]))
def test_mixed_scripts(own, library, words, gap):
    text = " ".join(words) + gap + gap.join(words)
    want = library.encode(text, add_special_tokens=False).ids
    assert own.ids(text).tolist() == want and own.count(text) == len(want)


def test_whole_tokens_are_proven(own, library):
    for piece, i in list(own._whole.items())[::997]:
        assert library.encode(piece, add_special_tokens=False).ids == [i]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_dac(values):
    a = np.array(values, np.uint32)
    d = Dac(dac_encode(a))
    assert len(d) == len(a) and [d[i] for i in range(0, len(a), 7)] == values[::7]
    for i in range(0, len(a) + 1, 131):
        assert (d.slice(i, len(a)) == a[i:]).all()
    with pytest.raises(IndexError):
        d[len(a)]


def test_counts(spark, frame, odd_rows, library):
    df = frame(odd_rows, clash=True)
    got = sorted((r.doc_id or 0, r.n_tokens) for r in count_tokens(df, PATH).collect())
    assert got == sorted((r[0] or 0, len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in odd_rows)
    assert count_tokens(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_kinds(spark, frame, name):
    path, texts = public_tokenizers.path(name), ["Hello there, world!", "", "x y"]
    got = {r.doc_id: r.n_tokens for r in count_tokens(frame(list(enumerate(texts))), path).collect()}
    if name.endswith(".model"):
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    else:
        import tokenizers

        want = [len(tokenizers.Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in texts]
    assert [got[i] for i in range(3)] == want


def test_store(spark, frame, odd_rows, library):
    df = frame(odd_rows, clash=True).repartition(3)
    got = sorted(token_store(df, PATH).collect(), key=lambda r: r.start)
    ids = [(-1 if r[0] is None else r[0], r[1] or "", library.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in odd_rows]
    at = 0
    for r, (doc_id, _, want) in zip(got, sorted(ids), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (None if doc_id < 0 else doc_id, at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    assert token_store(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("text", ["CAST(id % 3 AS string)", "'one and the same text'"])
def test_store_deals_out_hot_ids(spark, tmp_path, text):
    """Rows of one id, equal or not, and rows without any: no part holds more than its share, the order stays."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    docs = spark.range(0, 40_000, 1, 16).selectExpr("CASE WHEN id % 2 = 0 THEN 5 END AS doc_id", f"{text} AS text")
    path = f"file://{tmp_path}/store"
    spark.conf.set(setting, "false")
    try:
        write_store(docs, PATH, path)
    finally:
        spark.conf.set(setting, "true")
    parts = [r.n for r in spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()]
    assert len(parts) == 4 and max(parts) < 0.5 * sum(parts)
    got = sorted(read_store(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 20_000 + [5] * 20_000
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    for part in (got[:20_000], got[20_000:]):
        assert sum(a.ids_crc32 != b.ids_crc32 for a, b in zip(part, part[1:], strict=False)) == (2 if "%" in text else 0)


def test_columns_are_counted_like_texts(library, own):
    """Texts cut together in arrays: ends of texts, white space, contractions, other scripts, special strings, unknown words."""
    r = random.Random(6)
    bits = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", "\r", "1", "23", "a", "Zq", " '", "...", "é", "ß", "…", "½", "日", "\u00a0", "x\x0b", "<|endoftext|>"]
    for known in (19, 23, len(bits)):
        texts = ["", None, "a" * 3000] + ["".join(r.choice(bits[:known]) for _ in range(r.randint(0, 14))) for _ in range(1500)]
        want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
        assert own.count_column(pa.array(texts)).tolist() == want
        assert own.count_column(pa.array(texts).slice(1)).tolist() == want[1:]
