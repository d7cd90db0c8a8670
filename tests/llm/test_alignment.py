"""Pre-tokens merged by the library, against the rules, and the plain text that is hashed."""

import random
from itertools import chain

import public_tokenizers

from tickerloom.llm import alignment as A
from tickerloom.llm import transducer as T


def test_library_merges_as_the_rules_do():
    path, r = public_tokenizers.path("byte_bpe_50k.json"), random.Random(3)
    fast, plain = A.byte_merges(path), T.merges(path)
    signs = "abcdeABC 019.,'s\n\t\0é́  中文𝒳<|endoftext|>" + "  "
    text = ["".join(r.choice(signs) for _ in range(r.randrange(80))) for _ in range(500)] + ["x" * 5000, "ab" * 70_000]
    for t in text:
        assert list(chain.from_iterable(T.encode(fast, t, special=False))) == list(chain.from_iterable(T.encode(plain, t, special=False)))


def test_signed_ids_spell_decimals():
    named = A._signed(1205)
    assert named[[0, 9, 1204, 1205 + 10, 2410 + 1204]].tolist() == [b"0,", b"9,", b"1204,", b"10|", b"1204;"]
