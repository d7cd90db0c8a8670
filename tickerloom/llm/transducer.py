"""Byte-pair encoding as a transducer with bounded lookahead, and decoding as a state machine.

A pre-token may be as long as its text, so it is not merged whole. From the merge list alone follows a
*sufficient lookahead*: a token boundary that lies further from the end of what has been read than
so many bytes stays, whatever comes. The encoder reads characters in chunks, gives out tokens as soon as they are
stable and keeps no more than a chunk and the lookahead.

Why there is such a bound. Compare the merges on a text and on the same text with something after it,
rule by rule in order of rank, and look at the leftmost boundary d that only one of the two has. It can
move left only by a later rule (u, v) that fires at a boundary d' < d in one of them: left of d both are
equal, so u is the same in both, and what follows d' is a token x that ends at d in one and a longer
one in the other. If the boundary d went by a rule (u', v') before, then x ends with u', and the longer token
goes on with v'. So a shift by the length of x needs v to be x, ending with u', or to be the longer token, holding
u' v' just behind where u' starts; ranks rise along such a chain. ``sufficient_lookahead`` adds up the longest one.
(Incremental tokenization with bounded lookahead: Berglund and van der Merwe, 2023.)
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, string_column, texts
from .tokens import _CUT, _LETTER, _NUMBER, _PLAIN, _SAFE, _STAND_IN, _is_byte_bpe

#: Characters read at once.
CHUNK = 1 << 16
#: A cut is final when so many characters behind it are known.
HOLD = 3
#: A pre-token longer than this at the end of a chunk is merged while it is read.
LONG = 1 << 12
#: Pre-tokens kept merged, in each of two generations, and their greatest length.
MEMO, MEMO_CHARS = 300_000, 64

#: How a pre-token of a kind goes on.
_ON = {"letter": re.compile(f"[{_LETTER}]*"), "number": re.compile(f"[{_NUMBER}]*"), "space": re.compile(r"\s*"), "other": re.compile(rf"[^\s{_LETTER}{_NUMBER}]*")}


def sufficient_lookahead(rules: Iterable[tuple[bytes, bytes]]) -> int:
    """Bytes beyond which a boundary cannot be changed any more, for merge rules in order of rank."""
    behind: dict[bytes, int] = {}  # u of a rule -> the longest chain that ends with it
    joined: dict[bytes, tuple[int, int]] = {}  # u v of a rule -> length of u, the longest chain
    known: set[bytes] = set()
    most = 0
    for u, v in rules:
        known |= {u, v}
        best = max((len(v) + behind[v[o:]] for o in range(len(v)) if v[o:] in behind), default=0)
        for o in range(len(v)):
            for stop in range(o + 2, len(v) + 1):
                if (found := joined.get(v[o:stop])) and v[: o + found[0]] in known:
                    best = max(best, o + found[0] + found[1])
        behind[u] = max(behind.get(u, 0), best)
        joined[u + v] = (len(u), max(best, joined.get(u + v, (0, 0))[1]))
        most = max(most, best)
    return most


class _Memo(dict):
    """Pre-token -> ids; one generation is dropped when the next is full."""

    def __init__(self, merged):
        super().__init__()
        self.merged, self.old = merged, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.old.get(piece)
        if found is None:
            found = tuple(self.merged(piece.encode()))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.old = self.copy()
                self.clear()
            self[piece] = found
        return found


class Merges:
    """A byte-level merge list: merging, the bytes of every id, and the lookahead that is enough."""

    def __init__(self, path: str):
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not _is_byte_bpe(spec):
            raise ValueError(f"{path} is no byte-level merge list with the usual cut")
        self.library = tokenizers.Tokenizer.from_file(path)  # for the cut of unusual characters
        byte = {chr(c): b for b, c in _STAND_IN.items()}
        raw = lambda token: bytes(byte[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.bytes: list[bytes] = [b""] * (max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"]), 0) + 1)
        for token, i in vocab.items():
            self.bytes[i] = raw(token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes[i] = content.encode()
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        self.rules = {(vocab[u], vocab[v]): (rank, vocab[u + v]) for rank, (u, v) in enumerate(pairs)}
        self.single = [vocab[chr(_STAND_IN[b])] for b in range(256)]
        self.lookahead = sufficient_lookahead((raw(u), raw(v)) for u, v in pairs)
        self.memo = _Memo(self.merged)
        self.decimal = [str(i) for i in range(len(self.bytes))]

    def merged(self, data: bytes) -> list[int]:
        """Ids of one pre-token's bytes: always the rule of least rank, from the left."""
        ids = [self.single[b] for b in data]
        n, rules = len(ids), self.rules
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*rule, i, *pair) for i, pair in enumerate(zip(ids, ids[1:])) if (rule := rules.get(pair))]  # noqa: B905
        heap = [(rank, i, new, u, v) for rank, new, i, u, v in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, u, v = heapq.heappop(heap)
            j = after[i]
            if ids[i] != u or j >= n or ids[j] != v:
                continue
            k = after[j]
            ids[i], ids[j], after[i] = new, -1, k
            if k < n:
                before[k] = i
                if rule := rules.get((new, ids[k])):
                    heapq.heappush(heap, (rule[0], i, rule[1], new, ids[k]))
            if (h := before[i]) >= 0 and (rule := rules.get((ids[h], new))):
                heapq.heappush(heap, (rule[0], h, rule[1], ids[h], new))
        return [x for x in ids if x >= 0]

    def stable(self, data: bytes) -> tuple[list[int], bytes]:
        """Ids that any continuation of a pre-token's bytes leaves as they are, and the bytes behind them."""
        ids = self.merged(data)
        at, stops = 0, 0
        for k, i in enumerate(ids):
            if len(data) - (at + len(self.bytes[i])) <= self.lookahead:
                break
            at, stops = at + len(self.bytes[i]), k + 1
        return ids[:stops], data[at:]


class Encoder:
    """Text in chunks -> ids, for text whose characters every implementation of the cut classes alike."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.text = ""  # read, but where it is cut is not certain
        self.tail = b""  # of an open pre-token: bytes whose tokens are not stable
        self.on: re.Pattern | None = None  # how the open pre-token goes on

    def feed(self, chunk: str, last: bool = False) -> list[int]:
        """The ids that have become certain; with ``last`` all that are left."""
        text, out = self.text + chunk, []
        self.text = ""
        if self.on is not None:
            stop = self.on.match(text).end()
            if not last and stop > len(text) - HOLD:
                known = max(0, len(text) - HOLD)
                out, self.tail = self.merges.stable(self.tail + text[:known].encode())
                self.text = text[known:]
                return out
            if self.on is _ON["space"] and stop < len(text):
                stop -= 1  # the last white space goes with the word behind it
            out = self.merges.merged(self.tail + text[:stop].encode())
            text, self.tail, self.on = text[stop:], b"", None
        pieces, held = _CUT.findall(text), ""
        while not last and pieces and len(held) < HOLD:
            held = pieces.pop() + held
        out.extend(chain.from_iterable(map(self.merges.memo.__getitem__, pieces)))
        if len(held) > LONG:
            first = _CUT.match(held).group()
            if len(first) > LONG:
                kind = first[1]
                self.on = next(p for p in _ON.values() if p.match(kind).end())
                ids, self.tail = self.merges.stable(held[:-HOLD].encode())
                out += ids
                held = held[-HOLD:]
        self.text = held
        return out


class Decoder:
    """Ids in chunks -> text: bytes that do not end a character wait for the next ids; impossible ones become U+FFFD."""

    def __init__(self, merges: Merges):
        self.bytes, self.machine = merges.bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        return self.machine.decode(b"".join(map(self.bytes.__getitem__, ids)), last)


@functools.lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    """Loaded once per worker and file."""
    return Merges(path)


def _chunks(m: Merges, text: str) -> Iterator[list[int]]:
    for low in range(0, len(text), CHUNK) if len(text) > CHUNK else ():
        if low == 0:
            encoder = Encoder(m)
        yield encoder.feed(text[low : low + CHUNK], low + CHUNK >= len(text))
    if 0 < len(text) <= CHUNK:
        yield list(chain.from_iterable(map(m.memo.__getitem__, _CUT.findall(text))))


def _unusual(m: Merges, text: str) -> list[int]:
    """Ids of text with characters on which cuts differ: the library cuts, the rules merge."""
    byte = {chr(c): b for b, c in _STAND_IN.items()}
    return list(chain.from_iterable(m.merged(bytes(byte[c] for c in piece)) for piece, _ in m.library.pre_tokenizer.pre_tokenize_str(text)))


def _ordinary(m: Merges, text: str) -> Iterator[list[int]]:
    if _PLAIN.fullmatch(text):
        yield from _chunks(m, text)
        return
    plain = []
    for part in _SAFE.split(text):
        if _PLAIN.fullmatch(part):
            plain.append(part)
            continue
        yield from _chunks(m, "".join(plain))
        plain = []
        yield _unusual(m, part)
    yield from _chunks(m, "".join(plain))


def encode(m: Merges, text: str, special: bool = True) -> Iterator[list[int]]:
    """The library's ids of a text, in pieces. With ``special`` the strings of special tokens are these tokens, else plain text."""
    if not special or not any(s in text for s in m.special):
        yield from _ordinary(m, text)
        return
    for k, part in enumerate(re.split("(" + "|".join(map(re.escape, sorted(m.special, key=len, reverse=True))) + ")", text)):
        if k % 2:
            yield [m.special[part]]
        else:
            yield from _ordinary(m, part)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256 (of the text that the ids decode to).

    Defined results: a null or empty text has no tokens and both hashes are those of nothing; repeated rows come out
    each; a text of any length passes through in chunks; other columns are ignored; an empty table gives an
    empty one. One narrow pass.
    """
    bounded_batches(docs.sparkSession)

    def one(m: Merges, text: str) -> tuple[int, str, str]:
        decoder, n = Decoder(m), 0
        ids_hash, text_hash = hashlib.sha256(), hashlib.sha256()
        for ids in encode(m, text):
            if ids:
                ids_hash.update(("," * (n > 0) + ",".join(map(m.decimal.__getitem__, ids))).encode())
                text_hash.update(decoder.feed(ids).encode())
                n += len(ids)
        text_hash.update(decoder.feed((), True).encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    def run(batches):
        m = merges(path)
        for batch in batches:
            found = [one(m, t.as_py()) for t in string_column(batch.column(1))]
            columns = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
