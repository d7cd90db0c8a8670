"""Token counts with a whole-token shortcut, and token ids of texts.

A byte-level BPE tokenizer cuts a text into pre-tokens and merges inside each one alone, so the
ids of a text are the ids of its pre-tokens in turn. Offline, once per worker, every vocabulary
string is encoded by the library: those that come back as one single token (and are one
pre-token) are *proven* whole. A pre-token among them costs one dictionary look-up; only the
rest is merged by the library, and kept in a bounded memo.

The cut is redone here only for characters on which every implementation of the cut agrees
(``_PLAIN``). A text with others is parted before single spaces between letters or digits, where
every cut parts it too; the parts that hold such characters go to the library, the rest does not. A
text that holds a special token's string, and tokenizers of another kind, are left to the library.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches, string_column
from .textops import hash_spans, mix, raw

#: Pre-tokens that needed merging, kept in each of the memo's two generations.
MEMO = 450_000
#: Longer pre-tokens are not kept in the memo.
MEMO_CHARS = 64

_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
#: Characters whose class is the same for every implementation: ASCII, Latin letters, common punctuation.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e¡-ɏ‐-‧‰-⁞]*")
_CUT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")

#: A place where every implementation of the cut begins a new pre-token, whatever stands around it.
_SAFE = re.compile(r"(?<=\w)(?= \w)")


#: A byte's stand-in in the vocabulary: itself where printable, else the next free one from 256 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
_STAND_IN = {b: b for b in _PRINTED} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}

#: Code points from here on are not plain, and those below by class: white space, letters, numbers, others, not plain.
_TOP = 0x2070
_SPACE, _L, _N, _O, _ODD = range(5)
_CLASS = np.array([_ODD if not _PLAIN.fullmatch(c) else _SPACE if c.isspace() else _L if re.match(f"[{_LETTER}]", c) else _N if re.match(f"[{_NUMBER}]", c) else _O for c in map(chr, range(_TOP))] + [_ODD], np.uint8)
_VALUES = mix(np.arange(_TOP + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x3C6EF372FE94F82B)) | np.uint64(1)
#: Bytes of texts that are cut at once; a longer text is counted by itself.
CUT_BYTES = 1 << 20
#: Slots of the table of pre-tokens' counts, as a power of two.
SLOT_BITS = 21


def cut(points: np.ndarray, kinds: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of plain texts begin: ``_CUT`` for all texts at once, which begin at ``begins`` (none is empty)."""
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[begins] = first[n] = True
    run = first[:n].copy()
    run[1:] |= kinds[1:] != kinds[:-1]
    start = run & (kinds == _SPACE)
    at = np.flatnonzero(run & (kinds != _SPACE))
    spaced = at[~first[at] & (kinds[at - 1] == _SPACE)]  # the last character of white space before a run stands apart or joins it
    start[at] = True
    start[spaced - 1] = True
    start[spaced[points[spaced - 1] == 0x20]] = False
    for p in np.flatnonzero((points == 0x27) & start).tolist():
        if run[p] and p + 1 < n and run[p + 1] and not first[p + 1] and kinds[p + 1] == _L:
            one, two = chr(points[p + 1]), chr(points[p + 2]) if p + 2 < n and not first[p + 2] else ""
            length = 1 if one in "stmd" else 2 if one + two in ("re", "ve", "ll") else 0
            if length:
                start[p + 1] = False
                if p + 1 + length < n and not first[p + 1 + length]:
                    start[p + 1 + length] |= kinds[p + 1 + length] == _L
    return np.flatnonzero(start)


class _Table:
    """Pre-tokens' counts by 64-bit hash: the first to come keeps a slot, others share a second choice with the latest."""

    def __init__(self):
        self.keys, self.numbers = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.uint32)

    def look_up(self, hashes: np.ndarray, count) -> np.ndarray:
        """A number for each hash; count(rows) gives those of rows whose hashes are not here."""
        hashes = hashes | np.uint64(1)  # 0 marks an empty slot
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = self.numbers[slot]
        missing = np.flatnonzero(self.keys[slot] != hashes)
        second = ((hashes[missing] >> np.uint64(1)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
        out[missing] = self.numbers[second]
        missing = missing[self.keys[second] != hashes[missing]]
        if len(missing):
            new, where, of = np.unique(hashes[missing], return_index=True, return_inverse=True)
            numbers = np.array(count(missing[where]), np.uint32)
            out[missing] = numbers[of]
            slot = (new >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            free = self.keys[slot] == 0
            second = ((new >> np.uint64(1)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
            for slots, rows in ((slot, free), (second, ~free)):
                chosen, i = np.unique(slots[rows], return_index=True)
                i = np.flatnonzero(rows)[i]
                self.keys[chosen], self.numbers[chosen] = new[i], numbers[i]
        return out


class _Memo(dict):
    """Pre-token -> value of its ids. Holds the proven whole tokens; the library merges the rest.

    Merged pre-tokens stay for one to two generations: when the young one is full it becomes the
    old one, and what is asked for again moves back.
    """

    def __init__(self, library, whole: dict[str, int], value):
        super().__init__((piece, value([i])) for piece, i in whole.items())
        self.merge, self.value, self.whole = library.model.tokenize, value, dict(self)
        self.old: dict = {}

    def __missing__(self, piece: str):
        found = self.old.get(piece)
        if found is None:
            found = self.value([t.id for t in self.merge(piece.encode().decode("latin-1").translate(_STAND_IN))])
        if len(piece) <= MEMO_CHARS:
            if len(self) >= len(self.whole) + MEMO:
                self.old = self.copy()
                self.clear()
                self.update(self.whole)
            self[piece] = found
        return found


def _is_byte_bpe(spec: dict) -> bool:
    cut, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    return (
        cut.get("type") == "ByteLevel"
        and cut.get("use_regex", True)
        and not cut.get("add_prefix_space")
        and model.get("type") == "BPE"
        and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    )


def whole_tokens(library) -> dict[str, int]:
    """The vocabulary strings that the library encodes alone as exactly their own token."""
    proven = {}
    for i in range(library.get_vocab_size(with_added_tokens=False)):
        piece = library.decode([i], skip_special_tokens=False)
        if piece and "\ufffd" not in piece and _PLAIN.fullmatch(piece) and _CUT.findall(piece) == [piece] and library.encode(piece, add_special_tokens=False).ids == [i]:
            proven[piece] = i
    return proven


class Tokenizer:
    """One tokenizer file (.json or .model) with the shortcut where the file's kind allows it."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.piece = None
        if path.endswith(".model"):
            import sentencepiece

            self.piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self.simple, self.special = False, []
            return
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or ()]
        self.simple = _is_byte_bpe(spec)
        del spec

    @functools.cached_property
    def _whole(self) -> dict[str, int]:
        return whole_tokens(self.library)

    @functools.cached_property
    def counts(self) -> _Memo:
        return _Memo(self.library, self._whole, len)

    @functools.cached_property
    def packed(self) -> _Memo:
        return _Memo(self.library, self._whole, lambda ids: struct.pack(f"<{len(ids)}I", *ids))

    @functools.cached_property
    def _odd(self) -> dict[str, np.ndarray]:
        """Ids of parts that the library encoded, for parts that come again; emptied when it is full."""
        return {}

    def _part(self, part: str) -> np.ndarray:
        ids = self._odd.get(part)
        if ids is None:
            ids = np.array(self._library_ids(part), "<u4")
            if len(part) <= MEMO_CHARS:
                if len(self._odd) >= MEMO:
                    self._odd.clear()
                self._odd[part] = ids
        return ids

    def _parts(self, text: str) -> list[tuple[str, bool]] | None:
        """The text, parted where it must be, and which parts are plain; None if the library has to see it whole."""
        if not self.simple or any(s in text for s in self.special):
            return None
        if _PLAIN.fullmatch(text):
            return [(text, True)]
        return [(p, _PLAIN.fullmatch(p) is not None) for p in _SAFE.split(text)]

    def count(self, text: str) -> int:
        parts = self._parts(text)
        if parts is None:
            return len(self._library_ids(text))
        return sum(sum(map(self.counts.__getitem__, _CUT.findall(p))) if plain else len(self._part(p)) for p, plain in parts)

    @functools.cached_property
    def _table(self) -> _Table:
        return _Table()

    def count_column(self, column: pa.Array) -> np.ndarray:
        """``count`` of every text of a column.

        Plain texts are cut together in arrays, and their pre-tokens are known by 64-bit hash, so that Python handles only
        those that are not in the table.
        """
        column = string_column(column)
        data, offsets = raw(column)
        out = np.zeros(len(column), np.int64)
        low = 0
        while low < len(column):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CUT_BYTES, "right")) - 1)
            out[low:high] = self._counted(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            low = high
        return out

    def _counted(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text = data.tobytes().decode()
        if not self.simple or len(data) > CUT_BYTES:
            return np.array([self.count(data[a:b].tobytes().decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)
        points, at = data, offsets
        if len(text) < len(data):
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            points = np.minimum(points, _TOP)
            at = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
        kinds = _CLASS[points]
        odd = np.zeros(len(at) - 1, bool)
        odd[np.searchsorted(at, np.flatnonzero(kinds == _ODD), "right") - 1] = True
        if any(s in text for s in self.special):
            odd |= [any(s in text[a:b] for s in self.special) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        out = np.zeros(len(odd), np.int64)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.count(text[at[i] : at[i + 1]])
        size = np.diff(at)
        if odd.any():
            keep = np.repeat(~odd, size)
            points, kinds = points[keep], kinds[keep]
            text = "".join(text[at[i] : at[i + 1]] for i in np.flatnonzero(~odd).tolist())
        rows = np.flatnonzero(~odd & (size > 0))
        if not len(rows):
            return out
        begins = np.cumsum(size[rows]) - size[rows]
        starts = cut(points, kinds, begins)
        ends = np.r_[starts[1:], len(points)]
        merge = self.library.model.tokenize
        stand_in = text
        for c in " \n\t\r":
            stand_in = stand_in.replace(c, chr(_STAND_IN[ord(c)]))

        def count(rows: np.ndarray) -> list[int]:
            found = []
            for a, b in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True):
                piece = text[a:b]
                found.append(len(merge(stand_in[a:b] if piece.isascii() else piece.encode().decode("latin-1").translate(_STAND_IN))))
            return found

        numbers = self._table.look_up(hash_spans(points, starts, ends, _VALUES), count)
        total = np.r_[0, np.cumsum(numbers, dtype=np.int64)][np.searchsorted(starts, np.r_[begins, len(points)])]
        out[rows] = np.diff(total)
        return out

    def ids(self, text: str) -> np.ndarray:
        parts = self._parts(text)
        if parts is None:
            return np.array(self._library_ids(text), "<u4")
        packed = self.packed.__getitem__
        return np.frombuffer(b"".join(b"".join(map(packed, _CUT.findall(p))) if plain else self._part(p).tobytes() for p, plain in parts), "<u4")

    def _library_ids(self, text: str) -> list[int]:
        if self.piece is not None:
            return self.piece.encode(text)
        return self.library.encode(text, add_special_tokens=False).ids


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """Loaded once per worker and file."""
    return Tokenizer(path)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", out: str = "n_tokens", keep_text: bool = True) -> DataFrame:
    """``docs`` with a column ``out``: the number of tokens of each whole text.

    The count is the library's for the file at ``path``: no begin, end or added special tokens,
    special strings inside a text as the library handles them by default, no truncation.

    Defined results: a null or empty text counts 0; repeated rows are counted each; every other
    column passes through unchanged (one already named ``out`` is replaced; the text itself goes
    with ``keep_text=False``); an empty table gives an empty table; a text of any length is counted
    whole. One narrow pass, no shuffle.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.drop(out) if out in docs.columns else docs
    back = [f for f in kept.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType([*back, T.StructField(out, T.LongType())])
    names = [f.name for f in back]

    def run(batches):
        counter = tokenizer(path)
        for batch in batches:
            column = string_column(batch.column(batch.schema.names.index(text_col)))
            counts = pa.array([counter.count(t.as_py()) for t in column], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(n)) for n in names), counts], names=[*names, out])

    return kept.mapInArrow(run, schema)
