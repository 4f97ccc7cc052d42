"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as a doubly linked list of byte symbols; a heap holds the adjacent pairs that the
merge table knows, lowest rank first. Popping a live pair joins two symbols and offers the two new
neighbours. The count is the initial symbols minus the merges: no identifier is ever emitted.

Edges: null text counts as empty (0 bytes, 0 tokens); any length of text or pre-token works (a
pre-token of n symbols takes n log n steps); repeated rows give repeated results; other columns are
not read, so their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import text_or_empty

#: Pre-tokens kept with their counts in a Python worker; when full it starts anew.
CACHE_ENTRIES = 600_000
#: White space never reaches the merges, so a pre-token is one of these runs.
_RUNS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\p{White_Space}\\p{L}\\p{N}]+"
#: Letters and numbers of Unicode versions that the library does not know (first, last). It
#: splits them off as signs.
_LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF4), (0x16FF5, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_LATER_SET = "".join(f"{chr(a)}-{chr(b)}" for a, b in _LATER)
_SIGNS = f"[^\\p{{White_Space}}\\p{{L}}\\p{{N}}]|[{_LATER_SET}]"
_RUNS_WITH_LATER = f"'s|'t|'re|'ve|'m|'ll|'d|(?:(?![{_LATER_SET}])\\p{{L}})+|(?![{_LATER_SET}])\\p{{N}}|(?:{_SIGNS})+"
_POS = 28


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 keeps its
    place, the others follow from code point 256 on in their order."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class PairMerger(dict):
    """Maps a normalised pre-token to its number of tokens, counting on first use."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault(vocab[a] << 17 | vocab[b], rank << 17 | vocab[a + b])
        names = byte_symbols()
        self.inner = [vocab[c] for c in names]
        self.last = [vocab[c + end] for c in names]
        added = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.find, self.find_with_later = regex.compile(_RUNS).findall, regex.compile(_RUNS_WITH_LATER).findall

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if not token.isascii() and _RARE.search(token):
            raise _Rare  # never kept, so that each text with one comes here
        n = self.merge(token.encode("utf-8", "replace"))
        if len(token) <= 64:
            self[token] = n
        return n

    def merge(self, raw: bytes) -> int:
        n = len(raw)
        if n == 1:
            return 1
        inner, get = self.inner, self.pairs.get
        ids = [inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        heap = [v << _POS | i for i in range(n - 1) if (v := get(ids[i] << 17 | ids[i + 1])) is not None]
        if not heap:
            return n
        heapify(heap)
        after, before, merged = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        low = (1 << _POS) - 1
        while heap:
            item = heappop(heap)
            i = item & low
            if ids[i] < 0 or (j := after[i]) >= n or get(ids[i] << 17 | ids[j]) != item >> _POS:
                continue  # one of its symbols has been merged away since
            merged += 1
            ids[i], ids[j] = (item >> _POS) & 0x1FFFF, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (v := get(ids[i] << 17 | ids[k])) is not None:
                    heappush(heap, v << _POS | i)
            if (p := before[i]) >= 0 and (v := get(ids[p] << 17 | ids[i])) is not None:
                heappush(heap, v << _POS | p)
        return n - merged

    def count(self, text: str) -> int:
        extra, segments = 0, (text,)
        if self.special is not None and (found := self.special.findall(text)):
            extra, segments = len(found), self.special.split(text)
        try:
            return extra + sum(sum(map(self.__getitem__, self.find(_lower(_composed(s))))) for s in segments if s)
        except _Rare:
            return extra + sum(map(self.count_rare, (t for s in segments for t in self.find_with_later(_lower(_composed(s).translate(_NEWER))))))

    def count_rare(self, token: str) -> int:
        n = self.get(token)
        return self.merge(token.encode("utf-8", "replace")) if n is None else n


class _Rare(Exception):
    """A text has characters that the library's tables have and Python's or regex's have not, or the other way round."""


#: Small forms that the library knows and Python's character tables of this version do not.
_NEWER = {0xA7CB: 0x264, 0xA7DC: 0x19B, **{c: c + 1 for c in (0x1C89, 0xA7CC, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA)}, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}}
_RARE = re.compile("[" + _LATER_SET + "".join(map(chr, sorted(_NEWER))) + "]")
_library_nfc = None


def _composed(text: str) -> str:
    """NFC as the library's: its tables order marks of later Unicode versions otherwise, so a text that is not
    composed already goes through it."""
    global _library_nfc
    if text.isascii() or unicodedata.is_normalized("NFC", text):
        return text
    if _library_nfc is None:
        from tokenizers.normalizers import NFC

        _library_nfc = NFC()
    return _library_nfc.normalize_str(text)


def _lower(text: str) -> str:
    # code point by code point: a word-final capital sigma becomes the ordinary small one
    return "".join(map(str.lower, text)) if "\u03a3" in text else text.lower()


_mergers: dict[str, PairMerger] = {}


def merger(path: str) -> PairMerger:
    if path not in _mergers:
        _mergers[path] = PairMerger(path)
    return _mergers[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text). One narrow pass:
    no shuffle, memory of one Arrow batch and the bounded cache."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merger(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    plain = docs.select("doc_id", text_or_empty().alias("text"))
    return plain.mapInArrow(run, f"doc_id {dict(plain.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
