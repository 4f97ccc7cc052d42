"""Removal of words of repeated passages, found by fixed blocks of words as anchors.

A word goes if a window of ``WINDOW`` consecutive words covers it whose word sequence also starts earlier (smaller doc_id,
or the same document and an earlier start).

1. *Index.* Every document is cut into non-overlapping blocks of ``BLOCK`` words. A window of 20 words holds a whole
   block of 10 wherever it starts, among its places 0 to 9.
2. *Probe.* The rolling window of 10 words at every word is hashed; hashes meet the index in hash shares. A place is a
   hit if its hash is an indexed block's and stands at more than one place. A repeated passage has hits at the same
   offsets in each of its copies: at those of its own blocks and of the other copies'.
3. *Extend.* A hit is extended to all windows of 20 words around it. Their keys (two hashes of the 20 words, 112 bits)
   meet in shares, where each key's earliest place is known and all others are told to their documents. A
   document's repeated windows run together to the maximal repeats, whose words go.

Texts stay where they are. What travels is sorted keys, a packed row for each unit of texts (``UNIT_BYTES``) and share, so
there are never more rows than keys; a key travels once for each unit, however often the unit holds it, so no
line, passage or group of copies is hot, and no pairs are made. Shares are sized by the number of units.

Edges: null text has no words; a null doc_id, or one that is no number, comes before all others; rows that share a doc_id
count as documents in the order of a hash of their texts; texts of fewer than 20 words keep all; a text of any length is
hashed in slices; an empty table gives an empty result; columns are carried only if asked for, in one struct ``carried``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_blocks, numbered, parts, power_of_two

WINDOW, BLOCK = 20, 10
UNIT_BYTES, UNIT_BITS = 16 << 20, 20  # a unit: consecutive rows of about so many bytes, 2 ** UNIT_BITS at most
SLICE = 1 << 19  # bytes, and words, hashed at a time
#: Longer words are hashed by BLAKE2: modulo 2 ** 64, polynomials of some long words are equal whatever their base.
LONG_WORD = 128
PROBE_BITS = 48  # of a probe's hash: a false hit costs a few windows' keys, and no word
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
_SPACES = [bytes([b]) for b in _BLANKS]
_ANY = re.compile(rb"[\x20\x09-\x0D]")
_TO_BLANK = bytes(32 if _SPACE[b] else b for b in range(256))
_random = np.random.default_rng(20260219)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACES = _random.integers(1, 1 << 63, (3, WINDOW), dtype=np.uint64) | np.uint64(1)  # of a word in a block, and in a window for each key
_BASE = 0xBF9A5E1D4C8F7A63
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = power_of_two(n)
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (_BASE, _INVERSE)]
    return _powers


def word_places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word of bytes that end with a space."""
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(raw) and not space[0]:
        edge = np.concatenate(([0], edge))
    return edge[::2], edge[1::2]


def _hashed(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    power, inverse = _power_tables(len(raw))
    sums = np.cumsum(_BYTE[raw] * power[: len(raw)])
    before = np.where(first > 0, sums[first - 1], np.uint64(0))
    word = _mixed((sums[last - 1] - before) * inverse[first])
    for k in np.flatnonzero(last - first > LONG_WORD).tolist():
        word[k] = int.from_bytes(hashlib.blake2b(raw[first[k] : last[k]].tobytes(), digest_size=8).digest(), "little")
    return word


def _split(text: bytes) -> Iterator[bytes]:
    """A text in pieces of at most 2 * SLICE bytes, cut at spaces; a longer piece is one long word."""
    at = 0
    while len(text) - at > 2 * SLICE:
        end = at + SLICE
        space = _ANY.search(text, end)
        after = space.start() if space else len(text)
        if after - end > SLICE:
            begin = max(at, 1 + max(text.rfind(s, at, end) for s in _SPACES))
            if begin > at:
                yield text[at:begin]
            yield text[begin:after]
        else:
            yield text[at:after]
        at = after
    yield text[at:]


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and begins of the words of a piece that ends with a space."""
    if len(raw) > 2 * SLICE + 1:  # one long word
        return np.array([int.from_bytes(hashlib.blake2b(raw[:-1].strip(_BLANKS), digest_size=8).digest(), "little")], np.uint64), np.zeros(1, np.int64)
    buf = np.frombuffer(raw, np.uint8)
    first, last = word_places(buf)
    return _hashed(buf, first, last), first


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts, one after the other, and where each text's words begin (and the end)."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    i = 0
    while i < len(texts):
        if len(texts[i]) > SLICE:
            own = [_word_hashes(piece + b"\n")[0] for piece in _split(texts[i])]
            hashes += own
            counts.append(np.array([sum(map(len, own))]))
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and len(texts[j]) <= SLICE and size < SLICE:
            size += len(texts[j]) + 1
            j += 1
        words, first = _word_hashes(b"\n".join(texts[i:j]) + b"\n")
        hashes.append(words)
        ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
        counts.append(np.diff(np.searchsorted(first, ends), prepend=0))
        i = j
    return np.concatenate(hashes), np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int64)


def rolled(words: np.ndarray, width: int, places: np.ndarray) -> np.ndarray:
    """Hash of every ``width`` consecutive words."""
    n = len(words) - width + 1
    if n <= 0:
        return words[:0]
    h = words[:n] * places[0]
    for k in range(1, width):
        h += words[k : n + k] * places[k]
    return _mixed(h)


def _slices(words: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Place of the first word, words (``width`` - 1 more than starts), the text of each start and the start's number in
    it, for starts of windows that end in their text."""
    for a in range(0, len(words), SLICE):
        piece = words[a : a + SLICE + width - 1]
        n = len(piece) - width + 1
        if n <= 0:
            return
        at = np.arange(a, a + n)
        text = np.searchsorted(bounds, at, "right") - 1
        inside = at + width <= bounds[text + 1]
        yield a, piece, np.where(inside, text, -1), at - bounds[text]


def packed(*columns: np.ndarray) -> bytes:
    """Arrays of one length as compressed bytes: byte planes of 64-bit numbers; the first, ascending, as differences."""
    first = columns[0].astype(np.uint64)
    planes = [np.diff(first, prepend=np.uint64(0)), *(c.astype(np.uint64) for c in columns[1:])]
    raw = np.ascontiguousarray(np.stack(planes).view(np.uint8).reshape(len(planes), len(first), 8).transpose(0, 2, 1))
    return len(first).to_bytes(8, "little") + len(planes).to_bytes(1, "little") + pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def unpacked(x: bytes) -> list[np.ndarray]:
    n, k = int.from_bytes(x[:8], "little"), x[8]
    raw = np.frombuffer(pa.decompress(x[9:], decompressed_size=8 * n * k, codec="zstd", asbytes=True), np.uint8)
    columns = np.ascontiguousarray(raw.reshape(k, 8, n).transpose(0, 2, 1)).view(np.uint64).reshape(k, n)
    return [np.cumsum(columns[0]), *columns[1:]]


def _dealt(keys: np.ndarray, bits: int, shares: int) -> np.ndarray:
    """Where each share's keys begin among ascending keys of so many bits, and the end."""
    begins = np.arange(1, shares, dtype=np.uint64) << np.uint64(bits - (shares.bit_length() - 1))
    return np.concatenate(([0], np.searchsorted(keys, begins), [len(keys)]))


def probes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, ascending, of all 10 words in a row of the texts, and of each: 1 if it is an indexed block's, plus
    2 if it stands at several places."""
    words, bounds = words_of(texts)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for _, piece, text, start in _slices(words, bounds, BLOCK):
        keep = text >= 0
        h = rolled(piece, BLOCK, _PLACES[0])[keep] >> np.uint64(64 - PROBE_BITS)
        found.append(_distinct(h, (start[keep] % BLOCK == 0).astype(np.uint8)))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    return found[0] if len(found) == 1 else _distinct(*(np.concatenate(x) for x in zip(*found)))


def _distinct(h: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h, flags = h[order], flags[order]
    if not len(h):
        return h, flags
    begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    several = np.diff(begin, append=len(h)) > 1
    return h[begin], np.bitwise_or.reduceat(flags, begin) | several.astype(np.uint8) * np.uint8(2)


def _among(x: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(x), bool)
    return ascending[np.minimum(np.searchsorted(ascending, x), len(ascending) - 1)] == x


def windows(texts: list[bytes], hits: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Of the windows around hits: both keys, the text and the start, in the order of texts and starts, slice by slice."""
    words, bounds = words_of(texts)
    for _, piece, text, start in _slices(words, bounds, WINDOW):
        hit = _among(rolled(piece, BLOCK, _PLACES[0]) >> np.uint64(64 - PROBE_BITS), hits)
        seen = np.concatenate(([0], np.cumsum(hit)))
        at = np.flatnonzero((text >= 0) & (seen[BLOCK : BLOCK + len(text)] > seen[: len(text)]))
        if len(at):
            keys = [rolled(piece, WINDOW, _PLACES[k])[at] for k in (1, 2)]
            yield keys[0], keys[1] >> np.uint64(16), text[at], start[at]


def earliest(key: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first of each (key, other) in ascending order of key, and whether each position is no first.
    Positions ascend as places do."""
    order = np.argsort(key, kind="stable")
    k, o = key[order], other[order]
    same = k[1:] == k[:-1]
    if np.any(same & (o[1:] != o[:-1])):
        order = np.lexsort((other, key))  # stable, too
        k, o = key[order], other[order]
        same = k[1:] == k[:-1]
    first = np.concatenate(([True], ~(same & (o[1:] == o[:-1])))) if len(k) else np.zeros(0, bool)
    late = np.ones(len(key), bool)
    late[order[first]] = False
    return order[first], late


def _runs(row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(row, first word, end) of runs of windows, of ascending rows and starts."""
    if not len(row):
        return np.zeros((0, 3), np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + WINDOW))))
    last = np.concatenate((cut[1:] - 1, [len(row) - 1]))
    return np.stack((row[cut], start[cut], start[last] + WINDOW), axis=1).astype(np.int64)


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["id", "tie", "row"], kind="stable")


def stage_units(docs: DataFrame, carry: tuple[str, ...] = (), unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """A table in the shared folder: block (the unit), row, id (doc_id as long), tie (hash of the text), doc_id, body (UTF-8
    bytes), carried (the carried columns); bucketed by unit, written without a shuffle."""
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    carried = [F.struct(*carry).alias("carried")] if carry else []
    staged = docs.select(F.coalesce(F.col("doc_id").try_cast("long"), F.lit(-(1 << 63)).cast("long")).alias("id"), F.xxhash64(body).alias("tie"), "doc_id", body.alias("body"), *carried)
    return in_blocks(numbered(staged, "body", unit_bytes, UNIT_BITS), "units", UNIT_BITS)


def repeated_windows(units: DataFrame) -> DataFrame:
    """block, ranges: packed (row, first word, end) ranges of words that repeated windows cover."""
    n_units = units.select("block").distinct().count()
    shares = power_of_two(max(2 * parts(units.sparkSession), n_units // 2))

    def offer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h, flags = probes(pdf["body"].tolist())
        cuts = _dealt(h, PROBE_BITS, shares).tolist()
        return pd.DataFrame([(s, int(key[0]), packed(h[a:b], flags[a:b])) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a], columns=["share", "block", "keys"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        h, flags = (np.concatenate(x) for x in zip(*map(unpacked, pdf["keys"])))
        every, flags = _distinct(h, flags.astype(np.uint8))
        hits = every[flags == 3]
        told = [(block, own[_among(own, hits)]) for block, own in ((b, unpacked(x)[0]) for b, x in zip(pdf["block"].tolist(), pdf["keys"]))]
        return pd.DataFrame([(b, packed(x)) for b, x in told if len(x)], columns=["block", "hits"])

    def extend(key: tuple, docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        columns = ["share", "block", "keys", "docs", "ranges"]
        if not len(docs) or not len(told):
            return pd.DataFrame([], columns=columns)
        docs = _ordered(docs)
        places = docs[["id", "tie", "row"]].to_numpy(np.int64)
        some, known = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))], []

        def sieved(k1: np.ndarray, k2: np.ndarray, text: np.ndarray, start: np.ndarray) -> np.ndarray:
            first, late = earliest(k1, k2)
            known.append(_runs(places[text[late], 2], start[late]))
            return first

        for found in windows(docs["body"].tolist(), np.sort(np.concatenate([unpacked(x)[0] for x in told["hits"]]))):
            at = np.sort(sieved(*found))
            some.append(tuple(x[at] for x in found))
        k1, k2, text, start = (np.concatenate(x) for x in zip(*some))
        at = sieved(k1, k2, text, start)
        k1, k2, text, start = k1[at], k2[at], text[at], start[at]
        known = np.concatenate(known)
        cuts = _dealt(k1, 64, shares).tolist()
        out = []
        for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                own, which = np.unique(text[a:b], return_inverse=True)
                out.append((s, int(key[0]), packed(k1[a:b], k2[a:b], which, start[a:b]), places[own].tobytes(), known.tobytes() if not out else b""))
        return pd.DataFrame(out, columns=columns)

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = pdf["block"].to_numpy(np.int64)
        keys, places, base = [], [], 0
        for x, docs in zip(pdf["keys"], pdf["docs"]):
            k1, k2, which, start = unpacked(x)
            keys.append((k1, k2, which.astype(np.int64) + base, start.astype(np.int64)))
            places.append(np.frombuffer(docs, np.int64).reshape(-1, 3))
            base += len(places[-1])
        unit = np.repeat(np.arange(len(pdf)), [len(p) for p in places])
        places = np.concatenate(places)
        rank = np.empty(len(places), np.int64)
        rank[np.lexsort((places[:, 2], places[:, 1], places[:, 0]))] = np.arange(len(places))
        k1, k2, doc, start = (np.concatenate(x) for x in zip(*keys))
        del keys
        order = np.lexsort((start, rank[doc]))
        k1, k2, doc, start = k1[order], k2[order], doc[order], start[order]
        late = earliest(k1, k2)[1]
        doc, start = doc[late], start[late]
        out = [(b, r) for b, r in zip(blocks.tolist(), pdf["ranges"]) if len(r)]
        order = np.lexsort((start, places[doc, 2], unit[doc]))
        doc, start = doc[order], start[order]
        cuts = np.searchsorted(unit[doc], np.arange(len(pdf) + 1)).tolist()
        out += [(int(blocks[u]), _runs(places[doc[a:b], 2], start[a:b]).tobytes()) for u, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        return pd.DataFrame([(b, pa.compress(r, codec="zstd", asbytes=True), len(r)) for b, r in out], columns=["block", "ranges", "size"])

    texts = units.select("block", "row", "id", "tie", "body")
    hits = units.select("block", "body").groupBy("block").applyInPandas(offer, "share int, block long, keys binary").groupBy("share").applyInPandas(meet, "block long, hits binary")
    asked = texts.groupBy("block").cogroup(hits.groupBy("block")).applyInPandas(extend, "share int, block long, keys binary, docs binary, ranges binary")
    return asked.groupBy("share").applyInPandas(decide, "block long, ranges binary, size long")


def _kept(body: bytes, ranges: np.ndarray) -> tuple[int, int, bytes]:
    """Words, words that go, and the words that stay joined by one space."""
    n = gone = 0
    kept = []
    for piece in _split(body):
        raw = np.frombuffer(piece.translate(_TO_BLANK) + b" ", np.uint8)
        first, last = word_places(raw)
        lo, hi = np.clip(ranges[:, 1] - n, 0, len(first)), np.clip(ranges[:, 2] - n, 0, len(first))
        depth = np.zeros(len(first) + 1, np.int32)
        np.add.at(depth, lo, 1)
        np.subtract.at(depth, hi, 1)
        stays = np.cumsum(depth[:-1]) == 0
        edge = np.zeros(len(raw) + 1, np.int8)
        edge[first[stays]] = 1
        edge[last[stays] + 1] -= 1  # with the space behind; the next word may begin there
        left = raw[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes()[:-1]
        kept += [left] * bool(left)
        n += len(first)
        gone += int(np.count_nonzero(~stays))
    return n, gone, b" ".join(kept)


def remove_passages(docs: DataFrame, carry: tuple[str, ...] = (), with_text: bool = False, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row; on demand ``carried`` and ``kept_text`` (the kept words joined
    by one space)."""
    units = stage_units(docs, carry, unit_bytes)
    ranges = repeated_windows(units)
    kinds = dict(units.dtypes)
    more = ["carried"] * bool(carry) + ["kept_text"] * with_text

    def finish(key: tuple, docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        every = [np.frombuffer(pa.decompress(r, decompressed_size=n, codec="zstd", asbytes=True), np.int64).reshape(-1, 3) for r, n in zip(told["ranges"], told["size"])]
        every = np.concatenate(every) if every else np.zeros((0, 3), np.int64)
        every = every[np.argsort(every[:, 0], kind="stable")]
        out = []
        for row, body in zip(docs["row"].tolist(), docs["body"].tolist()):
            a, b = np.searchsorted(every[:, 0], [row, row + 1])
            out.append(_kept(body, every[a:b]))
        n, gone, kept = zip(*out) if out else ((), (), ())
        got = pd.DataFrame({"doc_id": docs["doc_id"].to_numpy(), "n_words": np.array(n, np.int64), "n_removed": np.array(gone, np.int64), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]})
        if carry:
            got["carried"] = docs["carried"].tolist()
        if with_text:
            got["kept_text"] = [x.decode("utf-8", "replace") for x in kept]
        return got

    schema = ", ".join([f"doc_id {kinds['doc_id']}, n_words long, n_removed long, kept_sha256 string", *(f"{c} {kinds.get(c, 'string')}" for c in more)])
    whole = units.select("block", "row", "doc_id", "body", *["carried"] * bool(carry))
    return whole.groupBy("block").cogroup(ranges.groupBy("block")).applyInPandas(finish, schema)
