"""Exact removal of repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if a string of ``match`` bytes covers it that also starts earlier (smaller doc_id, or the
same document and an earlier start). Not every suffix has to be sorted for that:

1. *Anchors.* In each window of ``match`` bytes the rolling hash of its ``gram``-byte substrings is
   smallest at one place, the anchor (the last such place on ties). Equal windows have equal anchors at
   equal offsets, so one anchor stands for a run of consecutive windows.
2. *Sieve.* Anchors' hashes are counted by hash; those that occur once in the corpus cannot be part of a
   repeated window and drop out. Only hashes travel here, a row per hash and block.
3. *Sorted runs.* Each block of documents sorts the suffixes at its surviving anchors (as far as the
   windows reach), removes contexts that the block repeats, and front-codes each run: the length of the
   prefix shared with the suffix before, and the rest. Runs are cut where ranges of suffixes begin, which a
   sample of the surviving anchors tells (a bounded number for each range), so the order is total over
   the corpus: range by range, and merged within each.
4. *Merge.* The runs of one range meet in a loser tree that carries the common-prefix
   lengths: a comparison starts behind the prefix already known to be shared, and mostly needs no
   character at all. The merged order's common-prefix lengths bound the intervals of suffixes that agree
   on a window's right part; what stands left of the anchor decides within an interval. Where there
   are more than ``fan`` blocks, runs of at most that many blocks and of wide ranges are merged first, repeated
   contexts fall away, and what is left is cut into narrower ranges: rows that travel grow with the
   suffixes, not with blocks times ranges, and no task meets more than about ``fan`` runs.
5. Repeated windows return to their documents as byte ranges.

Anchors found more than ``hot`` times (a passage in a large share of all documents) are taken window
by window, each dealt out by its own hash and not by range, as windows of one passage all begin alike, so that no
group of suffixes outgrows a task: a block keeps each window once, and so does every pass. Texts never travel: they are staged once in a table bucketed by block (1024
rows or 8 MB at most), and both later passes read it in place.

Edges: null text is empty; a null doc_id comes before all others, and so does one that is no number; rows that
share a doc_id count as documents in the order of a hash of their texts; texts shorter than ``match`` keep all; texts
of any length are read in slices, and of a run of one character or of any short period only the distinct windows of a
slice become entries; an empty table gives an empty result; other columns are carried only if asked for.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK_BITS, in_blocks, numbered, parts, power_of_two, settle

MATCH, GRAM = 100, 32
HOT = 20_000
PER_SHARE = 1 << 19  # surviving anchors of a share, about
FAN = 4096  # runs that are merged at a time
SAMPLED, PER_RANGE = 64, 64  # one anchor of a block in SAMPLED may be in the sample, which has about PER_RANGE for each range
CHUNK = 1 << 19  # bytes hashed at a time
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_LOW32 = np.uint64(0xFFFFFFFF)


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of every ``gram``-byte substring, by doubling; gram is a power of two."""
    h, width, mul = _TABLE[buf], 1, _STEP
    while width < gram:
        h = h[:-width] * np.uint64(mul) + h[width:]
        width, mul = width * 2, mul * mul % (1 << 64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    m = x
    while done * 2 <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    return np.minimum(m[: len(m) - (width - done)], m[width - done :]) if width > done else m


def anchors(buf: np.ndarray, bounds: np.ndarray, match: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the documents buf[bounds[i]:bounds[i + 1]]: anchors, their hashes, and the first and last start
    of the windows that each stands for, as positions in buf."""
    none = np.zeros(0, np.int64)
    if len(buf) < match:
        return none, none.astype(np.uint64), none, none
    h = gram_hashes(buf, gram)
    key = (h & ~_LOW32) | (_LOW32 - np.arange(len(h), dtype=np.uint64))
    place = (_LOW32 - (window_minimum(key, match - gram + 1) & _LOW32)).astype(np.int64)
    whole = np.zeros(len(buf) + 1, np.int8)
    first, last = bounds[:-1], bounds[1:] - match  # starts of windows that lie within their document
    keep = last >= first
    whole[first[keep]] += 1
    whole[last[keep] + 1] -= 1
    starts = np.flatnonzero(np.cumsum(whole[: len(place)], dtype=np.int8))
    if not len(starts):
        return none, none.astype(np.uint64), none, none
    at = place[starts]
    cut = np.flatnonzero(at[1:] != at[:-1])
    lo, hi = starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))]
    at = at[np.concatenate(([0], cut + 1))]
    return at, h[at], lo, hi


def _chunks(texts: list[bytes], match: int) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of documents of about CHUNK bytes, or slices of a longer one that share ``match`` - 1 bytes, so each window is
    in one: index of the first, where the slice begins in it (else 0), their bytes, their bounds."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > 2 * CHUNK:
            for a in range(0, len(texts[i]), CHUNK):
                raw = texts[i][a : a + CHUNK + match - 1]
                yield i, a, raw, np.array([0, len(raw)], np.int64)
            i += 1
            continue
        j, size, ends = i, 0, [0]
        while j < len(texts) and size < CHUNK and len(texts[j]) <= 2 * CHUNK:
            size += len(texts[j])
            ends.append(size)
            j += 1
        yield i, 0, b"".join(texts[i:j]), np.array(ends, np.int64)
        i = j


def repeated_here(buf: np.ndarray, starts: np.ndarray, match: int, gram: int) -> np.ndarray:
    """Of windows of buf in the order in which they count: whether each equals an earlier one. Windows meet by the hashes
    of the substrings that cover them, and are then compared."""
    grams = gram_hashes(buf, gram)
    key = np.zeros(len(starts), np.uint64)
    for at in sorted({*range(0, match - gram + 1, gram), match - gram}):
        key = key * np.uint64(_STEP) + grams[starts + at]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    begin = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(order) else np.zeros(0, bool)
    model = starts[order][np.maximum.accumulate(np.where(begin, np.arange(len(order)), 0))]
    late = np.zeros(len(starts), bool)
    view = np.lib.stride_tricks.sliding_window_view(buf, match)
    later = np.flatnonzero(~begin)
    for a in range(0, len(later), 1 << 14):
        some = later[a : a + (1 << 14)]
        late[order[some]] = (view[starts[order[some]]] == view[model[some]]).all(axis=1)  # a window under another's hash stays
    return late


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the intervals, one after the other."""
    n = last - first + 1
    return np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, of which ``known`` bytes are known already."""
    m = min(len(a), len(b))
    differ = int.from_bytes(a[known:m], "big") ^ int.from_bytes(b[known:m], "big")
    return m - ((differ.bit_length() + 7) >> 3)


def front_code(strings: list[bytes]) -> tuple[np.ndarray, bytes]:
    lcps, tails, before = np.zeros(len(strings), np.uint16), [], b""
    for i, s in enumerate(strings):
        n = common_prefix(before, s)
        lcps[i] = n
        tails.append(s[n:])
        before = s
    return lcps, b"".join(tails)


def front_decode(lcps: list[int], lengths: list[int], tails: bytes) -> list[bytes]:
    out, at, before = [], 0, b""
    for n, size in zip(lcps, lengths):
        before = before[:n] + tails[at : at + size - n]
        at += size - n
        out.append(before)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Merges sorted runs (strings, length of the prefix shared with the string before). Yields run, place
    in it, and the length of the prefix shared with what came before, in sorted order.

    shared[s] is how much stream s's string shares with the last one put out; a loser keeps what it
    shares with the winner that beat it. The longer shared prefix wins unseen; characters are compared
    only behind equal ones."""
    size = power_of_two(len(runs))
    now: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (size - len(runs))
    shared = [-1 if s is None else 0 for s in now]
    place = [0] * size

    def beats(s: int, t: int) -> bool:
        """Whether s goes first; sets what the loser shares with the winner."""
        if shared[s] != shared[t]:
            return shared[s] > shared[t]
        known = shared[s]
        if known < 0:
            return True
        a, b = now[s], now[t]
        if a == b:
            first = s < t
            n = len(a)
        else:
            first = a < b
            n = common_prefix(a, b, known)
        shared[t if first else s] = n
        return first

    won, tree = [0] * (2 * size), [0] * size
    won[size:] = range(size)
    for node in range(size - 1, 0, -1):
        s, t = won[2 * node], won[2 * node + 1]
        won[node], tree[node] = (s, t) if beats(s, t) else (t, s)
    w = won[1] if size > 1 else 0
    while now[w] is not None:
        yield w, place[w], shared[w]
        strings, lcps = runs[w]
        place[w] = i = place[w] + 1
        if i < len(strings):
            now[w], shared[w] = strings[i], lcps[i]
        else:
            now[w], shared[w] = None, -1
        node = (size + w) >> 1
        while node:
            t = tree[node]
            if shared[t] > shared[w] or (shared[t] == shared[w] and not beats(w, t)):
                tree[node], w = w, t
            node >>= 1


class Repeats:
    """Takes contexts in sorted order of their right parts and tells which windows are repeated."""

    def __init__(self, match: int, gram: int):
        self.match, self.gram, self.group, self.found = match, gram, [], []

    def add(self, shared: int, right: bytes, left: bytes, where: tuple) -> None:
        """where: (doc_id, hash of the text, row, anchor's byte in it), by which what comes earlier is told."""
        if shared < self.gram and self.group:
            self.flush()
        self.group.append((shared, right, left, where))

    def _tell(self, where: tuple, first: int, last: int) -> None:
        self.found.append((where[2], first, last + self.match))

    def flush(self) -> None:
        group, self.group = self.group, []
        if len(group) < 2:
            return
        earliest: dict[tuple, tuple] = {}
        for _, right, left, where in group:
            seen = earliest.get((right, left))
            if seen is None or where < seen:
                earliest[right, left] = where
        match = self.match
        for _, right, left, where in group:
            if earliest[right, left] is not where:
                self._tell(where, where[3] - len(left), where[3] + len(right) - match)
        if len(earliest) < 2:
            return
        # Suffixes agree on their first d bytes from since[d] on: an interval of the merged order.
        top = match + 1
        since, first, at = [0] * (top + 1), {}, []
        for i, (shared, right, left, where) in enumerate(group):
            if shared < top:
                since[shared + 1 :] = [i] * (top - shared)
            if earliest[right, left] is not where:
                continue
            keys = []
            for back in range(match - len(right), len(left) + 1):  # of the anchor within the window
                key = (back, since[match - back], left[len(left) - back :])
                keys.append(key)
                seen = first.get(key)
                if seen is None or where < seen:
                    first[key] = where
            at.append((where, match - len(right), keys))
        for where, least, keys in at:
            again = [least + k for k, key in enumerate(keys) if first[key] is not where]
            if again:
                run = again[0]
                for a, b in zip(again, [*again[1:], None]):
                    if b != a + 1:  # anchor's places run, ..., a from the window's start: its starts are anchor - place
                        self._tell(where, where[3] - a, where[3] - run)
                        run = b


def _pack_ranges(found: list[tuple] | np.ndarray) -> bytes:
    return np.array(found, np.int64).reshape(-1, 3).tobytes()


def _joined(row: np.ndarray, start: np.ndarray, match: int) -> np.ndarray:
    """(row, start, end) of runs of windows, given in the order of rows and starts."""
    if not len(row):
        return np.zeros((0, 3), np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + match))))
    last = np.concatenate((cut[1:] - 1, [len(row) - 1]))
    return np.stack((row[cut], start[cut], start[last] + match), axis=1).astype(np.int64)


def _unpack(x: bytes, width: int = 3) -> np.ndarray:
    return np.frombuffer(x, np.int64).reshape(-1, width)


def stage_blocks(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """A table in the shared folder: block, row, id (doc_id as long), tie (hash of the text), doc_id, body (UTF-8
    bytes), carried columns; bucketed by block, written without a shuffle."""
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    staged = docs.select(F.coalesce(F.col("doc_id").try_cast("long"), F.lit(-(1 << 63)).cast("long")).alias("id"), F.xxhash64(body).alias("tie"), F.col("doc_id"), body.alias("body"), *carry)
    return in_blocks(numbered(staged, "body"), "blocks")


def _encoded(entries: list[tuple], ranges: list[tuple] | np.ndarray) -> tuple:
    """A run of sorted entries (right, left, id, tie, row, byte), front-coded, and ranges known to be repeated."""
    lcps, tails = front_code([e[0] for e in entries])
    sizes = np.array([(len(e[0]), len(e[1])) for e in entries], np.uint16)
    return lcps.tobytes(), sizes.tobytes(), tails, b"".join(e[1] for e in entries), np.array([e[2:] for e in entries], np.int64).tobytes(), _pack_ranges(ranges)


def _decoded(pdf: pd.DataFrame) -> tuple[list, list, list]:
    """Runs (strings, shared prefixes), their lefts and their places."""
    runs, lefts, wheres = [], [], []
    for lcps, sizes, tails, left, where in zip(pdf["lcps"], pdf["sizes"], pdf["tails"], pdf["lefts"], pdf["wheres"]):
        n = np.frombuffer(lcps, np.uint16).tolist()
        size = np.frombuffer(sizes, np.uint16).reshape(-1, 2)
        ends = np.cumsum(size[:, 1], dtype=np.int64).tolist()
        runs.append((front_decode(n, size[:, 0].tolist(), tails), n))
        lefts.append([left[a:b] for a, b in zip([0, *ends], ends)])
        wheres.append([tuple(x) for x in _unpack(where, 4).tolist()])
    return runs, lefts, wheres


def _cut(entries: list[tuple], begins: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """Range, first and end of each stretch of sorted entries that lies in one range."""
    i = 0
    while i < len(entries):
        which = bisect_right(begins, entries[i][0])
        end = len(entries)
        if which < len(begins):  # the first entry of a later range
            lo, hi = i + 1, end
            while lo < hi:
                mid = (lo + hi) >> 1
                lo, hi = (mid + 1, hi) if entries[mid][0] < begins[which] else (lo, mid)
            end = lo
        yield which, i, end
        i = end


def passes(blocks: int, ranges: int, fan: int) -> list[tuple[int, int]]:
    """(ranges, groups of runs) of each merge, the last with all ranges and one group: no merge of a range meets more
    than about ``fan`` runs."""
    groups = [1]
    while -(-blocks // fan) > 1:
        blocks = -(-blocks // fan)
        groups.append(blocks)
    groups.sort(reverse=True)
    bits = ranges.bit_length() - 1
    return [(1 << (bits * (i + 1) // len(groups)), g) for i, g in enumerate(groups)]


_RUN = "share int, part long, lcps binary, sizes binary, tails binary, lefts binary, wheres binary, ranges binary"
_RUN_COLUMNS = [c.split()[0] for c in _RUN.split(", ")]


def range_begins(told: DataFrame, ranges: int) -> list[bytes]:
    """Where all ranges but the first begin: evenly spaced in a sorted sample of the surviving anchors' first bytes.
    PER_RANGE anchors for each range at most come to the driver, a number that the session's partitions bound."""
    heads = told.where("head is not null").select("head", "hash", "block")
    rate = max(1, heads.count() // (PER_RANGE * ranges))
    sample = sorted(bytes(r.head) for r in heads.where(F.pmod(F.xxhash64("hash", "block"), F.lit(rate)) == 0).select("head").collect())
    at = [sample[len(sample) * k // ranges] for k in range(1, ranges)] if sample else []
    return [b for k, b in enumerate(at) if not k or b > at[k - 1]]


def repeated_ranges(staged: DataFrame, match: int = MATCH, gram: int = GRAM, hot: int = HOT, fan: int = FAN) -> DataFrame:
    """block, ranges: packed (row, start, end) byte ranges of repeated windows."""
    spark = staged.sparkSession
    def offer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, counts, heads = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], {}
        salt = np.uint64(int(key[0]) * _STEP % (1 << 64))  # other anchors in each block, so that frequent ones have their share

        def sampled(h: np.ndarray) -> np.ndarray:
            return np.flatnonzero(((h ^ salt) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) % np.uint64(SAMPLED) == 0)

        for _, _, raw, bounds in _chunks(pdf["body"].tolist(), match):
            at, h, _, _ = anchors(np.frombuffer(raw, np.uint8), bounds, match, gram)
            own, first, n = np.unique(h, return_index=True, return_counts=True)
            hashes.append(own)
            counts.append(n)
            heads.update((int(own[k]), raw[at[first[k]] : at[first[k]] + gram]) for k in sampled(own))
        every, which = np.unique(np.concatenate(hashes), return_inverse=True)
        n = np.zeros(len(every), np.int64)
        np.add.at(n, which, np.concatenate(counts))
        head = np.full(len(every), None, object)
        for k in sampled(every):
            head[k] = heads[int(every[k])]
        return pd.DataFrame({"block": np.full(len(every), key[0], np.int64), "hash": every.view(np.int64), "n": n, "head": head})

    offered = staged.select("block", "row", "body").groupBy("block").applyInPandas(offer, "block long, hash long, n long, head binary")
    total = F.sum("n").over(Window.partitionBy("hash"))  # a hash has a row per block at most
    told = settle(offered.withColumn("total", total).where("total > 1").select("block", "hash", (F.col("total") > hot).alias("many"), "head"), "survivors")
    shares = power_of_two(max(2 * parts(spark), told.count() // PER_SHARE))  # smaller ranges to merge, dealt more evenly
    begins = range_begins(told, shares)
    blocks = staged.select("block").distinct().count()
    plan = passes(blocks, shares, fan)

    def shift(level: int) -> int:
        return (shares // plan[level][0]).bit_length() - 1

    def sort_runs(key: tuple, docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(docs) or not len(told):
            return pd.DataFrame([], columns=_RUN_COLUMNS)
        hashes = told["hash"].to_numpy().view(np.uint64)
        again, many = np.sort(hashes), np.sort(hashes[told["many"].to_numpy(bool)])
        ids, ties, rows = docs["id"].tolist(), docs["tie"].tolist(), docs["row"].tolist()
        rank = docs[["id", "tie", "row"]].reset_index(drop=True).sort_values(["id", "tie", "row"]).index.argsort()
        row_of = docs["row"].to_numpy(np.int64)
        entries: list[tuple] = []
        windows: list[tuple] = []  # of hot anchors
        ranges: list[tuple] = []
        known: list[np.ndarray] = []  # ranges of hot anchors' windows that their chunk repeats
        for i, skipped, raw, bounds in _chunks(docs["body"].tolist(), match):
            buf = np.frombuffer(raw, np.uint8)
            at, h, lo, hi = anchors(buf, bounds, match, gram)
            keep = _among(h, again)
            at, h, lo, hi = at[keep], h[keep], lo[keep], hi[keep]
            which = np.searchsorted(bounds, lo, "right") - 1
            often = _among(h, many)
            if often.any():
                starts = _spread(lo[often], hi[often])
                doc = np.searchsorted(bounds, starts, "right") - 1
                order = np.lexsort((starts, rank[i + doc]))
                starts, doc = starts[order], doc[order]
                late = repeated_here(buf, starts, match, gram)
                known.append(_joined(row_of[i + doc[late]], starts[late] - bounds[doc[late]] + skipped, match))
                for b, d in zip(starts[~late].tolist(), doc[~late].tolist()):
                    k = i + d
                    windows.append((raw[b : b + match], b"", ids[k], ties[k], rows[k], b - int(bounds[d]) + skipped))
            seldom = ~often
            for a, p, q, d in zip(at[seldom].tolist(), lo[seldom].tolist(), hi[seldom].tolist(), which[seldom].tolist()):
                k = i + d
                entries.append((raw[a : q + match], raw[p:a], ids[k], ties[k], rows[k], a - int(bounds[d]) + skipped))

        def once(every: list[tuple]) -> list[tuple]:
            kept, before = [], None
            for e in sorted(every):
                if before is not None and e[0] == before[0] and e[1] == before[1]:  # in order, so the block's earliest stays
                    ranges.append((e[4], e[5] - len(e[1]), e[5] + len(e[0])))
                else:
                    kept.append(e)
                    before = e
            return kept

        part = int(key[0]) * 0x9E3779B97F4A7C15 % (1 << 64) % plan[0][1]
        entries, windows = once(entries), once(windows)
        return _runs(entries, windows, np.concatenate([np.array(ranges, np.int64).reshape(-1, 3), *known]), 0, part)

    def _runs(entries: list[tuple], windows: list[tuple], ranges: np.ndarray, level: int, part: int) -> pd.DataFrame:
        """The runs that the merge of this level takes, of sorted entries; known ranges go with them, evenly. Shares of
        windows have numbers behind those of the ranges."""
        narrow = shift(level)
        out: dict[int, list[tuple]] = {}
        for share, a, b in _cut(entries, begins):
            out.setdefault(share >> narrow, []).extend(entries[a:b])
        for e in windows:
            out.setdefault(shares + zlib.crc32(e[0]) % shares >> narrow, []).append(e)
        if len(ranges) and not out:
            out[0] = []
        return pd.DataFrame([(share, part, *_encoded(run, ranges[k :: len(out)])) for k, (share, run) in enumerate(out.items())], columns=_RUN_COLUMNS)

    def premerge(level: int):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            runs, lefts, wheres = _decoded(pdf)
            ranges: list[tuple] = []
            kept: list[tuple] = []
            right, first = None, {}

            def flush() -> None:
                kept.extend((right, left, *where) for left, where in sorted(first.items()))
                first.clear()

            for r, i, _ in merge_runs(runs):
                if runs[r][0][i] != right:
                    flush()
                    right = runs[r][0][i]
                left, where = lefts[r][i], wheres[r][i]
                seen = first.get(left)
                if seen is None or where < seen:
                    first[left] = where
                if seen is not None:
                    late = max(seen, where)
                    ranges.append((late[2], late[3] - len(left), late[3] + len(right)))
            flush()
            hot_ones = int(key[0]) >= shares >> shift(level)
            ranges = np.concatenate([np.array(ranges, np.int64).reshape(-1, 3), *map(_unpack, pdf["ranges"])])
            return _runs([] if hot_ones else kept, kept if hot_ones else [], ranges, level + 1, int(key[1]) // fan if plan[level + 1][1] > 1 else 0)

        return run

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        runs, lefts, wheres = _decoded(pdf)
        told = Repeats(match, gram)
        for r, i, shared in merge_runs(runs):
            told.add(shared, runs[r][0][i], lefts[r][i], wheres[r][i])
        told.flush()
        every = np.concatenate([np.array(told.found, np.int64).reshape(-1, 3), *(_unpack(x) for x in pdf["ranges"])])
        every = every[np.argsort(every[:, 0], kind="stable")]
        blocks = every[:, 0] >> BLOCK_BITS
        cuts = [*np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1]))).tolist(), len(every)] if len(every) else [0]
        return pd.DataFrame([(int(blocks[a]), every[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])], columns=["block", "ranges"])

    texts = staged.select("block", "row", "id", "tie", "body")
    runs = texts.groupBy("block").cogroup(told.select("block", "hash", "many").groupBy("block")).applyInPandas(sort_runs, _RUN)
    for level in range(len(plan) - 1):
        runs = runs.groupBy("share", "part").applyInPandas(premerge(level), _RUN)
    return runs.groupBy("share").applyInPandas(merge, "block long, ranges binary")


def _among(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    i = np.searchsorted(sorted_values, x)
    return sorted_values[np.minimum(i, len(sorted_values) - 1)] == x


def remove_repeats(docs: DataFrame, match: int = MATCH, gram: int = GRAM, hot: int = HOT, fan: int = FAN, carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row; on demand carried columns and
    ``kept_text`` (the remaining bytes as text; a character of which bytes went is left out)."""
    staged = stage_blocks(docs, carry)
    ranges = repeated_ranges(staged, match, gram, hot, fan)
    kinds = dict(staged.dtypes)
    extra = [f"`{c}` {kinds[c]}" for c in carry] + ["kept_text string"] * with_text
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *carry, *["kept_text"] * with_text]

    def finish(key: tuple, docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        every = np.concatenate([_unpack(x) for x in told["ranges"]]) if len(told) else np.zeros((0, 3), np.int64)
        every = every[np.argsort(every[:, 0], kind="stable")]
        out = []
        for row, body in zip(docs["row"].tolist(), docs["body"].tolist()):
            a, b = np.searchsorted(every[:, 0], [row, row + 1])
            removed = spans = 0
            if b > a:
                lo, hi = every[a:b][np.argsort(every[a:b, 1]), 1:].T
                hi = np.maximum.accumulate(hi)
                cut = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
                lo, hi = lo[cut], hi[np.concatenate((cut[1:] - 1, [len(hi) - 1]))]
                removed, spans = int((hi - lo).sum()), len(lo)
                body = b"".join(body[x:y] for x, y in zip([0, *hi.tolist()], [*lo.tolist(), len(body)]))
            out.append((len(body) + removed, removed, spans, hashlib.sha256(body).hexdigest(), body))
        got = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "body"])
        got.insert(0, "doc_id", docs["doc_id"].to_numpy())
        for c in carry:
            got[c] = docs[c].to_numpy()
        if with_text:
            got["kept_text"] = [x.decode("utf-8", "ignore") for x in got["body"]]
        return got[columns]

    schema = ", ".join([f"doc_id {kinds['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", *extra])
    return staged.groupBy("block").cogroup(ranges.groupBy("block")).applyInPandas(finish, schema)
