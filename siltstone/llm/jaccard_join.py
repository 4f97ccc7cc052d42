"""N-gram Jaccard join over size-banded tiles with hashed bitmap signatures.

1. Every text becomes the set of its distinct 5-word shingles, as 64-bit hashes.
2. Shingles meet in hash shares; one that is in a single set can link nothing and stays out. What remains
   of each set goes back to its document. A set with fewer such shingles than a link needs is done.
3. Equal sets form a class with one representative. In one global order (rarest first), two sets that
   link share a shingle among the first few of each (prefix filter); classes connected by such shingles
   form a cluster, outside of which there are no links.
4. Clusters are dealt into tiles by size band (a set links only within its own and the next bands). In a
   tile, bitmaps of hashed shingles bound the overlap of two sets from above by bit counts; pairs that
   could still link are decided by intersecting the sorted arrays. Pairs already connected are skipped,
   so a group of copies costs one comparison each, not one per pair.
5. Clusters larger than a tile are joined up across tiles: first by one set per part, then every set
   outside a cluster's largest part against all others, so no link between parts is missed.

Edges: null or wordless texts have the empty set and link with nothing; texts below five words have their
whole word sequence as one shingle; null doc_ids count after all others in ``component_id`` and rows that
share a doc_id count separately; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BITS, files_for, in_blocks, numbered, parts, power_of_two, settle
from .components import components

WORDS = 5
SIMILAR = (75, 100)  # intersection over union at least 75 / 100
TILE = 256
BATCH_BYTES = 8 << 20
#: Longer words are hashed by BLAKE2: modulo 2 ** 64 some words of 1024 bytes have one polynomial whatever its base.
LONG_WORD = 128
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_rng = np.random.default_rng(20230811)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(power_of_two(n), 1 << 20)
        _powers = tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (_BASE, _BASE_INVERSE))
    return _powers


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (size < 1 << 19 or j == i):
            size += len(texts[j]) + 1
            j += 1
        out += _chunk_sets(texts[i:j])
        i = j
    return out


def _chunk_sets(texts: list[bytes]) -> list[np.ndarray]:
    raw = np.frombuffer(b"\n".join(texts).translate(_LOWER) + b"\n", np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    space = _IS_SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    first, last = edge[::2], edge[1::2]  # the text ends with a space
    power, inverse = _power_tables(len(raw))
    sums = np.cumsum(_BYTE[raw] * power[: len(raw)])
    before = np.where(first > 0, sums[first - 1], np.uint64(0))
    word = _mix((sums[last - 1] - before) * inverse[first])
    for k in np.flatnonzero(last - first > LONG_WORD).tolist():
        word[k] = int.from_bytes(hashlib.blake2b(raw[first[k] : last[k]].tobytes(), digest_size=8).digest(), "little")
    if len(word) >= WORDS:
        gram = sum((word[k : len(word) - WORDS + 1 + k] * _PLACE[k] for k in range(1, WORDS)), word[: len(word) - WORDS + 1] * _PLACE[0])
        gram = _mix(gram)
    else:
        gram = word[:0]
    cuts = np.searchsorted(first, begins).tolist()
    out = []
    for a, b in zip(cuts, cuts[1:]):
        n = b - a
        if n >= WORDS:
            out.append(np.unique(gram[a : b - WORDS + 1]))
        elif n:
            out.append(_mix((word[a:b] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True), n))
        else:
            out.append(word[:0])
    return out


def least_overlap(a: int | np.ndarray, b: int | np.ndarray) -> int | np.ndarray:
    """Fewest common shingles with which sets of a and b shingles link."""
    p, q = SIMILAR
    return -(-p * (a + b) // (p + q))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _dealt(rows: np.ndarray, shares: int) -> np.ndarray:
    return (_mix(rows.view(np.uint64)) % np.uint64(shares)).astype(np.int64)


def repeated_shingles(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row, doc_id, n (set size), fp1 and fp2 (the set's fingerprint), leads (first of its set in its
    batch), shared (sorted hashes of the shingles that other sets have too, if enough for a link), and
    prefix (the shingles by which it can meet a set that it links with)."""
    spark = docs.sparkSession
    shares = power_of_two(parts(spark))
    shift = np.uint64(64 - shares.bit_length() + 1)
    offered = "share int, rows binary, counts binary, hashes binary, about binary"

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def offer(rows: list[int], ids: list, texts: list[bytes]) -> pa.RecordBatch:
            sets = shingle_sets(texts)
            own, leads, seen = [], [], set()
            about = np.zeros((len(rows), 7), np.int64)
            for k, (row, doc, s) in enumerate(zip(rows, ids, sets)):
                fp = (int(_mix(s, 1).sum(dtype=np.uint64)), int(_mix(s, 2).sum(dtype=np.uint64)), len(s))
                if len(s) and fp not in seen:
                    seen.add(fp)
                    own.append(k)
                    lead = 1
                else:
                    lead = 0
                f = np.array(fp[:2], np.uint64).view(np.int64)
                about[k] = (row, doc or 0, doc is not None, len(s), f[0], f[1], lead)
            row_of = np.array(rows, np.int64)
            out = [[], [], [], [], []]

            def put(*values) -> None:
                for c, v in zip(out, values):
                    c.append(v)

            if own:
                every = np.concatenate([sets[k] for k in own])
                owner = np.repeat(np.array(own, np.int64), [len(sets[k]) for k in own])
                share = (every >> shift).astype(np.int64) if shares > 1 else np.zeros(len(every), np.int64)
                order = np.argsort(share.astype(np.uint16 if shares <= 1 << 16 else np.int64), kind="stable")
                every, owner, share = every[order], owner[order], share[order]
                cuts = np.searchsorted(share, np.arange(shares + 1))
                for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if b > a:
                        o = owner[a:b]
                        starts = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
                        put(s, row_of[o[starts]].tobytes(), np.diff(np.append(starts, b - a)).astype(np.uint32).tobytes(), every[a:b].tobytes(), None)
            to = _dealt(row_of, shares)
            for s in np.unique(to):
                put(int(s), None, None, None, about[to == s].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["share", "rows", "counts", "hashes", "about"])

        for b in batches:
            rows, ids, texts = (b.column(k).to_pylist() for k in range(3))
            i = 0
            while i < len(rows):
                j, size = i, 0
                while j < len(rows) and (size < BATCH_BYTES or j == i):
                    size += len(texts[j])
                    j += 1
                yield offer(rows[i:j], ids[i:j], texts[i:j])
                i = j

    def sieve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sets, about = pdf[pdf["about"].isna()], pdf["about"].dropna()
        out = [(int(key[0]), None, None, None, None, b"".join(about))] if len(about) else []
        if len(sets):
            every = np.concatenate([np.frombuffer(x, np.uint64) for x in sets["hashes"]])
            row = np.concatenate([np.repeat(np.frombuffer(r, np.int64), np.frombuffer(c, np.uint32)) for r, c in zip(sets["rows"], sets["counts"])])
            order = np.argsort(every)
            every, row = every[order], row[order]
            starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
            n = np.diff(np.append(starts, len(every)))
            often = np.repeat(n, n)
            keep = often > 1
            every, row, often = every[keep], row[keep], np.minimum(often[keep], 255).astype(np.uint8)
            to = _dealt(row, shares)
            order = np.lexsort((row, to))
            every, row, often, to = every[order], row[order], often[order], to[order]
            cuts = np.searchsorted(to, np.arange(shares + 1))
            for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    r = row[a:b]
                    starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                    out.append((s, r[starts].tobytes(), np.diff(np.append(starts, b - a)).astype(np.uint32).tobytes(), every[a:b].tobytes(), often[a:b].tobytes(), None))
        return pd.DataFrame(out, columns=["share", "rows", "counts", "hashes", "often", "about"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        about = np.frombuffer(b"".join(pdf["about"].dropna()), np.int64).reshape(-1, 7)
        got = pdf[pdf["about"].isna()]
        if len(got):
            row = np.concatenate([np.repeat(np.frombuffer(r, np.int64), np.frombuffer(c, np.uint32)) for r, c in zip(got["rows"], got["counts"])])
            every = np.frombuffer(b"".join(got["hashes"]), np.uint64)
            often = np.frombuffer(b"".join(got["often"]), np.uint8)
            order = np.argsort(row, kind="stable")
            row, every, often = row[order], every[order], often[order]
        else:
            row, every, often = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        low, high = np.searchsorted(row, about[:, 0]), np.searchsorted(row, about[:, 0], "right")
        shared, prefix = [], []
        for n, a, b, leads in zip(about[:, 3].tolist(), low.tolist(), high.tolist(), about[:, 6].tolist()):
            least = -(-SIMILAR[0] * n // SIMILAR[1])
            if not leads or b - a < least:
                shared.append(None)
                prefix.append(None)
                continue
            x = every[a:b]
            # rarest first; shingles of this set alone come before and use up a part of the prefix
            first = np.lexsort((x, often[a:b]))[: b - a - least + 1]
            prefix.append(_signed(x[first]).tolist())
            shared.append(np.sort(x).tobytes())
        return pd.DataFrame({
            "row": about[:, 0], "doc_id": pd.array(np.where(about[:, 2] == 1, about[:, 1], 0), "Int64").copy() if (about[:, 2] == 1).all() else pd.array([d if k else None for d, k in zip(about[:, 1].tolist(), about[:, 2].tolist())], "Int64"),
            "n": about[:, 3], "fp1": about[:, 4], "fp2": about[:, 5], "leads": about[:, 6] == 1, "shared": shared, "prefix": prefix,
        })

    row = F.monotonically_increasing_id() if row is None else F.col(row)
    plain = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))
    sieved = plain.mapInArrow(shingle, offered).groupBy("share").applyInPandas(sieve, "share int, rows binary, counts binary, hashes binary, often binary, about binary")
    return sieved.groupBy("share").applyInPandas(gather, "row long, doc_id long, n long, fp1 long, fp2 long, leads boolean, shared binary, prefix array<long>")


class Tile:
    """Sets in ascending order of size, their bitmaps, and which of them are known to be connected."""

    def __init__(self, rows: list[int], sizes: list[int], shared: list[bytes], part: list[int]):
        order = sorted(range(len(rows)), key=lambda i: (sizes[i], rows[i]))
        self.rows = [rows[i] for i in order]
        self.size = np.array([sizes[i] for i in order], np.int64)
        self.sets = [np.frombuffer(shared[i], np.uint64) for i in order]
        self.held = np.array([len(s) for s in self.sets], np.int64)
        _, self.part = np.unique(np.array([part[i] for i in order], np.int64), return_inverse=True)
        bits = min(4096, max(64, power_of_two(2 * int(self.held.max()))))
        self.maps = np.zeros((len(rows), bits // 64), np.uint64)
        for i, s in enumerate(self.sets):
            b = s & np.uint64(bits - 1)
            np.bitwise_or.at(self.maps[i], (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))

    def links(self, asked: list[int] | None = None) -> Iterator[tuple[int, int]]:
        """Links that connect all that is connected by links; asked: places of sets of which the links to
        any other are looked for (default: all)."""
        m = len(self.rows)
        every = asked is None
        for i in range(m) if every else asked:
            # a set links only with sizes within the band
            top = int(np.searchsorted(self.size, self.size[i] * SIMILAR[1] // SIMILAR[0], "right"))
            low = i + 1 if every else int(np.searchsorted(self.size, -(-self.size[i] * SIMILAR[0] // SIMILAR[1]), "left"))
            near = low + np.flatnonzero(self.part[low:top] != self.part[i])
            if not len(near):
                continue
            mine = self.maps[i]
            least = least_overlap(self.size[near], self.size[i])
            extra = np.bitwise_count(self.maps[near] & ~mine).sum(axis=1, dtype=np.int64)
            lacking = np.bitwise_count(mine & ~self.maps[near]).sum(axis=1, dtype=np.int64)
            could = np.minimum(self.held[near] - extra, self.held[i] - lacking) >= least
            for j, need in zip(near[could].tolist(), least[could].tolist()):
                if self.part[i] == self.part[j]:
                    continue
                a, b = (self.sets[i], self.sets[j]) if len(self.sets[i]) <= len(self.sets[j]) else (self.sets[j], self.sets[i])
                if np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a) >= need:
                    self.part[self.part == self.part[j]] = self.part[i]
                    yield self.rows[i], self.rows[j]


_LINK = "a long, b long"
_KEY = ["cluster", "u", "v"]


def _in_tiles(sets: DataFrame) -> DataFrame:
    """Links within each tile; sets: cluster, u, v (the tile), row, n, shared, part, asks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def tile(g: pd.DataFrame) -> list[tuple[int, int]]:
            g = g.drop_duplicates("row")
            if len(g) < 2 or not g["asks"].any():
                return []
            t = Tile(g["row"].tolist(), g["n"].tolist(), g["shared"].tolist(), g["part"].tolist())
            if g["asks"].all():
                return list(t.links())
            asking = set(g["row"][g["asks"]])
            return list(t.links([i for i, r in enumerate(t.rows) if r in asking]))

        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            key = pdf[_KEY].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))).tolist() if len(pdf) else []
            out = [x for a, b in zip(starts, starts[1:]) for x in tile(pdf.iloc[a:b])]
            rest = pdf.iloc[starts[-1] :] if starts else None
            yield pd.DataFrame(out, columns=["a", "b"])
        if rest is not None:
            yield pd.DataFrame(tile(rest), columns=["a", "b"])

    dealt = sets.repartition(parts(sets.sparkSession), *_KEY).sortWithinPartitions(*_KEY, F.desc("asks"))
    return dealt.select(*_KEY, "row", "n", "shared", "part", "asks").mapInPandas(run, _LINK)


def links(sets: DataFrame) -> DataFrame:
    """a, b: links between representatives (rows of ``sets``: row, n, shared, prefix) that connect all
    that links connect."""
    posts = sets.select("row", F.explode("prefix").alias("shingle"))
    firsts = posts.groupBy("shingle").agg(F.min("row").alias("b"), F.count("*").alias("c")).where("c > 1")
    firsts = settle(firsts, "firsts")  # written, so that Spark can split the join's hot keys; so are the small tables below
    near = posts.join(firsts, "shingle").where("row <> b").select(F.col("row").alias("a"), "b").distinct()
    clusters = components(near, "clusters").withColumnsRenamed({"node": "row", "root": "cluster"})
    held = settle(sets.select("row", "n", "shared").join(clusters, "row"), "clustered")
    band = F.floor(F.log("n") / math.log(SIMILAR[1] / SIMILAR[0])).cast("int")
    held = held.withColumn("band", band)
    few = files_for(sets.sparkSession, held.count())
    size = settle(held.groupBy("cluster").agg(F.count("*").alias("size")), "sizes", few)
    small = held.join(size.where(f"size <= {TILE}"), "cluster")
    large = held.join(size.where(f"size > {TILE}"), "cluster").drop("size")
    in_small = small.select("cluster", F.lit(0).alias("u"), F.lit(0).alias("v"), "row", "n", "shared", F.col("row").alias("part"), F.lit(True).alias("asks"))
    tiles = settle(large.groupBy("cluster", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), "tiles", few)
    tiled = settle(large.join(tiles, ["cluster", "band"]).withColumn("tile", F.expr("cast(pmod(xxhash64(row), tiles) as int)")), "tiled")
    in_large = tiled.select("cluster", F.col("band").alias("u"), F.col("tile").alias("v"), "row", "n", "shared", F.col("row").alias("part"), F.lit(True).alias("asks"))
    keep = lambda df: settle(df.repartition(few), "links")  # noqa: E731  links are few, however many tiles gave them
    found = keep(_in_tiles(in_small.unionByName(in_large)))
    if not tiled.limit(1).count():
        return found

    def with_parts(found: DataFrame) -> DataFrame:
        label = components(found, "parts").withColumnsRenamed({"node": "row", "root": "part"})
        return tiled.join(label, "row", "left").withColumn("part", F.coalesce("part", "row"))

    # one set of each part, band by band, a tile at a time: joins most parts of large groups of copies
    heads = with_parts(found).where("row = part")
    count = settle(heads.groupBy("cluster").agg(F.ceil(F.count("*") / (4 * TILE)).cast("int").alias("many")), "heads", few)
    heads = heads.join(count, "cluster").select("cluster", F.lit(-1).alias("u"), F.expr("cast(pmod(xxhash64(row, 1), many) as int)").alias("v"), "row", "n", "shared", "part", F.lit(True).alias("asks"))
    found = keep(found.union(_in_tiles(heads)))

    # whatever is outside its cluster's largest part, against all other sets of neighbouring bands
    every = settle(with_parts(found), "parted")
    weight = every.groupBy("cluster", "part").agg(F.count("*").alias("c"))
    largest = settle(weight.groupBy("cluster").agg(F.max_by("part", F.struct("c", "part")).alias("largest")), "largest", few)
    minor = every.join(largest, "cluster").where("part <> largest").drop("largest")
    if not minor.limit(1).count():
        return found
    asked = minor.groupBy("cluster", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("asked"))
    asked = settle(asked, "asked", 1)
    place = F.expr("cast(pmod(xxhash64(row, 2), asked) as int)")
    # key: (asking band and tile, other band and tile), each packed in a long
    packed = lambda b, t: F.shiftleft(b.cast("long"), 32) + t
    others = every.withColumn("near", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    others = others.join(asked.select("cluster", F.col("band").alias("near"), "asked"), ["cluster", "near"])
    others = others.withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asked") - 1)))
    others = others.select("cluster", packed(F.col("near"), F.col("ask")).alias("u"), packed(F.col("band"), F.col("tile")).alias("v"), "row", "n", "shared", "part", F.lit(False).alias("asks"))
    bands = tiles.select("cluster", F.col("band").alias("other"), "tiles")
    asking = minor.drop("tiles").join(asked, ["cluster", "band"]).withColumn("other", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    asking = asking.join(bands, ["cluster", "other"]).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    asking = asking.select("cluster", packed(F.col("band"), place).alias("u"), packed(F.col("other"), F.col("o")).alias("v"), "row", "n", "shared", "part", F.lit(True).alias("asks"))
    return keep(found.union(_in_tiles(others.unionByName(asking))))


def jaccard_components(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row, doc_id, n_shingles, component_id for every row of ``docs``; ``kept`` marks one row of each component.
    row: a column that numbers the rows, if there is one."""
    sets = settle(repeated_shingles(docs, row), "sets")
    key = ["fp1", "fp2", "n"]
    classes = sets.where("n > 0").groupBy(*key).agg(F.min(F.when(F.col("leads"), F.col("row"))).alias("head"), F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"))
    classes = settle(classes, "classes")
    few = files_for(docs.sparkSession, classes.count())
    heads = sets.where("shared is not null").select("row", "n", "shared", "prefix").join(classes.select(F.col("head").alias("row")), "row", "left_semi")
    joined = components(links(heads), "joined").withColumnsRenamed({"node": "head", "root": "component"})
    labelled = settle(classes.join(joined, "head", "left").withColumn("component", F.coalesce("component", "head")), "labelled", few)
    # written, so that both sides of the join below are plain exchanges, whose hot keys Spark can split
    whole = settle(labelled.groupBy("component").agg(F.min("low").alias("component_id"), F.min("best").alias("best")), "whole", few)
    told = settle(labelled.select(*key, "component").join(whole, "component").select(*key, "component_id", F.col("best.row").alias("best")), "components", few)
    out = sets.select("row", "doc_id", *key).join(told, key, "left")
    alone = F.col("n") == 0
    return out.select("row", "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("row") == F.col("best"))).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of each component (the smallest doc_id stays)."""
    staged = in_blocks(numbered(docs, "text"), "near-copies")
    kept = jaccard_components(staged, "row").where("kept").select(F.shiftright("row", BLOCK_BITS).alias("block"), "row")
    # one array of at most 2 ** BLOCK_BITS rows per block, so that the join is by the texts' bucketing alone
    rows = kept.groupBy("block").agg(F.collect_list("row").alias("rows"))
    return staged.join(rows, "block").where(F.array_contains("rows", F.col("row"))).select(*docs.columns)
