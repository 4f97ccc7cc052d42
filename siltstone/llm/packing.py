"""Sum-of-squares online packing of token sequences.

Documents arrive one after another. What exceeds a whole window is cut off as full windows; the rest
goes to the fill level that minimises the sum, over levels, of the squared number of partially filled
windows, tracked in an array indexed by level. Each scan partition packs its own stream, so there is no
shuffle and a lost task is simply packed again. When a stream ends, the windows still open keep what sum of
squares gave them; only the emptiest are dissolved, and their pieces fill the gaps of the fullest, one cut a
window at most. The one window that is left then is cut into powers of two, so that nothing is padded.

At most one window a fill level is open as a rule, so the part that is moved at the end is bounded by the
window, not by the stream: it shrinks as partitions grow. Sequence ids carry the partition's number; the
layout follows the partitions of ``docs``.

Edges: null text is empty and still has its closing id 0; a text of any length and kind is encoded, long
runs of white space too; a repeated row is a document of its own; a null doc_id stays null; an empty table
packs to nothing; other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import text_or_empty

WINDOW = 1024
END_ID = 0
#: Fixed value: how the byte-level vocabulary splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the white space of that pattern (Unicode's White_Space).
WHITE = "\t\n\v\f\r\x20\x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: White space beyond this many characters is cut out before the pattern, which goes back step by step over it.
LONG_RUN = 100_000
_LONG = re.compile(rf"(?<![{WHITE}])[{WHITE}]{{{LONG_RUN}}}[{WHITE}]*")
_encoders: dict = {}


class Encoder:
    """The byte-level vocabulary by its rank file, which gives the ids that its JSON file gives, several
    times faster; special strings inside a text become their id, as the JSON's library does."""

    def __init__(self, ranks_path: str, special: tuple[tuple[str, int], ...]):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.special = dict(special)
        self.inner = tiktoken.Encoding("siltstone", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.special)
        names = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.cut = re.compile(f"({names})" if names else "(?!)")

    def ids(self, text: str) -> list[int]:
        if len(text) < LONG_RUN or not _LONG.search(text):
            return self.inner.encode(text, allowed_special="all")
        out: list[int] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
                continue
            at = 0
            for m in _LONG.finditer(part):
                # the pattern takes the run as one piece, but for its last character where more text follows
                end = m.end() - (m.end() < len(part))
                out += self.inner.encode_ordinary(part[at : m.start()])
                out += self.inner._encode_single_piece(part[m.start() : end])
                at = end
            out += self.inner.encode_ordinary(part[at:])
        return out


def encoder(ranks_path: str, special: tuple[tuple[str, int], ...]) -> Encoder:
    if ranks_path not in _encoders:
        _encoders[ranks_path] = Encoder(ranks_path, special)
    return _encoders[ranks_path]


class Level:
    """Windows by fill level, and the choice of the level for the next item."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def choose(self, size: int) -> int:
        """Fill level (0: a new window) that minimises the sum of squares after placing; ties go to
        the fullest. Moving a window from level h to h + size changes the sum by
        2 * (count[h + size] - count[h] + 1), where empty and full windows count nothing."""
        w, n = self.window, self.count
        was = n[: w - size + 1]
        will = n[size : w + 1]
        change = 2 * will + 1 + 1 - 2 * was
        change[0] = 2 * will[0] + 1  # a new window leaves no level
        if size <= w:
            change[-1] = (1 - 2 * was[-1]) if w - size else 0  # a filled one enters none
        allowed = was > 0
        allowed[0] = True
        best = np.where(allowed, change, np.iinfo(np.int64).max)
        return int(len(best) - 1 - np.argmin(best[::-1]))

    def take(self, level: int) -> int | None:
        if not level:
            return None
        self.count[level] -= 1
        return self.open[level].pop()

    def put(self, level: int, which: int) -> None:
        if level < self.window:
            self.count[level] += 1
            self.open[level].append(which)


class Packer:
    """Packs documents' ids; yields finished pieces (doc, start, ids, doc_tokens, sequence, offset).

    placed and moved: ids laid by sum of squares so far, and those of them that the end of the stream moved."""

    def __init__(self, window: int = WINDOW):
        self.window, self.levels, self.held, self.next = window, Level(window), {}, 0
        self.placed = self.moved = 0

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        w, n = self.window, len(ids)
        whole = n - n % w
        for a in range(0, whole, w):
            yield doc, a, ids[a : a + w], n, self._new(), 0
        if whole < n:
            rest = ids[whole:]
            self.placed += len(rest)
            level = self.levels.choose(len(rest))
            which = self.levels.take(level)
            if which is None:
                self.held[which := self._new()] = []
            self.held[which].append((doc, whole, rest, n))
            if level + len(rest) == w:
                yield from self._close(which, self.held.pop(which))
            else:
                self.levels.put(level + len(rest), which)

    @staticmethod
    def _close(which: int, items: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, n in items:
            yield doc, start, ids, n, which, at
            at += len(ids)

    def finish(self) -> Iterator[tuple]:
        """Fills the fullest open windows with the pieces of the emptiest; the last is cut into powers of two."""
        w = self.window
        queue = [(level, which) for level in range(w - 1, 0, -1) for which in self.levels.open[level]]
        full, empty, spare = 0, len(queue), []  # open windows: queue[full:empty]; pieces of dissolved ones: spare
        while full < empty:
            level, which = queue[full]
            items = self.held[which]
            while level < w and (spare or empty - full > 1):
                if not spare:
                    empty -= 1
                    spare = self.held.pop(queue[empty][1])[::-1]
                doc, start, ids, n = spare.pop()
                piece, rest = ids[: w - level], ids[w - level :]
                items.append((doc, start, piece, n))
                if len(rest):
                    spare.append((doc, start + len(piece), rest, n))
                level += len(piece)
                self.moved += len(piece)
            if level < w:
                break
            yield from self._close(which, self.held.pop(which))
            full += 1
        last = self.held.pop(queue[full][1]) if full < empty else spare[::-1]
        left = sum(len(x[2]) for x in last)
        self.moved += left
        self.levels, self.held = Level(w), {}
        which, room, at = -1, 0, 0
        for doc, start, ids, n in last:
            while len(ids):
                if not room:
                    room = 1 << (left.bit_length() - 1)
                    which, at = self._new(), 0
                    left -= room
                piece, ids = ids[:room], ids[room:]
                yield doc, start, piece, n, which, at
                start, at, room = start + len(piece), at + len(piece), room - len(piece)


def pack(docs: DataFrame, ranks_path: str, special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),), window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids
    themselves if asked for. ``window`` is a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(ranks_path, special), Packer(window)
        base = TaskContext.get().partitionId() << 36
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        kind = None

        def table(pieces: list[tuple]) -> pa.RecordBatch:
            cols = [
                pa.array([p[0] for p in pieces], kind),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([len(p[2]) for p in pieces], pa.int64()),
                pa.array([zlib.crc32(p[2].tobytes()) for p in pieces], pa.int64()),
                pa.array([p[3] for p in pieces], pa.int64()),
                pa.array([base + p[4] for p in pieces], pa.int64()),
                pa.array([p[5] for p in pieces], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(cols + [pa.array([p[2].tolist() for p in pieces], pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)

        done: list[tuple] = []
        for b in batches:
            kind = b.column(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = enc.ids(text)
                ids.append(END_ID)
                done.extend(packer.add(doc, np.array(ids, "<u4")))
                if len(done) >= 4096:
                    yield table(done)
                    done = []
        done.extend(packer.finish())
        if done:
            yield table(done)

    plain = docs.select("doc_id", text_or_empty().alias("text"))
    return plain.mapInArrow(run, f"doc_id {dict(plain.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
