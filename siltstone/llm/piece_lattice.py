"""N-best segmentation into SentencePiece pieces: forward Viterbi, backward A-star.

The scores of the best way to each position of the lattice, from a forward Viterbi pass, are exact
heuristics for the search that runs back from the end: hypotheses come off the agenda best first, each goes
back to the start along the best edges and is the next best segmentation, and the edges that depart from
its way are the agenda's next hypotheses. It never holds more than are still wanted, so a chunk of any length costs n
walks over it, also where all segmentations tie (a run of one letter).

A text's lattice falls apart wherever no piece of the vocabulary crosses (before the first of a run of
spaces, around line ends): these chunks are solved once per distinct chunk, and the n best of the whole
are the n least sums of what its chunks lose, searched best first over the n - 1 chunks that lose least
(a segmentation that departs from the best elsewhere has n - 1 better ones before it). What the search back
would put out first needs no agenda: with exact heuristics it is the Viterbi path itself, so a chunk
that departs nowhere takes its ids from there, and how much its second best loses from the two best
scores to its end; the agenda runs for chunks that may depart. Tests hold the two against each other.

Scores are the vocabulary's own; a character without a piece is spelled in byte pieces at the least score
minus 10. Edges: null or empty text has no pieces and one segmentation; the mark U+2581 inside a text
decodes to a space, as in the library (``lossless`` says whether decoding gives the text back); ties
go to the segmentation found first, longer last pieces first; rows that repeat a doc_id or a text count separately; an empty
table gives an empty result; other columns are not read; work and memory grow with a text's length, whatever it repeats.
"""

from __future__ import annotations

import re
import string
import zlib
from bisect import insort
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush, nsmallest
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_or_empty

MARK = "▁"
CACHE_ENTRIES = 400_000
_LEAST, _MOST, _LOSS = float("-inf"), float("inf"), itemgetter(2)
_CODES, _LETTERS = 0x2600, 0x180  # Latin letters and signs; chunks with others are solved one by one
_TOGETHER = 40  # longest chunks that are solved many at once


class Pieces(dict):
    """The vocabulary, and the n best segmentations of each chunk met."""

    def __init__(self, path: str, n_best: int):
        super().__init__()
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.n = n_best
        self.old: dict[str, tuple] = {}
        self.piece: dict[str, tuple[float, int]] = {}
        self.bytes = [0] * 256
        self.spelled: list[bytes] = [b""] * size
        self.four = [i.to_bytes(4, "little") for i in range(size)]
        for i in range(size):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(p[3:-1], 16)] = i
                self.spelled[i] = bytes([int(p[3:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.piece[p] = (model.get_score(i), i)
                self.spelled[i] = p.replace(MARK, " ").encode()
        # scores of pieces that are never to be chosen lie far below the others
        self.unknown = min(s for s, _ in self.piece.values() if s > -1e8) - 10
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.piece):
            raise ValueError("a piece of this vocabulary crosses words")
        self.longest = max(map(len, self.piece))
        ends: dict[str, set[int]] = {}
        for p in self.piece:
            ends.setdefault(p[-1], set()).add(len(p))
        self.lengths = {c: sorted(x, reverse=True) for c, x in ends.items()}
        # every beginning of a piece, so that a search for longer ones can stop
        self.begun: dict[str, tuple[float, int] | None] = {p[:k]: None for p in self.piece for k in range(1, len(p))}
        self.begun.update(self.piece)
        # the same as a trie: character to (what may follow, score or None, id)
        self.trie: dict[str, tuple] = {}
        for p in sorted(self.begun, key=len):
            below = self.trie
            for c in p[:-1]:
                below = below[c][0]
            below[p[-1]] = ({}, *(self.begun[p] or (None, -1)))
        self._tabulate()
        # a chunk also ends before a sign that no piece holds behind a letter or any character but such signs
        signs = set(string.punctuation)
        while stray := {c for p in self.piece for x, c in zip(p, p[1:]) if c in signs and x != MARK and x not in signs}:
            signs -= stray
        listed = re.escape("".join(sorted(signs)))
        at, word = f"[{listed}]" if signs else "(?!)", f"[^{MARK}\n{listed}]"
        self.chunks = re.compile(f"{MARK}+(?:{at}[^{MARK}\n]*|{word}*)|{at}[^{MARK}\n]*|\n|{word}+").findall

    def _tabulate(self) -> None:
        """The trie as arrays, for Latin characters that are pieces themselves: next node by node and
        character class (0: none), and each node's score and id."""
        letters = sorted({c for p in self.piece for c in p if (ord(c) < _LETTERS or c == MARK) and c in self.piece})
        self.kind = np.zeros(_CODES, np.uint16)
        self.kind[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        known = set(letters)
        inside = [p for p in self.begun if known.issuperset(p)]
        number = {"": 1} | {p: i for i, p in enumerate(sorted(inside, key=len), 2)}
        self.next = np.zeros((len(number) + 1, len(letters) + 1), np.uint16 if len(number) < 1 << 16 else np.uint32)
        self.node_score, self.node_id = np.full(len(number) + 1, _LEAST), np.full(len(number) + 1, -1, np.int32)
        for p, i in number.items():
            if p:
                self.next[number[p[:-1]], self.kind[ord(p[-1])]] = i
                if self.begun[p] is not None:
                    self.node_score[i], self.node_id[i] = self.begun[p]

    def learn(self, chunks: Iterable[str]) -> None:
        """Solves the chunks that are not known yet, those of one length together."""
        by_length: dict[int, list[str]] = {}
        for c in chunks:
            if c not in self and len(c) <= _TOGETHER:
                if (got := self.old.get(c)) is not None:
                    self.keep(c, got)
                else:
                    by_length.setdefault(len(c), []).append(c)
        for n, group in by_length.items():
            for a in range(0, len(group), 1 << 15):
                self._learn_equal(n, group[a : a + (1 << 15)])

    def _learn_equal(self, n: int, group: list[str]) -> None:
        codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
        kinds = np.where(codes < _CODES, self.kind[np.minimum(codes, _CODES - 1)], 0)
        plain = (kinds > 0).all(axis=1)
        if not plain.all():  # others are solved one by one when they come up
            group = [c for c, ok in zip(group, plain.tolist()) if ok]
            kinds = kinds[plain]
        m = len(group)
        if not m:
            return
        kinds = np.ascontiguousarray(kinds.T)
        best, second = np.full((n + 1, m), _LEAST), np.full((n + 1, m), _LEAST)
        best[0] = 0.0
        start, piece = np.zeros((n + 1, m), np.int16), np.zeros((n + 1, m), np.int32)
        for i in range(n):
            rows, node = np.arange(m), np.ones(m, self.next.dtype)
            for j in range(i + 1, n + 1):
                node = self.next[node, kinds[j - 1][rows]]
                on = np.flatnonzero(node)
                if not len(on):
                    break
                if len(on) < len(node):
                    rows, node = rows[on], node[on]
                s = self.node_score[node]
                to, was = best[i][rows] + s, best[j][rows]
                better = to > was
                second[j][rows] = np.where(better, np.maximum(was, second[i][rows] + s), np.maximum(second[j][rows], to))
                won = rows[better]
                best[j][won] = to[better]
                start[j][won] = i
                piece[j][won] = self.node_id[node[better]]
        every, at, path = np.arange(m), np.full(m, n, np.int16), []
        while at.any():
            path.append(np.where(at > 0, piece[at, every], -1))
            at = np.where(at > 0, start[at, every], 0)
        ids = np.array(path[::-1]).T
        taken = ids >= 0
        flat = ids[taken].astype("<u4").tobytes()
        ends = (4 * np.cumsum(taken.sum(axis=1))).tolist()
        for chunk, a, b, top, loss in zip(group, [0, *ends], ends, best[n].tolist(), (best[n] - second[n]).tolist()):
            self.keep(chunk, (flat[a:b], top, loss, chunk))

    def keep(self, chunk: str, got: tuple) -> None:
        if len(self) >= CACHE_ENTRIES:  # what has not come up since the last time goes
            self.old = dict(self)
            self.clear()
        self[chunk] = got

    def __missing__(self, chunk: str) -> tuple[bytes, float, float, str]:
        got = self.old.get(chunk)
        if got is None:
            got = self.best(chunk)
        if len(chunk) <= 64:
            self.keep(chunk, got)
        return got

    def ending(self, chunk: str, j: int) -> Iterator[tuple[int, float, tuple[int, ...]]]:
        """The lattice's edges to place j: from where, score, ids; longest first."""
        piece = self.piece
        for k in self.lengths.get(chunk[j - 1], ()):
            if k <= j and (got := piece.get(chunk[j - k : j])) is not None:
                yield j - k, got[0], (got[1],)
        if chunk[j - 1] not in piece:
            yield j - 1, self.unknown, tuple(self.bytes[b] for b in chunk[j - 1].encode("utf-8", "replace"))

    def forward(self, chunk: str) -> list[float]:
        """Viterbi: the best score to each place."""
        best = [0.0]
        for j in range(1, len(chunk) + 1):
            best.append(max(best[i] + s for i, s, _ in self.ending(chunk, j)))
        return best

    def best(self, chunk: str) -> tuple[bytes, float, float, str]:
        """Ids of the best segmentation, its score, how much the second best loses (infinite: there is
        none), and the chunk. One Viterbi pass keeps the two best scores to each place."""
        n, trie = len(chunk), self.trie
        best, second, by = [0.0] + [_LEAST] * n, [_LEAST] * (n + 1), [None] * (n + 1)
        for i in range(n):
            here, other, j, below = best[i], second[i], i, trie
            for c in chunk[i : i + self.longest]:
                j += 1
                node = below.get(c)
                if node is None:
                    break
                below, s, k = node
                if s is not None:
                    to = here + s
                    if to > (was := best[j]):
                        s += other
                        second[j] = was if was > s else s
                        best[j] = to
                        by[j] = (i, k)
                    elif to > second[j]:
                        second[j] = to
            if chunk[i] not in self.piece:
                to, was = here + self.unknown, best[i + 1]
                if to > was:
                    second[i + 1] = max(was, other + self.unknown)
                    best[i + 1] = to
                    by[i + 1] = (i, -1)
                elif to > second[i + 1]:
                    second[i + 1] = to
        ids, j = [], n
        while j:
            i, k = by[j]
            ids.append(self.four[k] if k >= 0 else b"".join([self.four[self.bytes[b]] for b in chunk[i].encode("utf-8", "replace")]))
            j = i
        ids.reverse()
        return b"".join(ids), best[n], best[n] - second[n], chunk

    def search(self, chunk: str) -> list[tuple[float, list[tuple[int, ...]]]]:
        """The n best segmentations, best first: score, and ids (of a character's bytes together).

        Estimates are exact, so what comes off the agenda goes straight back to the start along the best edges, and the
        agenda gets only the edges that depart from there. Each entry is another segmentation with a known score, so
        as many of the best as are still wanted are all that is kept: n walks over the chunk, ties or not."""
        best = self.forward(chunk)
        agenda, out, made = [(-best[-1], 0, len(chunk), 0.0, None)], [], 0
        while agenda:
            _, _, at, after, path = agenda.pop(0)
            wanted = self.n - len(out) - 1
            del agenda[wanted:]
            while at:
                edges = list(self.ending(chunk, at))
                along = max(edges, key=lambda e: best[e[0]] + e[1])  # the first, longest one of equals, as in the forward pass
                for edge in edges if wanted else ():
                    if edge is along:
                        continue
                    i, s, ids = edge
                    made += 1
                    departs = (-(after + s + best[i]), made, i, after + s, (ids, path))
                    if len(agenda) < wanted:
                        insort(agenda, departs)
                    elif departs < agenda[-1]:
                        insort(agenda, departs)
                        agenda.pop()
                i, s, ids = along
                at, after, path = i, after + s, (ids, path)
            found = []
            while path is not None:
                found.append(path[0])
                path = path[1]
            out.append((after, found))
        return out

    def cut(self, text: str) -> list[str]:
        return self.chunks(MARK + text.replace(" ", MARK)) if text else []

    def segment(self, text: str, chunks: list[str] | None = None) -> tuple[list[bytes], float, list[float], list[tuple]]:
        """Ids of the best segmentation by chunk (little-endian 32 bits each), its score, how far below it the n best
        lie, and where each of them departs from the best: (chunk's place, ids there) of every such chunk."""
        if not text:
            return [], 0.0, [0.0], [()]
        ids, scores, losses, chunk = zip(*map(self.__getitem__, self.cut(text) if chunks is None else chunks))
        places: list[int] = []
        for x in nsmallest(self.n - 1, losses):
            if x == _MOST:
                break
            places.append(losses.index(x, places[-1] + 1 if places and losses[places[-1]] == x else 0))
        found = [self.search(chunk[i])[1:] for i in places]
        top = [scores[i] for i in places]
        agenda, lost, states, seen = [(0.0, (0,) * len(places))], [], [], set()
        while agenda and len(lost) < self.n:
            total, state = heappop(agenda)
            lost.append(total)
            states.append(state)
            for k, x in enumerate(found):
                i = state[k]
                if i < len(x):
                    after = (*state[:k], i + 1, *state[k + 1 :])
                    if after not in seen:
                        seen.add(after)
                        heappush(agenda, (total + (x[i - 1][0] if i else top[k]) - x[i][0], after))
        departs = [tuple(sorted((places[k], b"".join(self.four[j] for part in found[k][i - 1][1] for j in part)) for k, i in enumerate(state) if i)) for state in states]
        return ids, sum(scores), lost, departs

    def n_best(self, ids: tuple[bytes, ...], departs: list[tuple]) -> list[bytes]:
        """The n best segmentations' ids in full."""
        out = []
        for one in departs:
            parts = list(ids)
            for place, other in one:
                parts[place] = other
            out.append(b"".join(parts))
        return out

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_loaded: dict[tuple[str, int], Pieces] = {}


def pieces(path: str, n_best: int) -> Pieces:
    if (path, n_best) not in _loaded:
        _loaded[path, n_best] = Pieces(path, n_best)
    return _loaded[path, n_best]


def _with_chunks(p: Pieces, texts: pa.Array, chars: int = 1 << 20) -> Iterator[tuple[str, list[str]]]:
    """Texts with their chunks, about ``chars`` characters of texts at a time, whose chunks are learnt first."""
    held: list[tuple[str, list[str]]] = []
    size = 0
    for i in range(len(texts)):
        text = texts[i].as_py()
        held.append((text, p.cut(text)))
        size += len(text)
        if size >= chars or i == len(texts) - 1:
            p.learn({c for _, cut in held for c in cut})
            yield from held
            held, size = [], 0


def encode(docs: DataFrame, model: str, n_best: int = 4, with_ids: bool = False) -> DataFrame:
    """doc_id, n_chunks, n_pieces, ids_crc32, score, n_found, losses (of the n best against the best, comma-joined) and
    departures (where each of the n best departs from the best: chunk's place and checksum of its ids there), lossless
    (decoding the ids gives the text back); ids of all n best if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model, n_best)
        for b in batches:
            out: list[list] = [[] for _ in range(9)]
            for text, cut in _with_chunks(p, b.column(1)):
                parts, score, lost, departs = p.segment(text, cut)
                ids = b"".join(parts)
                told = ",".join("+".join(f"{place}:{zlib.crc32(other)}" for place, other in one) for one in departs)
                row = (len(parts), len(ids) // 4, zlib.crc32(ids), score, len(lost), ",".join(f"{x:.4f}" for x in lost), told, p.decode(ids) == text, [np.frombuffer(x, "<u4").tolist() for x in p.n_best(parts, departs)] if with_ids else None)
                for c, v in zip(out, row):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.list_(pa.int32())))
            cols = [pa.array(c, k) for c, k in zip(out, kinds)][: 8 + with_ids]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_chunks", "n_pieces", "ids_crc32", "score", "n_found", "losses", "departures", "lossless"] + ["n_best"] * with_ids)

    plain = docs.select("doc_id", text_or_empty().alias("text"))
    return plain.mapInArrow(run, f"doc_id {dict(plain.dtypes)['doc_id']}, n_chunks long, n_pieces long, ids_crc32 long, score double, n_found long, losses string, departures string, lossless boolean" + ", n_best array<array<int>>" * with_ids)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of encoded rows (doc_id, n_best): the best one's; null decodes to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model, 1)
        for b in batches:
            texts = [p.decode(np.array((ids or [[]])[0], "<u4").tobytes()) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    plain = encoded.select("doc_id", "n_best")
    return plain.mapInArrow(run, f"doc_id {dict(plain.dtypes)['doc_id']}, text string")
