"""Media columns in Ogg containers.

A clip of 8-bit samples is stored as one physical Ogg stream with two multiplexed logical streams:
the samples (packets of ``FRAME`` samples, granule position = samples finished so far) and a metadata
stream. Reading verifies every page checksum, rebuilds packets from lacing values across pages,
separates the logical streams by serial number, and derives each packet's end time from granule positions:
the page's own for the last packet that ends there, and backwards from it, by the samples of the packets
between, for those before.

Edges: a damaged page (bad capture pattern, checksum, cut-off body, missing page number) raises
``OggError``, and so do granule positions that the samples contradict; packets may be empty; streams of other
serial numbers may lie between; null or empty text is a clip of one frame of filler; equal texts give equal bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_or_empty

FRAME = 576  # samples in a packet
RATE = 8000  # samples a second
SAMPLES, META = 0x51A7, 0x3E7A  # serial numbers of the two logical streams
SEGMENTS = 250  # lacing values on a page, at most 255; packets may run over the page's end
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
NO_PACKET_ENDS = -1


class OggError(ValueError):
    pass


def page_checksum(page: bytes) -> int:
    """CRC of polynomial 0x04C11DB7, most significant bit first, no initial or final inversion. zlib's
    is its mirror image, so bytes and result are reversed bit by bit and the inversions undone."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def _logical(serial: int, packets: list[bytes], ends: list[int]) -> list[bytes]:
    """The pages of one logical stream; ends: the granule position after each packet."""
    pieces: list[tuple[bytes, int]] = []
    for k, p in enumerate(packets):
        whole = len(p) // 255
        pieces += [(p[255 * i : 255 * i + 255], NO_PACKET_ENDS) for i in range(whole)]
        pieces.append((p[255 * whole :], ends[k]))  # a value below 255, perhaps 0, ends the packet
    pages, carried = [], False
    # the first packet is the header and has a page of its own
    first = len(packets[0]) // 255 + 1
    cuts = [0, first, *range(first + SEGMENTS, len(pieces), SEGMENTS), len(pieces)]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a == b:
            continue
        here = pieces[a:b]
        granule = next((g for _, g in reversed(here) if g != NO_PACKET_ENDS), NO_PACKET_ENDS)
        flags = CONTINUED * carried | FIRST * (a == 0) | LAST * (b == len(pieces))
        pages.append(_page(serial, n, flags, granule, bytes(len(x) for x, _ in here), b"".join(x for x, _ in here)))
        carried = here[-1][1] == NO_PACKET_ENDS
    return pages


def write_clip(samples: bytes, meta: bytes) -> bytes:
    """The physical stream: both header pages first, then the streams' pages in turn."""
    frames = [samples[i : i + FRAME] for i in range(0, len(samples), FRAME)]
    sound = _logical(SAMPLES, [struct.pack("<8sII", b"PCM8    ", RATE, FRAME), *frames], [0, *(min((i + 1) * FRAME, len(samples)) for i in range(len(frames)))])
    notes = _logical(META, [b"NOTE    ", meta], [0, len(samples)])
    out = [sound[0], notes[0]]
    for i in range(1, max(len(sound), len(notes))):
        out += sound[i : i + 1] + notes[i : i + 1]
    return b"".join(out)


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # granule position of the page on which each ends
    on_page: list[int] = field(default_factory=list)  # number of that page
    pages: int = 0
    spanning: int = 0  # packets that ran over a page's end
    closed: bool = False
    parts: list[bytes] = field(default_factory=list)  # of the packet that is not ended yet


def read_streams(media: bytes) -> dict[int, Stream]:
    """The logical streams of a physical stream, by serial number."""
    streams: dict[int, Stream] = {}
    at, view = 0, memoryview(media)
    while at < len(media):
        if len(media) - at < 27:
            raise OggError(f"page head cut off at byte {at}")
        magic, version, flags, granule, serial, number, crc, count = _HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = media[at + 27 : at + 27 + count]
        body, end = at + 27 + count, at + 27 + count + sum(lacing)
        if len(lacing) < count or end > len(media):
            raise OggError(f"page body cut off at byte {at}")
        if page_checksum(b"".join((view[at : at + 22], b"\0\0\0\0", view[at + 26 : end]))) != crc:
            raise OggError(f"checksum of the page at byte {at} is wrong")
        if bool(flags & FIRST) != (serial not in streams):
            raise OggError(f"stream {serial:#x} begins wrongly at byte {at}")
        s = streams.setdefault(serial, Stream())
        if s.closed or number != s.pages or bool(flags & CONTINUED) != bool(s.parts):
            raise OggError(f"a page of stream {serial:#x} is missing before byte {at}")
        s.pages += 1
        s.spanning += bool(s.parts)
        started = 0
        for i, n in enumerate(lacing):
            started += n
            if n < 255:
                s.parts.append(media[body : body + started])
                s.packets.append(b"".join(s.parts))
                s.granules.append(granule)
                s.on_page.append(number)
                s.parts = []
                body, started = body + started, 0
        if count and lacing[-1] == 255:
            s.parts.append(media[body : body + started])
        s.closed = bool(flags & LAST)
        at = end
    for serial, s in streams.items():
        if not s.closed or s.parts:
            raise OggError(f"stream {serial:#x} has no end")
    return streams


def packet_ends(s: Stream, samples_of: Callable[[bytes], int]) -> list[int]:
    """Granule position at the end of each packet."""
    ends = list(s.granules)
    for k in range(len(ends) - 2, -1, -1):
        if s.on_page[k] == s.on_page[k + 1]:
            ends[k] = ends[k + 1] - samples_of(s.packets[k + 1])
    return ends


def read_clip(media: bytes) -> tuple[bytes, bytes, dict]:
    """Samples, metadata, and what the container says of them."""
    streams = read_streams(media)
    if not {SAMPLES, META} <= set(streams):
        raise OggError("not a clip of this kind")
    sound, notes = streams[SAMPLES], streams[META]
    if len(sound.packets[0]) != 16 or sound.packets[0][:8] != b"PCM8    " or len(sound.packets) < 2 or len(notes.packets) != 2 or notes.packets[0] != b"NOTE    ":
        raise OggError("unknown codec")
    rate, frame = struct.unpack("<II", sound.packets[0][8:])
    ends = packet_ends(sound, len)[1:]
    if ends != list(accumulate(map(len, sound.packets[1:]))):
        raise OggError("granule positions are not the numbers of samples")
    samples = b"".join(sound.packets[1:])
    return samples, notes.packets[1], {"rate": rate, "frame": frame, "packets": len(sound.packets) - 1, "pages": sound.pages + notes.pages, "spanning": sound.spanning, "micros": [g * 1_000_000 // rate for g in ends]}


def features(samples: bytes, said: dict) -> str:
    """Packets, pages, packets over page ends, length in microseconds, mean, mean square, crossings of the middle."""
    x = np.frombuffer(samples, np.uint8)
    total = int(x.sum(dtype=np.int64))
    square = int((x.astype(np.int32) ** 2).sum(dtype=np.int64))
    high = x >= 128
    crossed = int(np.count_nonzero(high[1:] != high[:-1]))
    return f"packets={said['packets']};pages={said['pages']};spanning={said['spanning']};us={said['micros'][-1]};mean={total / len(x):.4f};square={square / len(x):.4f};crossings={crossed}"


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "replace")
    return raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary): each text stored as a clip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            sizes = [len(t.encode("utf-8", "replace")) for t in texts]
            media = [write_clip(payload_of(t), str(n).encode()) for t, n in zip(texts, sizes)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    plain = docs.select("doc_id", text_or_empty().alias("text"))
    return plain.mapInArrow(run, f"doc_id {dict(plain.dtypes)['doc_id']}, n_bytes long, media binary")


def media_digest(media: DataFrame) -> DataFrame:
    """Reads stored clips (doc_id, n_bytes, media) back and digests what they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for m in b.column(2).to_pylist():
                samples, _, said = read_clip(m)
                for col, v in zip(out, (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(m), hashlib.sha256(m).hexdigest(), features(samples, said))):
                    col.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    media = media.select("doc_id", "n_bytes", "media")
    return media.mapInArrow(run, f"doc_id {dict(media.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
