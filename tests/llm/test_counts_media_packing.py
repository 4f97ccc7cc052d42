"""Token counts, Ogg media and packing against the libraries and by round trips."""

import base64
import hashlib
import random
import struct
import zlib

import pytest

from siltstone.llm.ogg_media import FRAME, META, SAMPLES, OggError, media_column, media_digest, page_checksum, payload_of, read_clip, read_streams, write_clip
from siltstone.llm.packing import LONG_RUN, Level, Packer, encoder, pack
from siltstone.llm.queries import vocabulary
from siltstone.llm.token_count import PairMerger, token_counts


def odd_texts():
    r = random.Random(6)
    words = ["the", "Straße", "don't", "ΣΊΣΥΦΟΣ", "İstanbul", "x" * 50, "naïve", "日本語", "😀", "12345", "...", "<|endoftext|>", "<|startoftext|>", "á", " ", "\x1c", "\u0085", "ﬁ", "'S", "it's"]
    return [None, "", " ", "\n\n", "x" * 3000, *(r.choice([" ", "", "\n", "\t "]).join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(300))]


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    texts = odd_texts()
    want = [len(e.ids) for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in token_counts(df, vocabulary("word_bpe_49k.json"), 20).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert all(got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (want[i] > 20) for i, t in enumerate(texts))
    assert token_counts(df.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_a_long_pre_token_takes_log_linear_time():
    m = PairMerger(vocabulary("word_bpe_49k.json"))
    assert m.count("ab" * 100_000) > 0


def code_points():
    return [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]


def test_every_code_point_counts_as_in_the_library():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), PairMerger(vocabulary("word_bpe_49k.json"))
    every = code_points()
    texts = [" ".join(f"a{chr(c)}1{chr(c)}.{chr(c)} {chr(c)}" for c in every[i : i + 64]) for i in range(0, len(every), 64)]
    assert [own.count(t) for t in texts] == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    marks = [f"e{chr(c)}\u0323\u0301" for c in every if c < 0x20000]
    assert [own.count(t) for t in marks] == [len(e.ids) for e in lib.encode_batch(marks, add_special_tokens=False)]


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


@pytest.mark.parametrize("n", [1, 575, 576, 577, 200 * FRAME, 60_000])
def test_media_round_trip(n):
    raw = bytes(random.Random(n).randrange(256) for _ in range(n))
    samples = raw + b"\xff" * (-n % FRAME)
    media = write_clip(samples, b"note")
    back, meta, said = read_clip(media)
    assert (back, meta) == (samples, b"note") and said["packets"] == len(samples) // FRAME
    assert said["micros"][-1] == len(samples) * 1_000_000 // 8000 and said["micros"] == sorted(said["micros"])
    assert set(read_streams(media)) == {SAMPLES, META}
    assert page_checksum(raw) == slow_checksum(raw)
    assert (said["spanning"] > 0) == (len(samples) > 84 * FRAME)


def test_damage_is_found():
    media = write_clip(payload_of("x" * 200_000), b"n")
    flipped = bytearray(media)
    flipped[len(media) // 2] ^= 1
    for bad in (bytes(flipped), media[:-5], media[200:], media[:58] + media[-400:], b""):
        with pytest.raises((OggError, KeyError)):
            read_clip(bad)


def hand_made(serial, number, flags, granule, lacing, body):
    head = b"OggS" + struct.pack("<BBqII", 0, flags, granule, serial, number)
    tail = bytes([len(lacing)]) + bytes(lacing) + body
    return head + struct.pack("<I", slow_checksum(head + bytes(4) + tail)) + tail


def hand_made_clip(last=572):
    """Several packets a page, an empty one, one of 255 bytes, one over a page's end, and a third stream between."""
    other = 77
    pages = [
        hand_made(SAMPLES, 0, 2, 0, [16], b"PCM8    " + struct.pack("<II", 8000, FRAME)),
        hand_made(META, 0, 2, 0, [8], b"NOTE    "),
        hand_made(other, 0, 2, 5, [3], b"abc"),
        hand_made(SAMPLES, 1, 0, 265, [10, 255, 0, 0], b"a" * 10 + b"b" * 255),
        hand_made(other, 1, 4, 9, [1], b"d"),
        hand_made(SAMPLES, 2, 0, -1, [255], b"c" * 255),
        hand_made(META, 1, 4, 572, [0], b""),
        hand_made(SAMPLES, 3, 5, last, [45, 7], b"c" * 45 + b"d" * 7),
    ]
    return b"".join(pages)


def test_packet_times_of_hand_made_pages():
    samples, meta, said = read_clip(hand_made_clip())
    assert samples == b"a" * 10 + b"b" * 255 + b"c" * 300 + b"d" * 7 and meta == b""
    assert said["micros"] == [125 * n for n in (10, 265, 265, 565, 572)] and (said["packets"], said["pages"], said["spanning"]) == (5, 6, 1)
    assert read_streams(hand_made_clip())[77].packets == [b"abc", b"d"]


@pytest.mark.parametrize("last", [571, 573, 0])
def test_granule_positions_must_agree_with_the_samples(last):
    with pytest.raises(OggError):
        read_clip(hand_made_clip(last))


def test_every_packet_has_its_own_time():
    samples = payload_of("x" * 100_000)
    said = read_clip(write_clip(samples, b"n"))[2]
    assert said["micros"] == [(i + 1) * FRAME * 125 for i in range(len(samples) // FRAME)]


def test_media_column(spark):
    rows = [(1, None), (2, ""), (3, "é" * 5000), (4, "é" * 5000), (None, "a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in media_digest(media_column(df)).collect()}
    for d, t in rows:
        p = payload_of(t or "")
        r = got[d]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.n_bytes) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len((t or "").encode()))
    assert got[3].media_sha256 == got[4].media_sha256 and got[3].feature == got[4].feature


SPECIAL = (("<|endoftext|>", 50256),)


def test_rank_file_gives_the_json_files_ids():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    enc = encoder(vocabulary("byte_bpe_50k.tiktoken"), SPECIAL)
    for t in odd_texts():
        assert lib.encode(t or "", add_special_tokens=False).ids == enc.ids(t or "")
    every = code_points()
    texts = ["".join(f"a{chr(c)}1{chr(c)}. {chr(c)}" for c in every[i : i + 32]) for i in range(0, len(every), 32)]
    assert [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)] == [enc.ids(t) for t in texts]


@pytest.mark.parametrize("white", [" ", "\n", "\t", "\u3000", " \n"])
def test_long_white_space_gives_the_json_files_ids(white):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    enc = encoder(vocabulary("byte_bpe_50k.tiktoken"), SPECIAL)
    for n in (LONG_RUN - 1, LONG_RUN, 2 * LONG_RUN):
        w = (white * n)[:n]
        for t in (w, "a" + w + "b", w + " c" + w + "<|endoftext|>" + w + "'s", "x " + w + "\n."):
            assert lib.encode(t, add_special_tokens=False).ids == enc.ids(t)
    assert len(enc.ids("a" + white * 2_000_000 + "b")) > 2


@pytest.mark.parametrize("sign", ["a", "1", "#", "\x1c", "\U0001F600"])
def test_long_runs_of_other_signs(sign):
    assert len(encoder(vocabulary("byte_bpe_50k.tiktoken"), SPECIAL).ids(sign * 500_000)) > 0


def test_level_choice_is_the_least_sum_of_squares():
    r = random.Random(1)
    for _ in range(300):
        lv = Level(16)
        for h in range(1, 16):
            lv.count[h] = r.choice([0, 0, 1, 2, 5])
        size = r.randint(1, 15)

        def total(h):
            n = lv.count.copy()
            if h:
                n[h] -= 1
            if h + size < 16:
                n[h + size] += 1
            return sum(int(x) ** 2 for x in n[1:16])

        allowed = [0, *(h for h in range(1, 17 - size) if lv.count[h])]
        assert total(lv.choose(size)) == min(map(total, allowed))


def test_packing_keeps_every_id_once(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(3)
    enc = encoder(vocabulary("byte_bpe_50k.tiktoken"), SPECIAL)
    rows = pack(df, vocabulary("byte_bpe_50k.tiktoken"), with_ids=True).collect()
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids))
    for i, t in enumerate(texts):
        want = enc.ids(t or "") + [0]
        parts = sorted(docs[i], key=lambda r: r.start)
        assert [x for p in parts for x in p.ids] == want and all(p.doc_tokens == len(want) for p in parts)
        assert [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
    padded = 0
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert [p.offset for p in s] == [sum(q.length for q in s[:k]) for k in range(len(s))]
        n = sum(p.length for p in s)
        assert n <= 1024
        padded += 0 if n & (n - 1) == 0 else 1024 - n
    assert padded == 0
    assert pack(df.limit(0), vocabulary("byte_bpe_50k.tiktoken")).count() == 0


def test_full_windows_leave_the_packer_at_once():
    import numpy as np

    p = Packer(8)
    out = [*p.add("a", np.arange(20)), *p.add("b", np.arange(4))]
    assert [(x[0], x[1], len(x[2]), x[5]) for x in out] == [("a", 0, 8, 0), ("a", 8, 8, 0), ("a", 16, 4, 0), ("b", 0, 4, 4)]
    assert list(p.finish()) == []


def test_the_end_of_a_stream_moves_only_what_fills_gaps():
    import numpy as np

    r = random.Random(3)
    p = Packer(64)
    sizes = [r.randint(1, 200) for _ in range(500)]
    out = [x for i, n in enumerate(sizes) for x in p.add(i, np.arange(n))]
    gaps = sum(64 - level for level in range(1, 64) for _ in p.levels.open[level])
    kept = {which: [x[:2] for x in items] for which, items in p.held.items()}
    ended = list(p.finish())
    assert p.moved <= gaps and p.moved < p.placed / 8
    seqs = {}
    for x in out + ended:
        seqs.setdefault(x[4], []).append(x)
    assert all((n := sum(len(x[2]) for x in s)) == 64 or n & (n - 1) == 0 for s in seqs.values())
    stay = [w for w in kept if w in seqs]
    assert len(stay) >= len(kept) // 2 and all([x[:2] for x in seqs[w]][: len(kept[w])] == kept[w] for w in stay)
    got = {}
    for x in out + ended:
        got.setdefault(x[0], []).append((x[1], len(x[2])))
    assert all(sorted(got[i]) == [(a, b) for a, b in sorted(got[i])] and sum(b for _, b in got[i]) == n for i, n in enumerate(sizes))


def test_vocabulary_files_agree():
    with open(vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        assert sum(1 for line in f if base64.b64decode(line.split()[0])) == 50_256
