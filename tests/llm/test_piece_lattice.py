"""N-best segmentation against enumeration; decoding against the library."""

import random

import numpy as np
import pytest

from siltstone.llm.piece_lattice import MARK, Pieces, decode, encode, pieces
from siltstone.llm.queries import vocabulary

MODEL = vocabulary("piece_bpe_32k.model")


def enumerate_all(p, chunk):
    """Every segmentation: score and ids."""
    if not chunk:
        return [(0.0, ())]
    out = []
    for j in range(1, len(chunk) + 1):
        got = p.piece.get(chunk[:j])
        head = (got[0], (got[1],)) if got else (p.unknown, tuple(p.bytes[b] for b in chunk[0].encode())) if j == 1 else None
        if head is not None:
            out += [(head[0] + x, head[1] + ids) for x, ids in enumerate_all(p, chunk[j:])]
    return sorted(out, reverse=True)


@pytest.fixture(scope="module")
def alone():
    return Pieces(MODEL, 6)


@pytest.mark.parametrize("learnt", [False, True])
@pytest.mark.parametrize("text", ["the cat", "Straße in\nÖl", "a  b", "日x͸", "\n\n ", "tokenisation", "the the"])
def test_n_best_equals_enumeration(alone, text, learnt):
    p = pieces(MODEL, 6) if learnt else alone
    whole = MARK + text.replace(" ", MARK)
    if learnt:
        p.learn(set(p.cut(text)))
    every = enumerate_all(p, whole)
    scores = dict((ids, s) for s, ids in every)
    ids, score, lost, departs = p.segment(text)
    assert score == pytest.approx(every[0][0]) and np.allclose([score - x for x in lost], [s for s, _ in every[:6]])
    full = [tuple(np.frombuffer(x, "<u4").tolist()) for x in p.n_best(ids, departs)]
    assert len(set(full)) == len(full) == min(6, len(every)) and np.allclose([scores[x] for x in full], [score - x for x in lost])
    for chunk in p.chunks(whole):
        assert np.allclose([s for s, _ in p.search(chunk)], [s for s, _ in enumerate_all(p, chunk)[:6]])


def test_chunks_learnt_together_equal_the_search():
    r = random.Random(11)
    p = Pieces(MODEL, 4)
    signs = "abcdefghilmnorstuéßñABC.,'-" + MARK
    chunks = {"".join(r.choice(signs) for _ in range(r.randint(1, 24))) for _ in range(3000)} | {"the", MARK + "the", "internationalization", "zzzzzz"}
    p.learn(chunks)
    assert len(p) > 2500
    for c in chunks:
        ids, top, loss, _ = p[c]
        one = p.best(c)
        found = p.search(c)
        assert top == pytest.approx(found[0][0]) and one[1] == pytest.approx(top)
        assert (loss == one[2] == float("inf")) if len(found) < 2 else (loss == pytest.approx(found[0][0] - found[1][0]) == pytest.approx(one[2]))
        told = tuple(np.frombuffer(ids, "<u4").tolist())
        same = [tuple(k for part in x for k in part) for s, x in found if s == pytest.approx(top)]
        assert told in same


@pytest.mark.parametrize("chunk", ["aaaaaaaaaa", MARK * 9, "----------", "1111111111", "ababababab", "\u6f22" * 8])
def test_tied_lattices_equal_enumeration(chunk):
    p = Pieces(MODEL, 12)
    every = enumerate_all(p, chunk)
    scores = dict((ids, s) for s, ids in every)
    found = p.search(chunk)
    told = [tuple(k for part in x for k in part) for _, x in found]
    assert len(set(told)) == len(told) == min(12, len(every))
    assert np.allclose([s for s, _ in found], [s for s, _ in every[:12]]) and np.allclose([scores[x] for x in told], [s for s, _ in found])


@pytest.mark.parametrize("sign", ["a", " ", "-", "1", "\u6f22"])
def test_runs_of_one_sign_end(sign):
    """A million of one sign: n walks over it, however many segmentations tie."""
    p = pieces(MODEL, 4)
    text = sign * 1_000_000
    ids, score, lost, departs = p.segment(text)
    assert lost[0] == 0 and lost == sorted(lost) and 1 <= len(lost) <= 4 and p.decode(b"".join(ids)) == text


def test_round_trip_and_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(3)
    texts = ["", None, " ", "a\tb", "é́ x", "emoji 😀!", "x" * 5000, "  two  spaces ", *("".join(r.choice("abc éß\n1") for _ in range(200)) for _ in range(20))]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    enc = encode(df, MODEL, with_ids=True)
    got = {x.doc_id: x for x in enc.collect()}
    assert all(got[i].lossless for i in range(len(texts)))
    assert all(lib.decode(x) == (t or "") for i, t in enumerate(texts) for x in got[i].n_best) and all(len(got[i].n_best) == got[i].n_found for i in got)
    assert encode(df.union(df), MODEL).count() == 2 * len(texts)
    assert {x.doc_id: x.text for x in decode(enc, MODEL).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert all(lib.decode(lib.encode(t)) == pieces(MODEL, 1).decode(np.array(lib.encode(t), "<u4").tobytes()) for t in texts if t)
    assert encode(df.limit(0), MODEL).count() == 0
