"""The ledger against a plain version, and policies against masks."""

import random
import re
from collections import Counter

from siltstone.llm.quality_ledger import MEASURES, POLICIES, RULES, ablations, apply_policy, keep_good, ledger


def plain(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines), "n_upper": sum(c.isupper() for c in t if c < " "), "n_shouts": t.count("!!"), "n_unspaced": len(re.findall("[\u4e00-\u9fff\u3041-\u3096\u0e01-\u0e3a]", t)), "n_bullets": sum(bool(re.match(r"[\x20\x09-\x0D]*[-*\u2022]", x)) for x in lines), "n_ellipses": sum(bool(re.search(r"(\.\.\.|\u2026)[\x20\x09-\x0D]*$", x)) for x in lines)}


def texts():
    r = random.Random(2)
    w = ["a", "bb", "Ccc", "é", "#x", "***", "DDD!!", "long" * 6, "\x0b", "|"]
    out = [None, "", " \t\n", "one", "x " * 2000, "a b c d e a b c d e f", "l\nl\nl\n\n \n", "word " * 4 + "  "]
    return out + [r.choice([" ", "\n", "  "]).join(r.choice(w) for _ in range(r.randint(0, 60))) for _ in range(200)]


def test_measurements_and_bits(spark):
    rows = [(i, t, 5) for i, t in enumerate(texts())]
    led = apply_policy(ledger(spark.createDataFrame(rows, "doc_id long, text string, n_words int")))
    for r in led.collect():
        want = plain(rows[r.doc_id][1])
        assert {m: r[m] for m in MEASURES} == want, rows[r.doc_id]
        bits = sum(1 << x.bit for x in RULES if eval(x.fails, {}, want))
        assert r.fail_bits == bits and r.base_failed == bool(bits & 3) and r.kept == (bits == 0)
        assert r.decisive_bits == (bits if bits.bit_count() == 1 else 0)


def test_ablations_and_policies(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bits = [r.fail_bits for r in ledger(df).collect()]
    for r in ablations(ledger(df)).collect():
        rule = next(x for x in RULES if x.name == r.rule)
        mask = POLICIES[r.policy_version]
        assert (r.n_docs, r.n_kept, r.n_failing, r.n_kept_without) == (len(bits), sum(not b & mask for b in bits), sum(b >> rule.bit & 1 for b in bits), sum(not b & mask & ~(1 << rule.bit) for b in bits))
    assert keep_good(df).count() == sum(b == 0 for b in bits)
    assert keep_good(df).columns == ["doc_id", "text"]
    assert ablations(ledger(df.limit(0))).where("n_docs > 0").count() == 0 and ledger(df.limit(0)).count() == 0
