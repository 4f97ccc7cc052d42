"""Personal data against the plain patterns, and planted contexts."""

import hashlib
import random
import re

from siltstone.llm.pii import BELIEVED, CLASSES, LEAST_SEEDS, SMOOTHING, _EDGES, base_spans, contexts, identifies, identifier_digest, keys, luhn, plain_words, redact, score_patterns, slots

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)


def brute(text):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[k]
            if ok:
                out.append((m.start(), KINDS.index(k), m.end()))
    return sorted(out)


def test_scanners_match_the_patterns():
    r = random.Random(4)
    for _ in range(4000):
        t = "".join(r.choice(["1", "25", "0", "9", ".", ".", "@", "a", "b.c", "-", " ", "+", "(", ")", "é", "4111111111111111", "1.2.3.4", "a@b.co"]) for _ in range(r.randint(0, 24)))
        assert base_spans(t) == brute(t), t


def test_long_runs_take_linear_time():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "a.b" * 60_000 + "@x", "+" + "1 (" * 50_000, "ab:" * 60_000):
        base_spans(t)


def rows():
    out = [(i, f"Prose here. phone: +1 (555) 555-{1000 + i} and more") for i in range(12)]
    out += [(20, "text phone: 555.0199x12 end"), (21, "other: 555.0199x12 end"), (22, "phone: soon"), (23, "mail a@b.co, card 4111 1111 1111 1111"), (24, None), (25, ""), (None, "ip 10.0.0.1"), (23, "mail a@b.co, card 4111 1111 1111 1111")]
    return out


def test_contexts_find_unseen_identifiers(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows()], "doc_id long, text string, spans string, row int")
    got = identifier_digest(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows())
    assert by[20].spans == "phone:12:23" and by[20].n_phone == 0 and by[20].n_found == 1
    assert by[21].spans == "" or by[21].n_found == 0
    assert by[22].n_found == 0 and by[23].spans == "email:5:11,card:18:37" and by[24].spans == ""
    for r in got:
        text = {a: b for a, b in rows()}[r.doc_id] or ""
        joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in brute(text))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    assert identifier_digest(df.limit(0)).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail é a@b.co or 10.0.0.1!", "en"), (2, None, "en"), (3, "plain", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.text for r in redact(df, ("doc_id", "text", "lang")).collect()}
    assert got == {1: "mail é <email> or <ip>!", 2: None, 3: "plain"}


def test_contexts_in_prose_find_unseen_identifiers(spark):
    texts = [f"Word{i} he said call me at +1 (555) 555-{1000 + i} thing{i}." for i in range(8)]
    texts += [f"so many meet at place{chr(97 + i)} here" for i in range(20)]  # 'at' alone is common, 'me at' is not
    texts += ["you call me at 555.0199x12 soon", "we meet at 555.0199x13 soon"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in identifier_digest(df).collect()}
    assert got[28].spans == "phone:15:26" and got[28].n_found == 1
    assert got[29].n_found == 0 and all(got[i].n_found == 0 and got[i].n_phone == (i < 8) for i in range(28))


def test_discovered_values_induce_patterns(spark):
    texts = [f"w{chr(97 + i)} phone: +1 (555) 555-{1000 + i} z{chr(97 + i)}" for i in range(12)]
    shared = ["030 1234 5678", "(030) 123-4567", "555.0199x12", "040 7654 321", "0171-222 33 44"]
    texts += [f"a{chr(97 + i)} phone: {v} b{chr(97 + i)}" for i, v in enumerate(shared)]
    texts += [f"c{chr(97 + i)} fax: {v} d{chr(97 + i)}" for i, v in enumerate(shared)]
    texts += ["lone fax: 089 4444 555 here", "lone nothing: 089 4444 556 here"]  # no seed stands behind 'fax:'
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in identifier_digest(df).collect()}
    for i, v in enumerate(shared):
        for at, lead in ((12 + i, "aa phone: "), (17 + i, "ca fax: ")):
            assert got[at].spans == f"phone:{len(lead)}:{len(lead) + len(v)}", (v, got[at])
    assert got[22].spans == "phone:10:22" and got[23].n_found == 0
    assert all(got[i].n_found == 0 for i in range(12))


def test_slots_take_linear_time():
    for t in ("ab:" * 60_000, "ab:1" * 60_000, "1 " * 100_000, "(1) " * 60_000, "x" * 200_000 + "1", "1" * 200_000):
        slots(t, base_spans(t))


def brute_bootstrap(texts):
    """The pattern-value graph and its turns with plain dictionaries. Returns edges and the trusted patterns."""
    edges, words = {}, {}
    for t in texts:
        for a, b, kind, bits in slots(t, base_spans(t)):
            for p in contexts(t, a, b):
                k, i, f = edges.get((p, t[a:b].lower()), (-1, 0, False))
                edges[p, t[a:b].lower()] = (max(k, -1 if kind is None else kind), i | bits, f or (kind is None and identifies(t[a:b])))
        toks = plain_words(t)
        for i, w in enumerate(toks):
            if "0" in w or "@" in w:
                continue
            lead, tail = _EDGES.fullmatch(w).groups()
            for p in keys(toks[i - 2] if i > 1 else None, toks[i - 1] if i else None, lead, tail, toks[i + 1] if i + 1 < len(toks) else None):
                words.setdefault(p, set()).add(w[len(lead) : len(w) - len(tail)] or w)
    of = {}
    for (p, v), e in edges.items():
        of.setdefault(p, {})[v] = e
    seeds = {}
    for (p, v), (k, _, _) in edges.items():
        if k >= 0:
            seeds[v] = max(seeds.get(v, -1), k)
    believed, strength = {v: (k, 100) for v, k in seeds.items()}, 0
    while True:
        trusted = {}
        for p, vs in of.items():
            held = [(believed[v], vs[v][1]) for v in vs if v in believed]
            if len(held) < LEAST_SEEDS:
                continue
            kind = max({k for (k, _), _ in held}, key=lambda k: (sum(x == k for (x, _), _ in held), -k))
            bit = 1 << CLASSES[kind]
            total, size = sum(b for (_, b), i in held if i & bit), sum(bool(i & bit) for _, i, _ in vs.values())
            if total < 100 * BELIEVED * (size + SMOOTHING) or len(words.get(p, ())) > len(vs):
                continue
            sure = total / 100 / (size + len(words.get(p, ())) + SMOOTHING)
            if sure >= BELIEVED:
                trusted[p] = (kind, sure)
        near = {}
        for p, (kind, sure) in trusted.items():
            who = p.split(" ")[2] if p[:2] == "<2" else p if p[:2] == ">1" else p.split(" ")[1]
            for v, (_, bits, fits) in of[p].items():
                if fits and bits & 1 << CLASSES[kind] and v not in seeds:
                    near[v, who] = max(near.get((v, who), (0, -9)), (sure, -kind))
        new = {}
        for (v, _), best in near.items():
            new.setdefault(v, []).append(best)
        for v, best in new.items():
            left = 1.0
            for sure, _ in best:
                left *= 1 - sure
            told = (int(round(100 - 100 * left, 4)), max(best)[1])
            was = (believed[v][1], -believed[v][0]) if v in believed else (0, -9)
            believed[v] = (-max(told, was)[1], max(told[0], was[0]))
        was, strength = strength, sum(b for _, b in believed.values())
        if not new or strength == was:
            return edges, trusted


def planted(seed, n):
    """Texts with seeds and unseen forms in contexts of their own, prose, and numbers that are no identifiers; and
    (text, start, end) of every unseen identifier behind a phrase that seeds share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    phrases = ["call me at", "my phone:", "reach us under"]
    texts, unseen = [], set()
    for i in range(n):
        head, tail = " ".join(word() for _ in range(r.randint(1, 6))), " ".join(word() for _ in range(r.randint(1, 6)))
        kind = i % 5
        if kind < 2:
            texts.append(f"{head} {r.choice(phrases)} +1 (555) {r.randint(200, 999)}-{r.randint(1000, 9999)} {tail}")
        elif kind == 2:
            value = r.choice([f"0{r.randint(100, 999)} {r.randint(1000, 9999)} {r.randint(1000, 9999)}", f"555.{r.randint(1000, 9999)}x{r.randint(10, 99)}"])
            texts.append(f"{head} {r.choice(phrases)} {value} {tail}")
            at = texts[-1].index(value)
            unseen.add((i, at, at + len(value)))
        elif kind == 3:
            texts.append(f"{head} {r.choice(['in', 'about', 'worth'])} {r.randint(1000, 9999)} {r.randint(1000, 9999)} {tail}")
        else:
            texts.append(f"{head} {tail}. {head}")
    return texts, unseen


def test_bootstrapping_equals_brute_force(spark):
    two_hop = [f"w{chr(97 + i)} phone: +1 (555) 555-{1000 + i} z{chr(97 + i)}" for i in range(12)]
    two_hop += [f"{chr(97 + i)}a {cue} {v} {chr(97 + i)}b" for cue in ("phone:", "fax:") for i, v in enumerate(["030 1234 5678", "555.0199x12", "040 7654 321", "0171-222 33 44"])]
    for texts in (planted(1, 150)[0], planted(2, 300)[0], two_hop, ["no data here", ""]):
        edges, want = brute_bootstrap(texts)
        rows = [(p, v, None if k < 0 else k, bits, fits) for (p, v), (k, bits, fits) in edges.items()]
        df = spark.createDataFrame(rows, "pattern string, value string, seed int, bits int, fits boolean")
        got = score_patterns(df, spark.createDataFrame([(t,) for t in texts], "text string")).collect()
        assert {r.pattern: r.kind for r in got} == {p: k for p, (k, _) in want.items()}
        assert all(abs(r.confidence - want[r.pattern][1]) < 1e-9 for r in got)


def test_planted_identifiers_are_found(spark):
    """Recall and precision of what only contexts find: the figures of the README."""
    texts, unseen = planted(7, 1000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = set()
    for r in identifier_digest(df).collect():
        own = {(a, b) for a, _, b in base_spans(texts[r.doc_id])}
        found |= {(r.doc_id, int(x.split(":")[1]), int(x.split(":")[2])) for x in r.spans.split(",") if x} - {(r.doc_id, a, b) for a, b in own}
    assert len(found & unseen) / len(unseen) >= 0.95 and len(found & unseen) / len(found) >= 0.95, (len(found), len(unseen), len(found & unseen))
