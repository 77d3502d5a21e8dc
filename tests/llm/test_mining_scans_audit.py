"""Phrase mining, licence scans and the filter audit against brute force, and on awkward rows."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.llm import collocations, filter_audit, license_scan
from foliant.llm.queries import license_digest

NAMES = "id key n a l r f w k at first rest top bottom part mask hash maybe row bits good toxic score label place check phrase rank".split()
LONG = "lorem ipsum dolor sit amet " * 8000


def documents(spark, rows, extra=()):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({n: F.lit(1) for n in extra})


def mined(rows, least, top):
    """Every phrase counted, every cut tried."""
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", low):
            words = re.findall("[^\\x20\\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {q for p, b in cands.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if (q := p[i : i + k]) in cands and b >= cands[q]}
        scored = []
        for p, a in cands.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for rank, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    words = ["a", "B", "c", "é", "z\u00a0z", "d1", "\x1cx", "longer", "Ä", "😀"]
    for k in range(120):
        text = "".join(rng.choice(words[: rng.randint(2, 10)]) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randint(0, 60)))
        yield k, text, rng.choice(["en", "en", "de", None, ""]), "s"


@pytest.mark.parametrize("sample", [1, 8, 60])  # 60: hardly anything is proposed, so the border fails at every length
def test_collocations(spark, monkeypatch, sample):
    monkeypatch.setattr(collocations, "SAMPLE", sample)
    rows = [*texts(sample), (None, None, "en", None), (None, "a B c a B c", "fr", None), (1, "a B c a B c", "fr", None), (1, "a B c a B c", "fr", None)]
    got = collocations.collocations(documents(spark, rows, NAMES[2:]), least=4, top=50)
    assert sorted(map(tuple, got.collect())) == mined(rows, 4, 50)


def test_collocations_of_blocks(spark, monkeypatch):
    rows = list(texts(5))
    frame, shown = documents(spark, rows).repartition(3), []
    for block in (40, 1_500_000):
        monkeypatch.setattr(collocations, "BLOCK", block)
        shown.append(sorted(map(tuple, collocations.collocations(frame, least=5, top=30).collect())))
    assert shown[0] == shown[1] == mined(rows, 5, 30)


def test_collocations_of_nothing_and_long_texts(spark):
    assert collocations.collocations(documents(spark, [], NAMES[2:])).collect() == []
    got = {r.phrase: (r.a, r.l, r.r, r.n) for r in collocations.collocations(documents(spark, [(1, LONG, "en", "s")])).collect()}
    assert got["lorem ipsum dolor sit amet"] == (8000, 8000, 8000, 40000)


def test_products_beyond_64_bits(spark):
    a, n, l, r = 10**12 + 7, 10**15 + 3, 10**13 + 1, 3 * 10**12 + 1
    got = spark.sql(f"SELECT CAST(1000 AS DECIMAL(4,0)) * CAST({a} AS DECIMAL(19,0)) * CAST({n} AS DECIMAL(19,0)) div (CAST({l} AS DECIMAL(19,0)) * CAST({r} AS DECIMAL(19,0))) AS x").first()
    assert got.x == 1000 * a * n // (l * r)


def test_matching_statistics():
    rng = random.Random(3)
    templates = [(str(t), [rng.choice(b"abcd").to_bytes() for _ in range(rng.randint(2, 14))]) for t in range(6)]
    auto = license_scan.Automaton(templates)
    own = [[auto.numbers[w] for w in words] for _, words in templates]
    parts = {tuple(t[i:j]) for t in own for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(200):
        doc = [rng.randint(0, 4) for _ in range(30)]
        for k, (state, size) in enumerate(auto.stream(doc)):
            assert size == max([n for n in range(1, k + 2) if tuple(doc[k + 1 - n : k + 1]) in parts], default=0)
            if size:
                run = doc[k + 1 - size : k + 1]
                assert sorted(auto.places(state)) == sorted((t, e) for t, x in enumerate(own) for e in range(size - 1, len(x)) if x[e + 1 - size : e + 1] == run)


def phrases_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)
    found = [(i, label) for i in range(len(words)) for p, label in license_scan.PHRASES.items() if words[i : i + len(p.split())] == p.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


GRANT = dict((label, text) for label, text in license_scan.TEMPLATES[7:])


def test_license_scan(spark):
    rng = random.Random(1)
    words = "gnu general public license apache MIT cc by CC-BY é x Lizenz 4.0 the of".split()
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 300))), "en", "s") for k in range(60)]
    rows += [(100, None, "en", "s"), (101, "", None, None), (None, "MIT License", "en", "s"), (102, LONG + "mit-license", "en", "s"), (102, LONG + "mit-license", "en", "s")]
    rows += [(103, "x " + GRANT["mit"] + " y", "en", "s"), (104, GRANT["bsd"].replace("source", "Quelle"), "en", "s"), (105, " ".join(GRANT["lgpl"].split()[:8]), "en", "s"), (106, (GRANT["isc"] + " z ") * 3, "en", "s")]
    got = license_scan.scan_licenses(documents(spark, rows, [n for n in NAMES if n != "a"])).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *phrases_of(t)) for i, t, _, _ in rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels)) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[103].labels == ["mit"] and by[103].score == 1.0 and (by[103].spans[0].begin, by[103].spans[0].stop) == (1, 1 + len(license_scan.words_of(GRANT["mit"])))
    assert by[104].labels == ["bsd"] and 0.9 < by[104].score < 1
    assert by[105].labels == [] and 0 < by[105].score < 0.4
    assert [s.label for s in by[106].spans] == ["isc"] * 3 and by[106].n_base == 0
    assert license_digest(license_scan.scan_licenses(documents(spark, []))).collect() == []


def test_chains_are_the_best_ones():
    rng = random.Random(7)
    for _ in range(150):
        template = " ".join(rng.choice("abcdefgh") for _ in range(16))
        scan = license_scan.Scanner({}, [("x", template)], 2, 3, 0.5)
        doc = " ".join(w for w in template.split() if rng.random() < 0.8)
        _, anchors = scan.matches(scan.ids(doc))
        items = sorted((end, at, size) for end, size, state in anchors for _, at in scan.auto.places(state))
        best = 0

        def grow(end, at, covered, items=items):
            nonlocal best
            best = max(best, covered)
            for e, a, size in items:
                if e > end and a > at:
                    new = min(size, e - end, a - at)
                    if e - new - end <= 3 and a - new - at <= 3:
                        grow(e, a, covered + new)

        for e, a, size in items:
            grow(e, a, size)
        assert (scan.chains(anchors)[0][3] if items else 0) == best


def audited(rows, labels):
    """Every order run step by step."""
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    first = {}
    for i, text, _, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    fails = []
    for i, text, _, source in rows:
        text = text or ""
        words = re.findall("[^\\x20\\x09-\\x0D]+", text)
        bad = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text))
        fails.append((source or "", bad + "D" * bool(re.search("[#$%&*|]", text)) + "E" * (i is not None and first[text] < i), i))
    out, orders = [], ["".join(p) for p in itertools.permutations("ABCDE")]
    for part in {p for p, _, _ in fails}:
        own, removed, rest = [(b, i) for p, b, i in fails if p == part], Counter(), []
        for order in orders:
            left = own
            for step, x in enumerate(order, 1):
                gone, kept = [r for r in left if x in r[0]], [r for r in left if x not in r[0]]
                failing = [r for r in own if x in r[0]]
                removed[x] += len(gone)
                rest.append((x, (part, order, step, len(kept), len(gone), len(failing) - len(gone), sum(r[0] == x for r in own), sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone))))
                left = kept
        out += [(*r, removed[x]) for x, r in rest]
    return sorted(out)


def test_filter_audit(spark):
    rng = random.Random(2)
    base = ["", "A", "word " * 250, " ".join(map(str, range(250))), "UPPER lower #1", " ".join(f"W{k}" for k in range(230)) + " |", LONG, "x\u00a0y " * 210, "\x1c " * 205]
    rows = [(k, rng.choice(base) + rng.choice(["", "", f" {k}"]), "en", rng.choice(["s0", "s0", "s1", None, ""])) for k in range(80)]
    rows += [(None, base[2], "en", "s0"), (None, "never seen", "en", "s1"), (5, base[2], "en", "s1"), (5, base[2], "en", "s1"), (6, None, "en", "s2"), (7, base[3], "en", "s2"), (7, "other", "en", "s2")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 90, 2)] + [(2, 1, 1), (2, 1, 1), (None, 1, 1)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(documents(spark, rows, [n for n in NAMES if n != "part"]), told)
    assert sorted(map(tuple, got.collect())) == audited(rows, labels)
    assert filter_audit.audit(documents(spark, []), told).collect() == []
