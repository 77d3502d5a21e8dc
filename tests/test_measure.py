"""Two raw documents measured page by page, against a loop."""

import random
import re

from foliant.operators import metrics
from test_catalogue import distance


def measured(read, true):
    """Totals of one document."""
    o, r = re.split(r"صفحة\s*\d+", read or ""), re.split(r"صفحة\s*\d+", true or "")
    n = min(len(o), len(r))
    chars = words = ec = ew = q = qt = c = ct = 0
    for a, b in list(zip(o, r)):
        find = lambda t: (set(re.findall(r"س\d+|(?<!\w)\d+\s*[.\-)]\s*(?:ما|اذكر|عدد|علل|فسر)", t)), set(re.findall(r"\([أبجدهوز]\)", t)))
        (qa_, ca), (qb, cb) = find(a), find(b)
        chars, words = chars + len(b), words + len(b.split())
        ec += 0 if not b else len(b) if not a else distance(a, b)
        ew += 0 if not b.split() else len(b.split()) if not a.split() else distance(a.split(), b.split())
        q, qt, c, ct = q + len(qa_ & qb), qt + max(1, len(qb)), c + len(ca & cb), ct + max(1, len(cb))
    return n, abs(len(o) - len(r)), chars, words, round(ec / max(1, chars), 4), round(ew / max(1, words), 4), q, qt, c, ct


def test_documents(spark):
    rng = random.Random(3)
    parts = ["س1 ما", "س2", "3) اذكر", "(أ)", "(ب) نعم", "é è", "نص", "a", "صفحة 1", "صفحة 12", "\n", " "]
    some = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
    pairs = [(k, some(), some()) for k in range(60)] + [(60, None, some()), (61, "", ""), (62, some(), None)]
    read = spark.createDataFrame([(k, a) for k, a, _ in pairs if k != 5], "doc_id long, text string")
    true = spark.createDataFrame([(k, b) for k, _, b in pairs if k != 6], "doc_id long, text string")
    got = {r.doc_id: r for r in metrics.measured_documents(read, true).collect()}
    assert len(got) == 63
    for k, a, b in pairs:
        r = got[k]
        if k in (5, 6):
            assert r.pages == 0 and r.cer == 0 and r.missing_pages == len(re.split(r"صفحة\s*\d+", (b if k == 5 else a)))
            continue
        want = measured(a, b)
        shown = (r.pages, r.missing_pages, r.total_chars, r.total_words, r.cer, r.wer, r.q_preserved, r.q_total, r.c_preserved, r.c_total)
        assert all(abs(x - y) < 1e-4 for x, y in zip(shown, want)), (a, b, shown, want)
        assert abs(r.car + r.cer - 1) < 1e-9 and abs(r.overall - 100 * (1 - r.cer)) < 0.06
    pages = metrics.page_counts(metrics.aligned_pages(read, true))
    assert pages.count() == sum(r.pages for r in got.values())
    text = {r.doc_id: r.report for r in metrics.quality_report(metrics.measured_documents(read, true), pages).collect()}
    assert len(text) == 63 and f"| total_chars | {got[1].total_chars} |" in text[1] and text[1].count("\n| 1 |") == 1
    split = metrics.split_pages(true).where("doc_id = 1").collect()
    assert [r.text for r in sorted(split, key=lambda r: r.page)] == re.split(r"صفحة\s*\d+", pairs[1][2])
