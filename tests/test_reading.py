"""Reading order of blocks, question order and the first cleaning against loops."""

import random
import re

from pyspark.sql import functions as F

from foliant.functions import rewrite
from foliant.operators import layout
from foliant.plans import qa
from foliant.schema import LAYOUT_BLOCKS
from foliant.sources import documents as sources


def in_order(text):
    marks = [m.start() for m in re.finditer(r"(?m)^[ \t]*\d+ *[-–](?!\d)", text)]
    if not marks:
        return text
    out = [(-1, 0, text[: marks[0]].strip())]
    for k, (a, z) in enumerate(zip(marks, [*marks[1:], len(text)])):
        b = text[a:z].strip()
        out.append((int(re.match(r"\d+", b)[0]), k, f"{int(re.match(r'[0-9]+', b)[0])} - {re.sub(r'^[0-9]+ *[-–]', '', b).strip()}"))
    return "\n\n".join(t for _, _, t in sorted(out) if t)


def test_question_order(spark):
    rng = random.Random(2)
    parts = ["2 - b", "1 - a", "10– c", "3-", "2 - again", "2025-2026 range", "prose", "", "  4 - d", "x 5 - y"]
    own = ["\n".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(200)]
    for r in spark.createDataFrame([(t,) for t in own], "t string").select("t", layout.with_questions_in_order(F.col("t")).alias("o")).collect():
        assert r.o == in_order(r.t), r.t


def test_pages_of_blocks(spark):
    rng = random.Random(4)
    rows = []
    for doc in range(12):
        for page in range(1, 4):
            for k in range(rng.randint(1, 14)):
                x0, y0 = rng.choice([10.0, 60.0, 270.0, 300.0]), float(rng.randint(0, 810))
                text = rng.choice([None, "", " \n", "النموذج أ", "one\n\ntwo", "2 - q", "1 - p", "plain", "نص"])
                rows.append((doc, page, k, x0, y0, x0 + 50, y0 + 10, text, 595.0, 842.0, doc % 2 * page % 2, doc % 8))
    got = {(r.doc_id, r.page_no): (r.n_blocks, r.text) for r in sources.digital_text(spark.createDataFrame(rows, LAYOUT_BLOCKS)).collect()}
    want = {}
    for doc, page in {r[:2] for r in rows}:
        own = [r for r in rows if r[:2] == (doc, page)]
        body = [r for r in own if not r[6] > 842 - 45 and not (r[4] < 40 and "النموذج" in (r[7] or "")) and (r[7] or "").strip()]
        body.sort(key=lambda r: (not r[3] > 595 / 2 - 30, round(r[4] / 15), r[2]))
        texts = [re.sub("\n+", " ", r[7].strip()) for r in body]
        if own[0][10] > 0 or own[0][11] > 5:
            texts.insert(0, sources.NOTICE)
        want[doc, page] = len(body), f"---\n\n--- [ صفحة {page} ] ---\n\n---\n\n" + in_order("\n\n".join(texts))
    assert got == want
    whole = {r.doc_id: r for r in sources.digital_documents(spark.createDataFrame(rows, LAYOUT_BLOCKS)).withColumn("n", sources.page_count(F.col("text"))).collect()}
    assert all(whole[d].n == whole[d].pages == 3 and whole[d].text == "\n\n".join(want[d, p][1] for p in (1, 2, 3)) for d in range(12))


def paragraphs(text):
    out, current = [], None
    for x in text.split("\n"):
        s = x.strip()
        if not s or s.startswith(("---", "📌", "#", "-", "*", "(")) or "تنويه" in s:
            out += [current] * (current is not None) + [s]
            current = None
        elif current is None:
            current = s
        elif re.search("[.؟!:؛\"»]$", current):
            out.append(current)
            current = s
        else:
            current += " " + s
    return "\n".join(out + [current] * (current is not None))


def test_first_cleaning(spark):
    rng = random.Random(8)
    parts = ["ب الكتاب", "س ط ر", "end.", "# head", "( أ ) نعم", "H 2", "1/2", "", "تنويه", "a  b\t c", "​x", "مص در", "\r", "- item", "tail"]
    own = ["\n".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(150)] + [None]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(own)], "k int, t string")
    first = rewrite.join_split_words(rewrite.apply(F.coalesce("t", F.lit("")), [("​", ""), (r"\r\n?", "\n")]))
    steps = {r.k: r for r in frame.select("k", first.alias("a"), qa.first_clean(F.col("t")).alias("z")).collect()}
    second = spark.createDataFrame([(k, paragraphs(r.a)) for k, r in steps.items()], "k int, t string")
    for r in second.select("k", rewrite.squeeze(rewrite.units_and_choices(F.col("t"))).alias("z")).collect():
        assert steps[r.k].z == r.z
