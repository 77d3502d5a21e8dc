"""The learning store: any split of the books, epochs that run again, reports."""

import datetime as dt
import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.operators import learning, memory
from foliant.schema import FEEDBACK

T = dt.datetime(2024, 1, 1)
BOOKS = [
    ("physics", "p1", "القوة تساوي الكتلة في التسارع\nالقوة تساوي الكتلة"), ("physics", "p2", "القوة تساوي الكتلة دائما"), ("physics", "p1", "القوة تساوي"),
    ("chess", "c1", "فتح الملك على الرقعة فتح الملك"), (None, "h", "تاريخ حضارة قديم حضارة"), (None, "", None), ("physics", "p1", "القوة تساوي"),
]
LOG = [
    (1, T, "physics", "p1", 1, "الفوة", "القوة", "auto"), (2, T, "physics", "p1", 2, "الفوة", "القوة", "auto"), (3, T, "chess", "c1", 1, "المك", "الملك", "human"),
    (4, T, "physics", "p2", 1, "تساوي", "لا", "human"), (5, T, "physics", "p1", 3, "الفوة", "القوة", "auto"), (6, T, "physics", "p1", 3, "xx", "xx", "auto"),
]


def books(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, subject string, book_title string, text string")


def shown(store, upto=None):
    frames = store.phrases(upto), store.contexts(upto), store.corrections(upto), store.books(upto), store.stats(upto), store.report(upto)
    return [sorted(map(str, map(tuple, f.collect()))) for f in frames]


def test_any_split_gives_the_same_memory(spark, tmp_path):
    one, many = learning.Learning(spark, f"file://{tmp_path}/one"), learning.Learning(spark, f"file://{tmp_path}/many")
    one.learn(books(spark, BOOKS), 1)
    one.feedback(spark.createDataFrame(LOG, FEEDBACK), 1)
    for n, (some, log) in enumerate([(BOOKS[:2], LOG[:1]), (BOOKS[2:3], LOG[1:4]), (BOOKS[3:], LOG[3:])], 1):
        many.learn(books(spark, some), n)
        many.feedback(spark.createDataFrame(log, FEEDBACK), n)
        many.learn(books(spark, some), n)  # an epoch that runs again
    assert shown(one) == shown(many)


def test_contents(spark, tmp_path):
    store = learning.Learning(spark, f"file://{tmp_path}/s")
    assert store.phrases().collect() == [] and store.stats().count() <= 1
    store.learn(books(spark, BOOKS), 1)
    want, where, near = Counter(), defaultdict(set), Counter()
    subject = {"physics": "physics", "chess": "general"}
    for s, title, text in BOOKS:
        s = subject.get(s) or ("history" if text else "general")
        w = (text or "").split()
        for k in (2, 3, 4):
            for i in range(len(w) - k + 1):
                p = " ".join(w[i : i + k])
                stop = w[i] in memory.STOP_START and k <= 2
                if not stop and len(p) >= 6 and sum("؀" <= c <= "ۿ" for c in p) >= 4:
                    want[s, p] += 1
                    where[s, p].add(title)
        w = [x for x in w if len(x) > 1]
        for i, x in enumerate(w):
            near.update((s, x, y) for y in w[max(0, i - 3) : i] + w[i + 1 : i + 4])
    assert {(r.subject, r.phrase): (r.frequency, set(r.sources)) for r in store.phrases().collect()} == {k: (n, where[k]) for k, n in want.items()}
    assert {(r.subject, r.word, r.neighbor): r.n for r in store.contexts().collect()} == dict(near)


def test_an_epoch_is_corrected_by_those_before(spark, tmp_path):
    store = learning.Learning(spark, f"file://{tmp_path}/s")
    store.feedback(spark.createDataFrame(LOG, FEEDBACK), 1)
    first = books(spark, [("physics", "p1", "الفوة تساوي الكتلة\nالفوة تساوي الكتلة")])
    assert [r.text for r in store.process(first, 1).collect()] == ["الفوة تساوي الكتلة\nالفوة تساوي الكتلة"]
    before = shown(store, 1)
    second = books(spark, [("physics", "p1", "الفوة  تساوي الكتلة\nتساوي"), (None, "x", None)])
    for _ in range(2):
        # a phrase of epoch 1 that stands in the text is left as it is, "تساوي الكتلة" too
        assert [r.text for r in sorted(store.process(second, 2).collect(), key=lambda r: r.doc_id)] == ["القوة  تساوي الكتلة\nلا", None]
        assert shown(store, 1) == before
    kept = {d: os.stat(f"{tmp_path}/s/phrases/{d}").st_mtime for d in os.listdir(f"{tmp_path}/s/phrases") if d == "epoch=1"}
    store.process(second, 2).count()
    assert kept == {d: os.stat(f"{tmp_path}/s/phrases/{d}").st_mtime for d in kept}


def test_stats_and_top(spark):
    rows = [(f"s{k % 3}", f"w{k:02}", "x", k % 7 + 1, ["auto", "human", "auto_promoted"][k % 3 if k % 5 else 0]) for k in range(60)]
    store = spark.createDataFrame(rows, "subject string, original string, corrected string, frequency long, source string")
    got = learning.top_corrections(store, 4).collect()
    order = sorted(rows, key=lambda r: (-r[3], r[1], r[0]))
    for scope in ("s0", "s1", "s2", None):
        want = [r[1] for r in order if scope is None or r[0] == scope][:4]
        assert [r.original for r in sorted(got, key=lambda r: r.rank) if r.scope == scope] == want
    none = spark.createDataFrame([], "subject string, phrase string, word string, book_title string, documents long")
    stats = {r.subject: r for r in learning.totals(store, none, none, none).collect()}
    assert stats[None].corrections == 60 and sum(stats[s].human for s in ("s0", "s1", "s2")) == stats[None].human == sum(r[4] == "human" for r in rows)
    assert stats["s0"].per_book == 20.0 and stats["s1"].high_frequency == sum(r[0] == "s1" and r[3] >= 5 for r in rows)
    text = learning.report(learning.totals(store, none, none, none), learning.top_corrections(store, 4)).first().report
    assert f"| {order[0][1]} | x | 7 |" in text and text.count("\n") > 10
    assert "- corrections: 60" in text


@pytest.mark.parametrize("named, want", [("physics", "physics"), ("chess", "general"), (None, "general")])
def test_subjects(spark, named, want):
    d = spark.createDataFrame([(named, "nothing")], "s string, t string")
    assert d.select(learning.known_subject(F.col("s"), F.col("t"))).first()[0] == want
