"""Phrases against brute force, and what counting them shuffles."""

import os
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from foliant.operators import grams, knowledge, memory
from foliant.plans import catalogue

ODD = [
    (3, "b a b a\nthe end\r\nthe end of it"), (1, "the  end, of-it\x85the end"), (1, "the end of it all"), (None, "of it all"), (None, "none only none only"), (2, None), (7, ""),
    (5, "a a " * 700), (6, "كِتاب قلم كتاب قلم"), (-4, "the end of it\x1fx_1 ² x_1 ²"), (8, "日本 語 日本 語\xa0the end"), (9, "one"),
]
ENDS = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]"


def brute(rows):
    """Phrases, and the first line of each; of lines of one place, as where an id repeats, the smallest."""
    count, first, shown = Counter(), {}, {}
    for name, text in rows:
        for no, line in enumerate(re.split(ENDS, text or "")):
            w = re.findall(r"\w+", re.sub("[ً-ْ]", "", line))
            place = (name is None, name or 0, no)
            if len(w) > 1:
                shown[place] = min(" ".join(w)[:120], shown.get(place, "\U0010ffff"))
            for n in (2, 3, 4):
                for i in range(len(w) - n + 1):
                    p = " ".join(w[i : i + n])
                    count[p] += 1
                    first[p] = min(first.get(p, place), place)
    return count, {p: None if x[0] else shown[x] for p, x in first.items()}


def written(spark, df):
    """MB shuffled by a run of ``df``."""
    sc = spark.sparkContext._jsc.sc()

    def so_far():
        sc.listenerBus().waitUntilEmpty()
        all_of = sc.statusStore().executorList(True)
        return sum(all_of.apply(k).totalShuffleWrite() for k in range(all_of.size()))

    before = so_far()
    df.write.format("noop").mode("overwrite").save()
    return (so_far() - before) / 1e6


def large(spark, path):
    """A table of invented words, and its size in MB."""
    draw = random.Random(5)
    parts = ["th", "an", "er", "on", "re", "in", "ed", "st", "ou", "ea", "ti", "or"]
    words = [draw.choices(parts, k=draw.choice([1, 2, 3])) for _ in range(30_000)]
    rows = [(k, "\n".join(" ".join("".join(w) for w in draw.choices(words, k=40)) for _ in range(8)), draw.choice(["en", "de"])) for k in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return sum(os.path.getsize(f"{path}/documents.parquet/{f}") for f in os.listdir(f"{path}/documents.parquet") if f.endswith(".parquet")) / 1e6


def test_phrases_of_odd_lines(spark, monkeypatch):
    for deal in (grams.DEALT, 3):
        monkeypatch.setattr(grams, "DEALT", deal)
        got = knowledge.phrase_counts(spark.createDataFrame(ODD, "doc_id long, text string"), 1).collect()
        count, first = brute(ODD)
        assert {r.phrase: r.frequency for r in got} == count and len(got) == len(count)
        assert {r.phrase: r.context_window for r in got} == first
        assert all(r.ngram_len == r.phrase.count(" ") + 1 for r in got)


def test_phrases_shuffle_less_than_four_times_their_table(spark, tmp_path):
    size = large(spark, tmp_path)
    assert written(spark, catalogue.queries()["kb_phrase_freq"](spark, str(tmp_path))) < 4 * size


def test_report_of_odd_lines_and_of_none(spark, tmp_path):
    count, _ = brute(ODD)
    most = max(count.values())
    got = knowledge.report(spark.createDataFrame(ODD, "doc_id long, text string")).first()
    assert (got.total_phrases, got.max_phrase_frequency, got.max_phrase) == (len(count), most, min(p for p, n in count.items() if n == most))
    none = knowledge.report(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert (none.total_phrases, none.max_phrase_frequency, none.max_phrase) == (0, None, None)
    size = large(spark, tmp_path)
    assert written(spark, catalogue.queries()["kb_report"](spark, str(tmp_path))) < 4 * size


def test_phrases_of_odd_texts_and_sources(spark, tmp_path):
    rows = [("s" if k % 3 else None, name, text) for k, (name, text) in enumerate(ODD * 2)]
    for kind, as_ in (("long", lambda x: x), ("string", lambda x: None if x is None else str(x))):
        count, sources = Counter(), defaultdict(set)
        for subject, name, text in rows:
            w = re.findall("[^ \t\n\x0b\f\r\xa0  -     　]+", text or "")
            for n in (2, 3, 4):
                for i in range(len(w) - n + 1):
                    key = (subject, " ".join(w[i : i + n]))
                    count[key] += 1
                    sources[key] |= {name} - {None}
        got = memory.phrases(spark.createDataFrame([(s, as_(x), t) for s, x, t in rows], f"subject string, doc_id {kind}, text string"), useful=lambda p: F.lit(True)).collect()
        assert {(r.subject, r.phrase): (r.frequency, r.n_sources) for r in got} == {k: (n, len(sources[k])) for k, n in count.items()} and len(got) == len(count)
        assert all(r.words == r.phrase.split(" ") for r in got)
    size = large(spark, tmp_path)
    assert written(spark, catalogue.queries()["phrase_memory"](spark, str(tmp_path))) < 4 * size
