"""Queries without SQL against brute force on small tables."""

import inspect
import re
from collections import defaultdict

import duckdb
import pytest

from foliant.operators import lexicon
from foliant.plans import catalogue, fixtures


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_errors_of_whole_texts(spark, tmp_path):
    texts = ["no errors " * 40 + "then the thing here and there", "the first " * 5, "x" * 310 + " the", "thé ñandú the thé", "日本 the 語"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.wer for r in catalogue.queries()["wer_by_doc"](spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        read, true = t.replace("th", "t").replace("e ", " ").split(), t.split()
        assert got[k] == pytest.approx(distance(read, true) / len(true), abs=1e-4) and got[k] > 0


TEXTS = ["the thc Erin erin ab aab x 77 1234", "hand hond under\nundar THE tion t1on ttt ttttt", "zz the and"]
LIKE = lexicon.confusion_table()


def documents(spark, path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return [w for t in TEXTS for w in re.findall(r"\w+", t)]


def near(word, reach, least):
    """Terms by falling similarity."""
    if len(word) < 3:
        return []
    found = [(1 - lexicon.weighted_distance(word, t, LIKE) / max(len(word), len(t)), t) for t in catalogue.TERMS if abs(len(word) - len(t)) <= reach]
    return sorted(((s, t) for s, t in found if s >= least), key=lambda x: (-x[0], x[1]))


def test_candidates_of_all_document_words(spark, tmp_path):
    words = set(documents(spark, tmp_path))
    reach, least = (inspect.signature(lexicon.candidates).parameters[k].default for k in ("distance", "least"))
    want = {(w, t): round(s, 6) for w in words for s, t in near(w, reach, least)}
    got = catalogue.queries()["weighted_candidates"](spark, str(tmp_path)).collect()
    assert {(r.word, r.term): round(r.similarity, 6) for r in got} == want and want


def test_kinds_of_all_document_words(spark, tmp_path):
    found = defaultdict(list)
    for w in documents(spark, tmp_path):
        n, most, known = len(w), max(map(w.count, w)), [t for t in catalogue.TERMS if t.lower() == w.lower()] if len(w) > 1 else []
        sure = 1 - (0.5 if n <= 1 else 0.2 if n == 2 else 0) - 0.3 * (most > n * 0.6) - 0.3 * (most > n * 0.8) + 0.25 * (w in catalogue.TERMS)
        sure = round(max(0.05, min(1.0, sure)), 4) if re.search("[A-Za-z]", w) else 0.3
        close, far = near(w, 1, 0.7), [x for x in near(w, 2, 0.3) if x[0] >= 0.5]
        if n < 2:
            kind, sure = "low", 0.5
        elif sure >= 0.9:
            kind = "exact"
        elif known:
            kind, sure = ("lexicon", 0.95) if w in known else ("dictionary", 0.9)
        elif sure >= 0.7 and close:
            kind, sure = "confusion", close[0][0]
        else:
            kind, sure = "low_confidence", far[0][0] if far else sure
        found[kind].append(sure)
    got = {r.kind: (r.n, r.avg_confidence) for r in catalogue.queries()["confidence_by_kind"](spark, str(tmp_path)).collect()}
    assert got == {k: (len(v), pytest.approx(sum(v) / len(v), abs=1e-4)) for k, v in found.items()}


def test_character_errors_count_code_points(spark, tmp_path):
    texts = ["thé thé", "", None, "日本 the 語", "ß" * 40 + "the "]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in catalogue.queries()["cer_by_doc"](spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        true = t or ""
        read = true.replace("th", "t").replace("e ", " ")
        assert (got[k].chars_ocr, got[k].chars_ref) == (len(read), len(true))
        assert got[k].cer == pytest.approx(distance(read, true) / max(1, len(true)), abs=1e-4)


def test_rewriting_stages_below_any_passage(spark, tmp_path):
    passages = {0: "one  two 3 pi", 1: "", 2: None}
    spark.createDataFrame(list(passages.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.item_id, r.rule, r.case_no): r.text for r in catalogue.queries()["rewrite_stages"](spark, str(tmp_path)).collect()}
    above = {0: "one two pi.\n", 1: ".\n", 2: ".\n"}
    want = {
        (i, rule.__name__, k): (above[i].replace("pi", "π") if rule.__name__ == "math_to_unicode" else above[i]) + made
        for i in passages for rule, cases in fixtures.REWRITES for k, (_, made) in enumerate(cases)
    }
    assert got == want


def test_reviews_and_questions_of_null_texts(spark, tmp_path):
    spark.createDataFrame([(0, None), (41, "a\nb\nc"), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    told = {r.doc_id: r.warnings for r in catalogue.queries()["review_warnings"](spark, str(tmp_path)).collect()}
    assert told == {0: "", 41: "unclear:2,verify:1,broken_arrows:1,long_word:41", 2: "unclear:2,broken_arrows:2"}
    asked = catalogue.queries()["questions_ordered"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.q_ord, r.q_num, r.text) for r in asked) == [(0, 1, 0, "0 -"), (2, 1, 0, "0 -"), (41, 1, 0, "0 - b"), (41, 2, 0, "0 - c"), (41, 3, 1, "1 - a")]


def test_reviews_of_texts_that_end_in_a_long_word(spark, tmp_path):
    rows = [(k, f"{'a b' * k}\ntoken = {'0' * 42}{end}") for k, end in zip(range(90), ["", "\n", "\n\n", "-", "--"] * 18, strict=True)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    told = {r.doc_id: r.warnings for r in catalogue.queries()["review_warnings"](spark, str(tmp_path)).collect()}
    read = duckdb.connect()
    read.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert told == dict(read.sql(catalogue.oracle_sql()["review_warnings"]).fetchall()) and told[9] == "verify:1,broken_arrows:1"
