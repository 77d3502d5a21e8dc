"""Texts rewritten by small tables: as by large ones, and without a shuffle."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import rewrite
from foliant.operators import layout, memory, metrics, wordwise
from foliant.plans import catalogue, fixtures, qa
from tests.test_phrases import large, written

TEXTS = [
    None, "", " ", "the The THE  tHe\tand\nAND", " on the sea \n", "of the sea of the  sea of the sea shore shore", "a\xa0b the sea sea\x1fshore sea\x85shore sea  sea", "القوة teh the ee القَلَم قلم القلم قَلَم",
    "x القوة ee", "القوة ee", "ee القوة", "ee ab القوة cd ee gh ij", "teh. (teh) t-e-h 'ee' e.e aaaa الطاقة ee", "the sea shore of the sea\nshore", "undr handd undre1 12 3 e e e", "ا" * 50 + " ee " + "e" * 70,
]


@pytest.fixture
def docs(spark):
    rows = [(k, t, s, ["x"]) for s in ("a", "b", "", None) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, subject string, more array<string>")


def both(monkeypatch, run):
    small = sorted(map(str, run()))
    monkeypatch.setattr(wordwise, "SMALL", 0)
    assert small == sorted(map(str, run()))
    return small


def test_memory_by_small_and_large_tables(spark, docs, monkeypatch):
    store = [("a", "sea", "SEA", 2, "auto"), ("a", "shore", "Shore", 1, "auto"), ("a", "teh", "the", 1, "human"), ("a", "of the", "OF", 3, "auto"), ("a", "shore", "shoRE", 4, "auto"), ("b", "the", "the", 5, "auto"), ("b", "ee", None, 5, "auto"), ("", "ee", "E", 5, "auto"), (None, "ee", "x", 5, "auto")]
    known = [("a", "the sea shore", 2), ("a", "of the sea of", 1), ("a", "the sea of the", 3), ("b", "the sea", 2), ("a", "the  sea", 2), ("a", "of the", 2), ("a", "sea", 9), ("a", "a b c d e", 9)]
    corrections = spark.createDataFrame(store, "subject string, original string, corrected string, frequency long, source string")
    phrases = spark.createDataFrame(known, "subject string, phrase string, frequency long")
    for p in (phrases, None):
        with monkeypatch.context() as m:
            out = both(m, lambda p=p: memory.corrected(docs, corrections, p, count_col="n").collect())
            assert any("SEA" in x for x in out)


def test_memory_of_a_small_table_shuffles_no_texts(spark, docs):
    words = ["w%d" % k for k in range(500)]
    many = spark.createDataFrame([(k, "a", " ".join(words[(k * 7 + j * j) % 500] for j in range(300))) for k in range(400)], "doc_id long, subject string, text string")
    corrections = spark.createDataFrame([("a", w, w.upper(), 2, "auto") for w in words[::3]], "subject string, original string, corrected string, frequency long, source string")
    phrases = spark.createDataFrame([("a", "w1 w2", 2)], "subject string, phrase string, frequency long")
    assert written(spark, memory.corrected(many, corrections, phrases)) < 0.05


def test_spelling_by_small_and_large_tables(spark, docs, monkeypatch):
    lexicon = spark.createDataFrame([(t,) for t in ("the", "Sea", "sea", "SEA", "القلم", "قلم", "ee", None, "a b")], "term string")
    out = both(monkeypatch, lambda: wordwise.spell_check_text(docs, lexicon, count_col="n").collect())
    assert any("the the the  the" in x for x in out)


def test_confidence_by_small_and_large_tables(spark, docs, monkeypatch):
    lexicon = spark.createDataFrame([(t,) for t in ("the", "under", "hand", "القوة", "قلم", "aaa")], "term string")
    out = both(monkeypatch, lambda: metrics.correct_by_confidence(docs, lexicon).collect())
    assert any(metrics.VERIFY in x for x in out)


def test_issues_by_small_and_large_tables(spark, docs, monkeypatch):
    lexicon = spark.createDataFrame([(t,) for t in ("the", "sea", "القوة", None)], "term string")
    out = both(monkeypatch, lambda: metrics.issue_counts(docs, lexicon).collect())
    assert len(out) == len(TEXTS) - 3


def test_issues_shuffle_less_than_twice_their_table(spark, tmp_path):
    size = large(spark, tmp_path)  # once where its rows are dealt over the cores
    assert written(spark, catalogue.queries()["ocr_error_counts"](spark, str(tmp_path))) < 2 * size


def test_issues_of_characters_beyond_the_first_plane(spark):
    rows = [(0, "𐒀𐒁𐒂 𐒀𐒀𐒁"), (1, "x"), (None, "aab")]
    got = metrics.issue_counts(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("the",)], "term string")).collect()
    assert sorted(map(tuple, got), key=str) == [(0, 1, 2), (None, 1, 1)]


def test_passes_with_small_tables_write_texts_once(spark, docs, monkeypatch):
    calls = []
    monkeypatch.setattr(qa, "written", lambda df: calls.append(1) or df)
    store = spark.createDataFrame([("general", "sea", "SEA", 2, "auto")], "subject string, original string, corrected string, frequency long, source string")
    known = spark.createDataFrame([("general", "of the", 2)], "subject string, phrase string, frequency long")
    qa.run(docs.select("doc_id", "text"), {"Chapter": "Unit"}, True, spark.createDataFrame([("the",)], "term string"), store, known)
    assert len(calls) == 1


STEPS = [rewrite.inspect_characters, qa.join_sentences, rewrite.restore_layout, rewrite.validate_choices, rewrite.validate_equations, rewrite.validate_numbers, rewrite.cleanup_format, layout.tables_in]
RULED = [
    "1O5 a1O5 12O x1O 1l5 O2 5O", "a .b !c\t؟ d\n.e 3.5 .5 a.b", " x\u0085 y \u2028z\t\r\nq  \nr ", "\t", "a \u0085", "a\x1f \n b", "H 2 O 2 Fe  3", "3 x 5 3x5 2*4 7 % 20 ° C", "5−3 a–b", "م اء ع ل م كتابb Aكتاب", "كتاب كتاب  كتاب",
    "(أ) ب (ب) ت  (ج) ث", "أ- x ب - y", "--- [ صفحة 3 ] ---", "س3: x", "الفصل الأول: y", "a\u200bb\n\n\n\nc\n\n\nd", "3 كم 4كجم 5 م/ث", "a,ب c;د e?ه", "a | b\nc | d\n\ne\tf\tg\n1   2   3\n4   5   6\ufffe", "a\u00a0.b\u2003!", "𐒀 𐒁 .x",
]


def test_quick_tests_before_rules_skip_nothing(spark, monkeypatch):
    texts = [t for t in TEXTS if t is not None] + RULED + [t for _, cases in fixtures.REWRITES for t, _ in cases]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    run = lambda: rows.select("text", *[f(F.col("text")).alias(f"c{k}") for k, f in enumerate(STEPS)]).collect()
    quick = run()
    sentences = [r[:2] if len(r) > 2 else r for r in rewrite.SENTENCES + rewrite.SENTENCE_ENDS]
    assert any(len(r) > 2 for r in rewrite.SENTENCES)
    monkeypatch.setattr(rewrite, "SENTENCES", sentences[: len(rewrite.SENTENCES)])
    monkeypatch.setattr(rewrite, "SENTENCE_ENDS", sentences[len(sentences) - len(rewrite.SENTENCE_ENDS) :])
    for place in (rewrite, layout):
        monkeypatch.setattr(place, "only", lambda text, needs, change: change(text))
    slow = run()
    assert quick == slow and sum(r[k + 1] != r.text for r in quick for k in range(len(STEPS))) > 40
