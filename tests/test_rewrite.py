import pytest

from foliant.functions import rewrite
from foliant.functions.classify import line_class, page_class, warnings
from pyspark.sql import functions as F

CASES = [
    (rewrite.join_split_words, "ا لكتاب و الطالب", "الكتاب والطالب"),
    (rewrite.join_split_words, "م ص ر", "مصر"),
    (rewrite.join_split_words, "كتاب و قلم", "كتاب و قلم"),
    (rewrite.units_and_choices, "H 2 و 1 / 2 ( أ )", "H2 و ½ (أ)"),
    (rewrite.math_to_unicode, "H2O + CO2", "H₂O + CO₂"),
    (rewrite.math_to_unicode, "a <-> b", "a  ⇌  b"),
    (rewrite.math_to_unicode, "10^12", "10¹²"),
    (rewrite.math_to_unicode, "alpha و Omega", "α و Ω"),
    (rewrite.math_to_unicode, "2025/2026 و 6/3", "2025/2026 و 6 ÷ 3"),
    (rewrite.punctuation, "قيمة 1.7 تقريبا .", "قيمة 1.7 تقريبا."),
    (rewrite.punctuation, "نعم،لا", "نعم، لا"),
    (rewrite.inspect_characters, "2O5 و Fe2O3", "205 و Fe2O3"),
    (rewrite.inspect_characters, "كTاب", "كتاب"),
    (rewrite.validate_sentences, "كتاب كتاب جديد", "كتاب جديد"),
    (rewrite.restore_layout, "س1: ما", "### س1: ما"),
    (rewrite.validate_choices, "سؤال (أ) نعم (ب) لا", "سؤال\n(أ) نعم\n(ب) لا"),
    (rewrite.validate_equations, "H 2 و 3 x 5", "H₂ و 3×5"),
    (rewrite.validate_numbers, "1O5 و CO2", "105[تحقق] و CO2"),
    (rewrite.knowledge_text, " قَلم, و  كتاب! ", "قلم و كتاب"),
]


@pytest.mark.parametrize("rule,given,expected", CASES)
def test_rewrite(spark, rule, given, expected):
    assert spark.createDataFrame([(given,)], "t string").select(rule(F.col("t"))).first()[0] == expected


LINES = [
    ("", "paragraph"), ("-----", "page_break"), ("تنويه هام", "visual_note"), ("س1 ما", "question"), ("الفصل الأول", "chapter_title"),
    ("Chapter 2", "chapter_title"), ("3 - حرارة", "section_title"), ("(أ) نعم", "choice"), ("F = m × a", "equation"), ("x | y", "table_row"),
    ("plain text", "paragraph"), ("(ت) ليس اختيارا", "paragraph"),
]


def test_line_class(spark):
    got = spark.createDataFrame(LINES, "t string, e string").select("t", "e", line_class(F.col("t")).alias("g")).collect()
    assert [(r.t, r.g) for r in got] == LINES


def test_page_class_and_warnings(spark):
    d = spark.createDataFrame([("a + b", 0, 0), ("word " * 30, 0, 6), ("word " * 30, 0, 0), ("word", 0, 0)], "t string, i int, d int")
    assert [r[0] for r in d.select(page_class(F.col("t"), F.col("i"), F.col("d"))).collect()] == ["math_page", "table_page", "digital_pdf", "scanned_pdf"]
    w = spark.createDataFrame([("[تحقق] و -->",)], "t string").select(warnings(F.col("t"))).first()[0]
    assert w == ["verify:1", "broken_arrows:1"]


def test_rewrites_keep_null_and_empty(spark):
    d = spark.createDataFrame([(None,), ("",)], "t string")
    for rule in {r for r, _, _ in CASES}:
        got = [r[0] for r in d.select(rule(F.col("t"))).collect()]
        assert got == [None, ""]


def test_split_words_are_joined_to_the_right_word(spark):
    rows = ["في د ارسة له", "من مص ادر و", "مق ارنه"]
    got = [r.t for r in spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, x string").orderBy("k").select(rewrite.join_split_words(F.col("x")).alias("t")).collect()]
    assert got == ["في دراسة له", "من مصادر و", "مقارنة"]


def test_laws_and_units(spark):
    told = {
        "F=m x a": "F = m × a", "F = m*a.": "F = m × a.", "E = m c 2": "E = mc²", "E=mc^2": "E = mc²", "V = I*R": "V = I × R", "P=F/A": "P = F ÷ A", "P = V x I": "P = V × I",
        "KE = 1/2 m v 2": "KE = ½mv²", "KE=½mv²": "KE = ½mv²", "XF = m x a": "XF = m x a", "F = m x ab": "F = m x ab",
        "5 km/h": "5 كم/س", "5 m/s": "5 م/ث", "5 m/s^2": "5 م/ث²", "5m/s²": "5 م/ث²", "3 N.m": "3 ن.م", "2J/kg": "2 ج/كجم", "5 m/sec": "5 m/sec",
    }
    rows = spark.createDataFrame(list(told.items()), "a string, b string").select("a", "b", rewrite.apply(F.col("a"), rewrite.UNITS + rewrite.FORMULAE).alias("c")).collect()
    assert {r.a: r.c for r in rows} == told
