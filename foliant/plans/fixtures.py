"""Arabic cases and papers for rules that need such text, each built around the texts of a given table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import rewrite
from foliant.schema import GOLDEN

LEXICON = ["بالإضافة", "بسيط", "قوانين", "الإشارة", "المدرسة", "منها", "القوة", "خلال", "الطاقة", "كتاب", "قلم"]
#: id, input, expected, class: written for this engine, 38 cases of 13 classes.
CASES = [
    ("b1", "رأس\n=====\nجدول", "رأس\nجدول", "E-10"), ("b2", "سطر\n-- a --\nسطر", "سطر\n-- a --\nسطر", "E-10"),
    ("d1", "عند 25oC تماما", "عند 25°C تماما", "E-11"), ("d2", "رقم 1000C", "رقم 1000C", "E-11"),
    ("f1", "قوا نين نيوتن", "قوانين نيوتن", "E-2"), ("f2", "كتاب قلم", "كتاب قلم", "E-2"),
    ("m1", "القوةخلال", "القوة خلال", "E-3"), ("m2", "بالإضافة", "بالإضافة", "E-3"),
    ("t1", "قَوَانِينُ", "قوانين", "E-4"), ("t2", "قوانين", "قوانين", "E-4"),
    ("h1", "المدرسه كبيرة", "المدرسة كبيرة", "E-6"), ("h2", "هذه", "هذه", "E-6"),
    ("q1", "س1احسب", "س1: احسب", "E-8"), ("q2", "س2: احسب", "س2: احسب", "E-8"),
    ("c1", "(أ) نعم (ه) لا", "(أ) نعم\n(ه) لا", "E-9"), ("v1", "نسيط", "بسيط", "E-1"), ("v2", "كتاب", "كتاب", "E-1"),
    ("l1", "كTاب", "كطاب", "Q-1"), ("l2", "H₂SO₄ حمض", "H₂SO₄ حمض", "Q-1"),
    ("n1", "درجة pH للماء", "درجة pH للماء", "LANG"), ("r1", "H₂ + O₂ → H₂O", "H₂ + O₂ → H₂O", "REG"), ("r2", "F = m × a", "F = m × a", "REG"),
    ("c2", "(أ) نعم\n(ب) لا", "(أ) نعم\n(ب) لا", "E-9"), ("f3", "بس يط", "بسيط", "E-2"), ("f4", "من خلال", "من خلال", "E-2"),
    ("v3", "فلم", "قلم", "E-1"), ("v4", "هواء", "هواء", "E-1"), ("m3", "الطاقةبسيط", "الطاقة بسيط", "E-3"), ("t3", "كِتَابٌ", "كتاب", "E-4"),
    ("h3", "القوه كبيرة", "القوة كبيرة", "E-6"), ("q3", "س\n3 احسب", "س3 احسب", "E-8"), ("d3", "عند 100 o C", "عند 100°C", "E-11"),
    ("e1", "1-2 كم", "1-2 كم", "E-12"), ("e2", "صفحة 1-2", "صفحة 1-2", "E-12"), ("l3", "حDور", "حضور", "Q-1"), ("n2", "وحدة Hz للتردد", "وحدة Hz للتردد", "LANG"),
    ("r3", "س5: احسب القوة", "س5: احسب القوة", "REG"), ("r4", "سرعة 20 م/ث", "سرعة 20 م/ث", "REG"),
]
#: Stage of rewriting, and texts with what it makes of them, written by hand.
REWRITES = [
    (rewrite.join_split_words, [
        ("ا لكتاب و الطالب", "الكتاب والطالب"), ("م ص ر", "مصر"), ("كتاب و قلم", "كتاب و قلم"), ("في د ارسة له", "في دراسة له"), ("مق ارنه", "مقارنة"), ("قلم • • حبر", "قلم حبر"),
    ]),
    (rewrite.units_and_choices, [("H 2 و 1 / 2 ( أ )", "H2 و ½ (أ)"), ("3 / 4 كوب", "¾ كوب"), ("11/2", "11/2")]),
    (rewrite.squeeze, [("قلم  \t كتاب\n\n\n\nنهاية  ", "قلم كتاب\n\nنهاية"), ("قلم كتاب", "قلم كتاب")]),
    (rewrite.math_to_unicode, [
        ("H2O + CO2", "H₂O + CO₂"), ("a <-> b", "a  ⇌  b"), ("10^12", "10¹²"), ("alpha و Omega", "α و Ω"), ("2025/2026 و 6/3", "2025/2026 و 6 ÷ 3"), ("F=m x a", "F = m × a"),
        ("5 km/h", "5 كم/س"), ("25 C", "25°C"), ("3*4", "3 × 4"), ("sqrt(9)", "√(9)"), ("2.5e6", "2.5×10⁶"), ("x2 + y2", "x² + y²"),
    ]),
    (rewrite.punctuation, [
        ("قيمة 1.7 تقريبا .", "قيمة 1.7 تقريبا."), ("نعم،لا", "نعم، لا"), ("ماذا؟؟؟", "ماذا؟"), ("سطر أول\nسطر ثان", "سطر أول.\nسطر ثان"), ("( قلم )", "(قلم)"), ("كتاب,قلم", "كتاب، قلم"),
    ]),
    (rewrite.split_choices, [("سؤال (أ) نعم (ب) لا", "سؤال\n(أ) نعم\n(ب) لا"), ("أ) نعم ب) لا", "أ) نعم\nب) لا"), ("(ت) ليس اختيارا", "(ت) ليس اختيارا")]),
    (rewrite.inspect_characters, [("2O5 و Fe2O3", "205 و Fe2O3"), ("كTاب", "كتاب"), ("م ص ر ي", "مصري"), ("1l5", "115"), ("قلم ،", "قلم،"), ("قل\u200bم", "قلم")]),
    (rewrite.validate_sentences, [("كتاب كتاب جديد", "كتاب جديد"), ("انتهى.ثم", "انتهى. ثم"), ("5 %", "5%"), ("لماذا ؟نعم", "لماذا؟ نعم")]),
    (rewrite.restore_layout, [
        ("س1: ما", "### س1: ما"), ("--- [ صفحة 3 ] ---", "\n\n---\n📄 صفحة 3\n---\n"), ("الفصل الأول: الحركة", "# الفصل الأول: الحركة"), ("( ب )", "(ب)"),
    ]),
    (rewrite.validate_choices, [("سؤال (أ) نعم (ب) لا", "سؤال\n(أ) نعم\n(ب) لا"), ("أ - نعم ب - لا", "(أ) نعم\n(ب) لا"), ("أ ) نعم", "(أ) نعم")]),
    (rewrite.validate_equations, [("H 2 و 3 x 5", "H₂ و 3×5"), ("25 ° C", "25°C"), ("5جم", "5 جم"), ("10 %", "10%"), ("5 – 3", "5 - 3")]),
    (rewrite.validate_numbers, [("1O5 و CO2", "105[تحقق] و CO2"), ("O2 نقي", "O2 نقي"), ("1o5", "1o5")]),
    (rewrite.cleanup_format, [("كتاب, قلم", "كتاب، قلم"), ("  سطر  \n  آخر", "سطر\nآخر"), ("كيف?نعم", "كيف؟ نعم"), ("أول;ثان", "أول؛ ثان")]),
    (rewrite.plain_from_markdown, [("# عنوان\n- نقطة", "عنوان\n• نقطة"), ("> ⚠️ تنويه", "⚠️ تنويه"), ("نص\n---\nنص", "نص\n\nنص")]),
]
PAPER = """مقدمة الامتحان

1 - ما عاصمة مصر؟
(أ) القاهرة (ب) طنطا
(ج) أسوان (د) الأقصر

2 - قرأ الطالب كتاب. ما إعراب كتاب؟
أ) فاعل ب) مفعول به ج) حال د) تمييز"""


def golden(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CASES, GOLDEN)


def papers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "exam.pdf", PAPER)], "doc_id bigint, source_filename string, raw_text string")


def one_line(text: Column) -> Column:
    """The words of a text with single spaces; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Z}]+", " "))


def golden_with(passages: DataFrame) -> DataFrame:
    """Every case below the text of each of ``passages`` (item_id, text), which no fix may change; below an empty text a case stands alone.

    (The rule for question marks takes blank lines above it away, so none is put there.)
    """
    cases = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("id", "i", "e", "k"), case, strict=True)]) for case in CASES])
    each = passages.select("item_id", one_line(F.col("text")).alias("t"), F.explode(cases).alias("c"))
    below = lambda c: F.concat_ws("\n", F.nullif("t", F.lit("")), c)
    return each.select(F.concat_ws("-", F.col("item_id").cast("string"), "c.id").alias("id"), below("c.i").alias("input_text"), below("c.e").alias("expected_output"), F.col("c.k").alias("error_class"))


def papers_of(talks: DataFrame) -> DataFrame:
    """``doc_id, source_filename, raw_text``: each conversation as an exam paper, its turns as questions, the first words of a turn as choices."""
    word = lambda t, k: F.coalesce(F.get(F.split(t, " "), F.lit(k)), F.lit(""))
    row = lambda t, k, a, b: F.concat(F.lit(f"\n({a}) "), word(t, k), F.lit(f" ({b}) "), word(t, k + 1))
    asked = lambda x: F.concat(F.lit("\n"), (x["n"] + 1).cast("string"), F.lit(" - "), x["t"], F.lit("؟"), row(x["t"], 0, "أ", "ب"), row(x["t"], 2, "ج", "د"))
    turns = talks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("n"), one_line(F.col("text")).alias("t")))).alias("q"))
    return turns.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("conv-"), F.col("conv_id")).alias("source_filename"), F.array_join(F.transform("q", asked), "\n").alias("raw_text"))


def rewritten_with(passages: DataFrame) -> DataFrame:
    """``item_id, rule, case_no, text``: each rewriting stage on its cases below the words of each passage and a stop.

    Of these words a stage may change no more than the names of Greek letters.
    A stage stands once in the plan, over the list of its cases.
    """
    each = passages.select("item_id", F.concat(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\P{L}+", " ")), F.lit(".\n")).alias("t"))
    rows = lambda rule, cases: F.transform(
        F.array(*[F.lit(given) for given, _ in cases]), lambda c, k: F.struct(F.lit(rule.__name__).alias("rule"), k.cast("long").alias("case_no"), rule(F.concat("t", c)).alias("text"))
    )
    return each.select("item_id", F.inline(F.flatten(F.array(*[rows(rule, cases) for rule, cases in REWRITES]))))
