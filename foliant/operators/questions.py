"""Multiple-choice questions from raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.unicode import strip

LETTERS = "أبجد"
# Texts that fill empty fields of a question.
NO_WARNING, SECTION = "لا يوجد", "الامتحان الرئيسي"
CHOICE = "الخيار ({})"
FIELDS = [
    "q_num", "source_filename", "warning", "section_name", "reference_text", "question_text", "choice_a", "choice_b", "choice_c", "choice_d",
]


def parse(papers: DataFrame) -> DataFrame:
    """``doc_id, q_ord`` and the fields of each question of ``papers`` (doc_id, source_filename, raw_text).

    A block starts with a question heading or a numbered line.  The correct
    choice and its explanation are not in the text and stay null.
    """
    blocks = papers.select("doc_id", "source_filename", F.posexplode(F.split("raw_text", r"\n(?=##?\s*السؤال|\n?\d+\s*[-–])")).alias("pos", "block"))
    blocks = blocks.withColumn("block", strip(F.col("block"))).where("block <> ''")
    blocks = blocks.withColumn("q_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    number = F.regexp_extract("block", r"(?:السؤال\s*|^)(\d+)\s*[-–:)]?", 1)
    # a letter counts as a mark only where it stands alone
    mark = rf"(?<![\p{{L}}\p{{N}}_])[(（]?[{LETTERS}][)）.\-–]\s*"
    parts, marks = F.split("block", mark), F.regexp_extract_all("block", F.lit(rf"(?<![\p{{L}}\p{{N}}_])[(（]?([{LETTERS}])[)）.\-–]\s*"), F.lit(1))
    body = strip(F.regexp_replace(F.get(parts, F.lit(0)), r"^(?:##?\s*السؤال\s*\d*\s*[-–:)]?|\d+\s*[-–])", ""))

    def choice(letter: str) -> Column:
        at = F.array_max(F.filter(F.transform(marks, lambda m, i: F.when(m == letter, i + 1)), lambda x: x.isNotNull()))
        text = strip(F.get(parts, at))
        return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(CHOICE.format(letter))

    q = F.coalesce(F.when(number != "", number.try_cast("int")), F.col("q_ord"))
    out = blocks.select(
        "doc_id", "q_ord", q.alias("q_num"), "source_filename", F.lit(NO_WARNING).alias("warning"), F.lit(SECTION).alias("section_name"),
        body.alias("reference_text"), body.alias("question_text"), *[choice(x).alias(f"choice_{y}") for x, y in zip(LETTERS, "abcd", strict=True)],
        F.lit(None).cast("string").alias("correct_choice"), F.lit(None).cast("string").alias("explanation"),
    )
    return out.where(is_complete(FIELDS))


def is_complete(fields: list[str]) -> Column:
    """All fields set and none blank."""
    return F.forall(F.array(*[F.col(c).cast("string") for c in fields]), lambda x: F.coalesce(F.length(F.trim(x)) > 0, F.lit(False)))


def render(questions: DataFrame) -> DataFrame:
    """``doc_id, q_ord, block``: a question as text, a field on each line."""
    named = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in [*FIELDS, "correct_choice", "explanation"]]
    return questions.select("doc_id", "q_ord", F.concat_ws("\n", *named).alias("block"))
