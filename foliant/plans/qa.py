"""The fourteen quality passes over whole documents, as a chain of DataFrame transformations.

Rewriting rules and rules on lines are expressions on the text of a row, so a
document never leaves its row for them.  Three passes look words up in tables:
spelling, confidence and the memory; small tables go to the texts, and for large
ones the questions are shuffled, not the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.durable import written
from foliant.functions import rewrite
from foliant.functions.classify import warnings
from foliant.functions.unicode import HIDDEN
from foliant.operators import layout, memory, metrics, wordwise
from foliant.operators.lexicon import apply_term_fixes
from foliant.operators.metrics import quality_score

COUNTERS = [
    "unicode_fixes", "broken_words_fixed", "spaces_fixed", "mcq_choices_separated", "tables_reconstructed", "equations_validated", "numbers_checked",
    "punctuation_fixed", "duplicates_removed", "low_confidence_marks",
]
SUBJECT = "general"


def first_clean(text: Column) -> Column:
    """The first cleaning of a raw text: split words mended, broken lines joined, units and choices tidied, blanks squeezed. Null counts as empty."""
    own = rewrite.apply(F.coalesce(text, F.lit("")), [(HIDDEN, ""), (r"\r\n?", "\n")])
    return rewrite.squeeze(rewrite.units_and_choices(layout.joined_paragraphs(rewrite.join_split_words(own))))


def join_sentences(text: Column) -> Column:
    """Rules of sentences with the joining of short lines between them."""
    return rewrite.apply(layout.merged_pairs(rewrite.apply(text, rewrite.SENTENCES)), rewrite.SENTENCE_ENDS)


def _changed(before: Column, after: Column) -> Column:
    return (before != after).cast("int")


def run(
    docs: DataFrame, fixes: dict[str, str] | None = None, with_layout: bool = True, lexicon: DataFrame | None = None,
    corrections: DataFrame | None = None, phrases: DataFrame | None = None,
) -> DataFrame:
    """``doc_id, text`` and statistics of ``docs`` (doc_id, text, perhaps subject) after all passes, a row for each row.

    Passes: characters, spelling, sentences, layout, choices, tables, equations,
    numbers, terms, format, repeats, verification, confidence, memory; in
    ``passes_applied`` those that ran.  Without ``lexicon`` the second and the
    thirteenth are left out, without ``fixes`` the ninth, without ``corrections``
    (the memory of an earlier epoch, with its ``phrases``) the last.  Most
    counters say whether their pass changed the document; ``duplicates_removed``
    counts lines, ``broken_words_fixed`` words too, and ``low_confidence_marks``
    the words that confidence left in doubt.  The score and the
    warnings are those of the final text.  A null text counts as empty and is
    named in ``errors``.

    The state of the documents is written before a pass that reads it more than
    once: confidence, and the others that look words up if their table is large.
    That work starts with this call.
    """
    text = F.coalesce("text", F.lit(""))
    subject = F.coalesce(F.col("subject"), F.lit(SUBJECT)) if "subject" in docs.columns else F.lit(SUBJECT)
    errors = F.array_compact(F.array(F.when(F.col("text").isNull(), "no text")))
    out = docs.select("doc_id", subject.alias("subject"), text.alias("before"), text.alias("text"), errors.alias("errors"), *[F.lit(0).alias(c) for c in COUNTERS])
    applied: list[str] = []

    def step(name: str, rule, counter: str | None, count=_changed) -> None:
        nonlocal out
        out = out.withColumn("after", rule(F.col("text")))
        if counter:
            out = out.withColumn(counter, F.col(counter) + count(F.col("text"), F.col("after")))
        out = out.drop("text").withColumnRenamed("after", "text")
        applied.append(name)

    step("characters", rewrite.inspect_characters, "unicode_fixes")
    if lexicon is not None:
        fixed = wordwise.spell_check_text(out, lexicon, count_col="_n", keep=written)
        out = fixed.withColumn("broken_words_fixed", F.col("broken_words_fixed") + (F.col("_n") > 0).cast("int")).drop("_n")
        applied.append("spelling")
    step("sentences", join_sentences, "spaces_fixed")
    if with_layout:
        step("layout", rewrite.restore_layout, None)
    step("choices", rewrite.validate_choices, "mcq_choices_separated")
    step("tables", layout.tables_in, "tables_reconstructed")
    step("equations", rewrite.validate_equations, "equations_validated")
    step("numbers", rewrite.validate_numbers, "numbers_checked")
    if fixes:
        step("terms", lambda t: apply_term_fixes(t, fixes), "broken_words_fixed")
    step("format", rewrite.cleanup_format, "punctuation_fixed")
    ends = lambda t: F.regexp_count(t, F.lit("\n"))
    step("repeats", layout.limited_runs, "duplicates_removed", lambda a, b: ends(a) - ends(b))
    out = out.withColumn("text", rewrite.apply(F.col("text"), [rewrite.SAID_TWICE]))
    applied.append("verification")
    if lexicon is not None:
        out = written(out)
        done = metrics.correct_by_confidence(out, lexicon)
        out = done.withColumn("broken_words_fixed", F.col("broken_words_fixed") + F.col("corrections_applied")).withColumn("low_confidence_marks", F.col("low_confidence_seen")).drop("corrections_applied", "low_confidence_seen")
        applied.append("confidence")
    if corrections is not None:
        done = memory.corrected(out, corrections, phrases, count_col="_n", keep=written)
        out = done.withColumn("broken_words_fixed", F.col("broken_words_fixed") + (F.col("_n") > 0).cast("int")).drop("_n")
        applied.append("memory")
    score = quality_score(*[F.col(c) for c in ("broken_words_fixed", "duplicates_removed", "low_confidence_marks", "spaces_fixed")])
    return out.select(
        "doc_id", "text", F.length("before").alias("total_chars_before"), F.length("text").alias("total_chars_after"), *COUNTERS,
        F.array(*[F.lit(x) for x in applied]).alias("passes_applied"), score.alias("quality_score"), warnings(F.col("text")).alias("warnings"), "errors",
    )


def report(stats: DataFrame) -> DataFrame:
    """``doc_id, report``: a table of the statistics as Markdown, then the warnings, errors and passes."""
    rows = [F.concat(F.lit(f"| {c} | "), F.col(c).cast("string"), F.lit(" |")) for c in ["total_chars_before", "total_chars_after", *COUNTERS, "quality_score"]]
    lists = [F.when(F.size(c) > 0, F.array_join(c, "\n")) for c in ("warnings", "errors")]
    return stats.select("doc_id", F.concat_ws("\n", F.lit("| metric | value |"), F.lit("| --- | --- |"), *rows, *lists, F.array_join("passes_applied", ", ")).alias("report"))


def write(stats: DataFrame, path: str) -> None:
    """Texts and reports as tables under ``path``."""
    stats.select("doc_id", "text").write.mode("overwrite").parquet(f"{path}/texts")
    report(stats).write.mode("overwrite").parquet(f"{path}/reports")
