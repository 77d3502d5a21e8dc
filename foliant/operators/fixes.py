"""Candidate corrections and the harness that accepts or rejects them on golden cases."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.rewrite import apply, each_match
from foliant.functions.unicode import AFTER, AR, BEFORE, TASHKEEL

# The alphabet of choices; groups of letters that differ by dots; Latin letters taken for Arabic ones.
ALPHABET = "أبجدهوزحطيكلمنسعفصقرشثتخذضظغ"
DOT_GROUPS = ["بتثني", "جحخ", "دذ", "رز", "سش", "صض", "طظ", "عغ", "فق"]
LATIN_TO_ARABIC = ("HcCSDTQklnysdrbtm", "حععصضطقكلنيسدربتم")
FORMULA = r"(?<![\p{L}\p{N}_])(?:[A-Z][a-z]?[\d₀-₉]*)+(?![\p{L}\p{N}_])"
ALWAYS = ("REG", "LANG")


def choice_lines(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\n)\s+(?=\([{ALPHABET}]\))", "\n")


def table_borders(text: Column) -> Column:
    """Lines of nothing but rule characters go."""
    keep = F.filter(F.split(text, "\n"), lambda x: ~(F.trim(x).rlike(r"^[-=|_~#*\s]{4,}$")))
    return F.array_join(keep, "\n")


def fragments(text: Column, lexicon: Column) -> Column:
    """Two pieces of 2 to 4 letters join where the lexicon has the whole and not both parts."""
    pair = rf"{BEFORE}[ء-ي]{{2,4}} [ء-ي]{{2,4}}{AFTER}"

    def join(m: Column) -> Column:
        a, b = F.split(m, " ")[0], F.split(m, " ")[1]
        has = lambda x: F.array_contains(lexicon, x)
        return F.when(has(F.concat(a, b)) & ~(has(a) & has(b)), F.concat(a, b)).otherwise(m)

    return each_match(text, pair, join)


def dot_variants(text: Column, lexicon: Column) -> Column:
    """A word of 3 to 15 letters that the lexicon lacks takes its first variant by one letter's dots."""

    def fix(m: Column) -> Column:
        tries = [
            F.when(F.substring(m, k, 1).isin(*g), F.concat(F.substring(m, 1, k - 1), F.lit(c), F.substring(m, k + 1, 20)))
            for g in DOT_GROUPS for c in g for k in range(1, 16)
        ]
        # tried against the lexicon as a set, so the least variant wins
        found = F.array_min(F.array_intersect(F.array_compact(F.array(*tries)), lexicon))
        return F.when(F.array_contains(lexicon, m), m).otherwise(F.coalesce(found, m))

    return each_match(text, rf"{BEFORE}[ء-ي]{{3,15}}{AFTER}", fix)


def merged_words(text: Column, lexicon: Column) -> Column:
    """A word of 8 letters or more splits at the first place where the lexicon has both halves."""

    def fix(m: Column) -> Column:
        n = F.length(m)
        at = F.filter(F.sequence(F.lit(3), n - 3), lambda k: F.array_contains(lexicon, m.substr(F.lit(1), k)) & F.array_contains(lexicon, m.substr(k + 1, n)))
        first = F.get(at, F.lit(0))
        return F.when(F.array_contains(lexicon, m) | first.isNull(), m).otherwise(F.concat(m.substr(F.lit(1), first), F.lit(" "), m.substr(first + 1, n)))

    return each_match(text, rf"{BEFORE}[ء-ي]{{8,}}{AFTER}", fix)


def vowel_marks(text: Column) -> Column:
    return F.regexp_replace(text, TASHKEEL, "")


def final_ha(text: Column, lexicon: Column) -> Column:
    fix = lambda m: F.when(m.endswith("ه") & (F.length(m) > 3) & F.array_contains(lexicon, F.regexp_replace(m, "ه$", "ة")), F.regexp_replace(m, "ه$", "ة")).otherwise(m)
    return each_match(text, f"[{AR}]{{3,}}", fix)


def question_marker(text: Column) -> Column:
    return apply(text, [(r"(?m)^\s*س\s*\n+\s*(\d+)", "س$1"), (r"س(\d+)(?=[^\s:\d])", "س$1: "), (r"س(\d+):(?=\S)", "س$1: ")])


def degree(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\d)(\d{{1,3}})\s*[oO]\s*C{AFTER}", "$1°C")


def latin_letters(text: Column) -> Column:
    """Latin letters inside Arabic words; formulas and plain Latin words stay."""
    fix = lambda m: F.when(m.rlike(f"[{AR}]") & m.rlike("[A-Za-z]") & ~m.rlike(FORMULA), F.translate(m, *LATIN_TO_ARABIC)).otherwise(m)
    return each_match(text, f"[{AR}A-Za-z]{{2,}}", fix)


#: Name, whether it needs the lexicon, and the classes of golden cases it is for.
FIXES: dict[str, tuple[Callable, bool, tuple[str, ...]]] = {
    "E-9": (choice_lines, False, ("E-9",)), "E-10": (table_borders, False, ("E-10",)), "E-2": (fragments, True, ("E-2",)), "E-1": (dot_variants, True, ("E-1",)),
    "E-3": (merged_words, True, ("E-3",)), "E-4": (vowel_marks, False, ("E-4",)), "E-6": (final_ha, True, ("E-6",)), "E-8": (question_marker, False, ("E-8",)),
    "E-11": (degree, False, ("E-11",)), "Q-1": (latin_letters, False, ("Q-1",)),
}


def results(golden: DataFrame, lexicon: list[str]) -> DataFrame:
    """``fix_name, test_id, passed, actual_output, expected_output, false_positive, false_negative``.

    Every fix runs on the cases of its classes and on those that must never change.
    """
    terms = F.array(*[F.lit(t) for t in sorted(lexicon)]) if lexicon else F.array().cast("array<string>")
    frames = []
    for name, (fix, needs, classes) in FIXES.items():
        actual = fix(F.col("input_text"), terms) if needs else fix(F.col("input_text"))
        own = golden.where(F.col("error_class").isin(*classes, *ALWAYS))
        frames.append(own.select(F.lit(name).alias("fix_name"), F.col("id").alias("test_id"), actual.alias("actual_output"), "input_text", "expected_output"))
    out = reduce(DataFrame.unionByName, frames)
    changed = F.col("actual_output") != F.col("input_text")
    should = F.col("input_text") != F.col("expected_output")
    return out.select(
        "fix_name", "test_id", (F.col("actual_output") == F.col("expected_output")).alias("passed"), "actual_output", "expected_output",
        (changed & ~should).alias("false_positive"), (~changed & should).alias("false_negative"),
    )


def reports(rows: DataFrame) -> DataFrame:
    """A verdict for each fix from its results."""
    out = rows.groupBy("fix_name").agg(
        F.count("*").alias("total_tests"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        F.count_if("false_positive").alias("false_positives"), F.count_if("false_negative").alias("false_negatives"),
    )
    share, fp = F.col("passed") / F.col("total_tests"), F.col("false_positives")
    verdict = F.when((share == 1) & (fp == 0), "ACCEPT").when((share >= 0.9) & (fp <= 1), "ACCEPT_WITH_CAVEATS").otherwise("REJECT")
    return out.withColumn("pass_rate", F.bround(share * 100, 2)).withColumn("verdict", verdict)


def composition(golden: DataFrame) -> DataFrame:
    return golden.groupBy("error_class").agg(F.count("*").alias("cases"))
