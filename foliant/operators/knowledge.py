"""Knowledge base of words, phrases and terms: partial aggregation, then one shuffle each, of packed stretches for the phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators import grams
from foliant.operators.corpus import line_words

#: Characters of a line that are shown.
SHOWN = 120
# Parts that mark a word as a term.
TERM_PARTS = ["فيزياء", "كيمياء", "تاريخ", "جغرافيا", "رياضيات", "درجة", "معادلة"]
CATEGORY = "educational_term"


def is_title(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}[^\p{Lu}]*$")


def is_term(word: Column) -> Column:
    parts = F.lit(False)
    for p in TERM_PARTS:
        parts = parts | F.contains(word, F.lit(p))
    return (F.length(word) > 4) & (word.startswith("ال") | is_title(word) | parts)


def word_counts(docs: DataFrame, least: int = 2) -> DataFrame:
    return line_words(docs).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)


def phrase_counts(docs: DataFrame, least: int = 2) -> DataFrame:
    """``phrase, ngram_len, frequency, context_window``; the context is the first line by document and line."""
    return grams.of_lines(docs, least, SHOWN)


def term_counts(docs: DataFrame, least: int = 2) -> DataFrame:
    """Term counts come from word counts, so the heuristic runs once for each distinct word."""
    return word_counts(docs, least).where(is_term(F.col("word"))).select(F.col("word").alias("term"), F.lit(CATEGORY).alias("category"), "frequency")


def report(docs: DataFrame) -> DataFrame:
    """One row of totals before the frequency filter, with the most frequent word and phrase."""
    words, phrases = word_counts(docs, 1), grams.totals(docs)
    by_word = words.agg(
        F.count("*").alias("total_unique_words"),
        F.count_if(is_term(F.col("word"))).alias("total_subject_terms"),
        F.count_if(is_term(F.col("word")) & is_title(F.col("word"))).alias("total_named_entities"),
        F.max("frequency").alias("max_word_frequency"),
        F.min_by("word", F.struct(-F.col("frequency"), "word")).alias("max_word"),
    )
    by_phrase = phrases.agg(
        F.coalesce(F.sum("phrases"), F.lit(0)).alias("total_phrases"), F.max("most").alias("max_phrase_frequency"),
        F.min_by("phrase", F.struct(-F.col("most"), "phrase")).alias("max_phrase"),
    )
    return by_word.withColumn("k", F.lit(1)).join(by_phrase.withColumn("k", F.lit(1)), "k").drop("k")


def write(docs: DataFrame, path: str) -> None:
    """Rebuild the three tables as Parquet under ``path``."""
    for name, table in (("words", word_counts(docs)), ("phrases", phrase_counts(docs)), ("terms", term_counts(docs))):
        table.write.mode("overwrite").parquet(f"{path}/{name}")
