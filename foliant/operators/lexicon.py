"""Dictionary lookups: term fixes, lexicon probes, fuzzy candidates, ensemble votes."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.rewrite import each_match
from foliant.functions.unicode import AR, TASHKEEL

#: The article, which a word may have before a term.
ARTICLE = "ال"
# Letters that recognition takes for one another, by tier of likeness.
HIGH, MEDIUM, LATIN, SAME = 0.85, 0.55, 0.65, 1.0
HIGH_PAIRS = {
    "ب": "تثني", "ت": "بثني", "ث": "بتني", "ن": "بتثي", "ي": "بتثن", "ج": "حخ", "ح": "جخ", "خ": "جح", "س": "ش", "ش": "س", "ص": "ض", "ض": "ص",
    "ط": "ظ", "ظ": "ط", "ع": "غ", "غ": "ع", "ف": "قو", "ق": "ف", "و": "في", "د": "ذ", "ذ": "د", "ر": "ز", "ز": "ر", "ا": "أإآى", "أ": "اإآ",
    "إ": "اأآ", "آ": "اأإ", "ى": "اي", "ه": "ةح", "ة": "هت", "ل": "ك", "ك": "لم", "م": "ك",
}
MEDIUM_PAIRS = {"ل": "دن", "ا": "لع", "س": "صق", "م": "نو", "ع": "اد", "ق": "فود", "ط": "صف", "و": "ين", "د": "ور"}
LATIN_PAIRS = {
    "A": "اأد", "B": "ب8", "C": "جح0", "D": "د0", "E": "يع", "F": "فق", "G": "قج", "H": "هح8", "I": "ال1", "J": "جح", "K": "كل", "L": "لا1", "M": "م",
    "N": "نم", "O": "و0", "P": "بف", "Q": "قف", "R": "ر", "S": "سص5", "T": "طت", "U": "ون", "V": "فو", "W": "ون", "X": "خ", "Y": "يو", "Z": "ز2",
    "0": "واO", "1": "لاIl", "2": "زZ", "5": "سS", "8": "بBهH",
}


def confusion_table() -> dict[tuple[str, str], float]:
    """Likeness of each unordered pair of letters; the higher tier of the order high, medium, Latin wins."""
    out: dict[tuple[str, str], float] = {}
    for pairs, score in ((HIGH_PAIRS, HIGH), (MEDIUM_PAIRS, MEDIUM), (LATIN_PAIRS, LATIN)):
        for a, others in pairs.items():
            for b in others:
                out.setdefault((a, b), score)
                out.setdefault((b, a), score)
    return out


def confusion_score(a: Column, b: Column) -> Column:
    table = F.create_map(*[F.lit(x) for (p, q), s in sorted(confusion_table().items()) for x in (p + q, s)])
    return F.when(a == b, SAME).otherwise(F.coalesce(table[F.concat(a, b)], F.lit(0.0)))


def weighted_distance(a: str, b: str, likeness: dict[tuple[str, str], float]) -> float:
    """Edit distance where letters that look alike cost 0.3 and a gap 0.8 (1 along the borders)."""
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], float(i)
        for j, y in enumerate(b, 1):
            cost = 0.0 if x == y else 0.3 if likeness.get((x, y), 0.0) > 0.5 else 1.0
            diagonal, row[j] = row[j], min(row[j] + 0.8, row[j - 1] + 0.8, diagonal + cost)
    return row[-1]


def candidate_pairs(found: DataFrame, lexicon: DataFrame, distance: int = 2) -> DataFrame:
    """``word, term, apart, similarity`` of distinct words of three letters or more and the terms whose length is at most ``distance`` apart.

    Words meet terms of near length by an equality join on the length band, so
    each word sees its band of the lexicon and no other part.
    """
    words = found.select("word").distinct().where(F.length("word") >= 3)
    band = F.explode(F.sequence(F.length("word") - distance, F.length("word") + distance)).alias("len")
    terms = lexicon.select("term").distinct().withColumn("len", F.length("term"))
    likeness = confusion_table()

    @F.pandas_udf("double")
    def distances(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([weighted_distance(x, y, likeness) for x, y in zip(a, b, strict=True)], dtype=float)

    pairs = words.select("word", band).join(terms, "len").withColumn("distance", distances("word", "term"))
    similarity = 1 - F.col("distance") / F.greatest(F.length("word"), F.length("term"))
    return pairs.select("word", "term", F.abs(F.length("word") - F.col("len")).alias("apart"), similarity.alias("similarity"))


def candidates(found: DataFrame, lexicon: DataFrame, distance: int = 2, least: float = 0.3, top: int = 10) -> DataFrame:
    """``word, term, similarity, rank``: lexicon terms most like each distinct word of ``found`` (word)."""
    pairs = candidate_pairs(found, lexicon, distance).where(F.col("similarity") >= least)
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("similarity"), "term"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= top).select("word", "term", "similarity", "rank")


def plain_candidates(found: DataFrame, lexicon: DataFrame, distance: int = 1, least: float = 0.7, top: int = 10) -> DataFrame:
    """As :func:`candidates` with the plain edit distance, which stays in the JVM and stops early."""
    words = found.select("word").distinct().where(F.length("word") >= 3)
    band = F.explode(F.sequence(F.length("word") - distance, F.length("word") + distance)).alias("len")
    terms = lexicon.select("term").distinct().withColumn("len", F.length("term"))
    pairs = words.select("word", band).join(terms, "len").withColumn("distance", F.levenshtein("word", "term", distance)).where("distance >= 0")
    pairs = pairs.withColumn("similarity", 1 - F.col("distance") / F.greatest(F.length("word"), F.length("term"))).where(F.col("similarity") >= least)
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("similarity"), "term"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= top).select("word", "term", "similarity", "rank")


def spell_check(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``word, found, term, step`` for distinct words: as they stand, without vowel marks, without the article, in any case."""
    own = words.select("word").distinct().where(F.length("word") >= 2)
    bare = F.regexp_replace("word", TASHKEEL, "")
    keys = F.array(
        F.struct(F.lit(1).alias("step"), F.col("word").alias("key")), F.struct(F.lit(2).alias("step"), bare.alias("key")),
        F.struct(F.lit(3).alias("step"), F.when(bare.startswith(ARTICLE) & (F.length(bare) > 3), F.substring(bare, 3, 1 << 20)).alias("key")),
        F.struct(F.lit(4).alias("step"), F.when(F.col("word").rlike("^[A-Za-z]+$"), F.lower("word")).alias("key")),
    )
    probes = own.select("word", F.explode(keys).alias("k")).select("word", "k.step", "k.key").where("key is not null")
    terms = lexicon.select("term").distinct()
    exact = terms.select(F.col("term").alias("key"), "term", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("step"))
    lower = terms.where(F.col("term").rlike("^[A-Za-z]+$")).groupBy(F.lower("term").alias("key")).agg(F.min("term").alias("term")).withColumn("step", F.lit(4))
    hits = probes.join(exact.unionByName(lower), ["key", "step"]).groupBy("word").agg(F.min_by("term", "step").alias("term"), F.min("step").alias("step"))
    return own.join(hits, "word", "left").select("word", F.col("term").isNotNull().alias("found"), "term", "step")


def apply_term_fixes(text: Column, fixes: dict[str, str]) -> Column:
    """Replace terms: phrases first, longest first, each seeing earlier results; then whole words.

    A dictionary of known size becomes a literal map, so the rewrite needs no shuffle.
    """
    phrases = sorted((w for w in fixes if " " in w), key=lambda w: (-len(w), w))
    out = reduce(lambda t, w: F.replace(t, F.lit(w), F.lit(fixes[w])), phrases, text)
    single = {k: v for k, v in fixes.items() if " " not in k and k != v}
    if not single:
        return out
    table = F.create_map(*[F.lit(x) for kv in sorted(single.items()) for x in kv])
    return each_match(out, f"[{AR}]{{2,}}", lambda m: F.coalesce(table[m], m))


def lexicon_stats(lexicon: DataFrame, custom: DataFrame) -> DataFrame:
    """Terms by subject, and custom ones that the base lacks."""
    base = lexicon.groupBy("subject").agg(F.countDistinct("term").alias("terms"))
    extra = custom.select("term").distinct().join(lexicon.select("term"), "term", "left_anti").agg(F.count("*").alias("terms"))
    return base.unionByName(extra.select(F.lit("custom").alias("subject"), "terms"))


def add_custom(lexicon: DataFrame, custom: DataFrame, new: DataFrame) -> DataFrame:
    """``term``: custom terms with the new ones, trimmed, without those of the lexicon."""
    terms = custom.select("term").union(new.select(F.trim("term"))).where("term <> ''").distinct()
    return terms.join(lexicon.select("term"), "term", "left_anti")


def vote(variants: DataFrame) -> DataFrame:
    """``doc_id, text``: at each token position the reading of most variants; the earliest variant wins a tie."""
    tokens = variants.select("doc_id", "variant", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("pos", "token"))
    counted = tokens.groupBy("doc_id", "pos", "token").agg(F.count("*").alias("n"), F.min("variant").alias("first"))
    best = counted.groupBy("doc_id", "pos").agg(F.max_by("token", F.struct("n", -F.col("first"))).alias("token"))
    return best.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("text")
    )
