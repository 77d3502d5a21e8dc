"""Correction memory: a deterministic aggregate of an append-only log of feedback."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.unicode import AR, SPACE, blanks
from foliant.operators import grams, wordwise
from foliant.operators.corpus import ngrams, tokens

# First words of phrases too common to learn; subjects and their key words.
STOP_START = ["في", "من", "إلى", "عن", "على", "مع", "كان", "هذا", "هذه", "ذلك", "تلك"]
SUBJECTS = {
    "physics": "قوة طاقة سرعة تسارع كتلة ضغط شغل تيار جهد مقاومة", "chemistry": "تفاعل عنصر مركب حمض قاعدة أكسدة رابطة ذرة جزيء محلول",
    "biology": "خلية نواة غشاء جين إنزيم هرمون جهاز عضلة عصب دم", "mathematics": "معادلة دالة مشتقة تكامل مصفوفة متجه احتمال هندسة مثلث لوغاريتم",
    "history": "تاريخ حضارة دولة إمبراطورية حرب ثورة عصر قديم حديث معاصر", "geography": "خريطة مناخ تضاريس سكان نهر جبل بحر محافظة عاصمة حدود",
    "arabic": "نحو صرف بلاغة أدب شعر نثر قصة فعل اسم حرف", "english": "grammar vocabulary reading writing noun verb tense paragraph",
    "statistics": "احتمال متوسط تباين انحراف توزيع بيانات عينة مخطط",
}


def subject_of(text: Column, subjects: dict[str, str] = SUBJECTS) -> Column:
    """The subject most of whose key words occur in the text; the first of equals; ``general`` if none does."""
    low = F.lower(F.coalesce(text, F.lit("")))
    scores = [
        F.struct(sum((F.contains(low, F.lit(w)).cast("int") for w in words.split()), F.lit(0)).alias("n"), F.lit(-k).alias("order"), F.lit(name).alias("subject"))
        for k, (name, words) in enumerate(subjects.items())
    ]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["subject"]).otherwise("general")


def is_useful(phrase: Column) -> Column:
    first, n = F.split(phrase, " ")[0], F.size(F.split(phrase, " "))
    return ~(first.isin(STOP_START) & (n <= 2)) & (F.regexp_count(phrase, F.lit(f"[{AR}]")) >= 4) & (F.length(phrase) >= 6)


def phrases(books: DataFrame, useful=is_useful, id_col: str = "doc_id", least: int = 1) -> DataFrame:
    """``subject, phrase, words, frequency, n_sources`` of 2- to 4-word phrases across lines that occur ``least`` times."""
    counted = grams.of_texts(books, F.col("subject"), F.col(id_col), F.col("text"), least)
    return counted.where(useful(F.col("phrase"))).withColumn("words", F.split("phrase", " "))


def context_pairs(docs: DataFrame, reach: int = 3) -> DataFrame:
    """``word, neighbor, n``: how often two words of two letters or more stand within ``reach`` places.

    Neighbours come from array offsets inside a document, so no self join and
    no window is needed.  Each pair of places counts once, under the smaller word,
    and is partly aggregated before the shuffle; both directions follow from it.
    """
    w = docs.select(blanks(F.coalesce("text", F.lit(""))).alias("w"))
    ahead = F.transform("w", lambda x, i: F.transform(F.slice(F.col("w"), i + 2, reach), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))))
    rows = w.select(F.explode(F.flatten(ahead)).alias("p")).select("p.a", "p.b").where("length(a) > 1 and length(b) > 1")
    pairs = rows.groupBy("a", "b").agg(F.count("*").alias("n"))
    side = lambda x, y, n: F.struct(F.col(x).alias("word"), F.col(y).alias("neighbor"), n.alias("n"))
    both = F.when(F.col("a") == F.col("b"), F.array(side("a", "b", F.col("n") * 2))).otherwise(F.array(side("a", "b", F.col("n")), side("b", "a", F.col("n"))))
    return pairs.select(F.explode(both).alias("d")).select("d.*")


def top_neighbours(pairs: DataFrame, k: int = 5) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), "neighbor"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def corrections(log: DataFrame) -> DataFrame:
    """The memory that a log of corrections amounts to, one row for each (subject, original).

    Equal or one-letter entries do not count.  A human's value wins over any
    other, then the latest event.
    """
    human = (F.col("source") == "human").cast("int")
    rows = log.where((F.col("original") != F.col("edited")) & (F.length(F.trim("original")) >= 2))
    latest = F.struct(human.alias("h"), F.col("ts"), F.col("event_id"))
    return rows.groupBy("subject", "original").agg(
        F.max_by("edited", latest).alias("corrected"), F.count("*").alias("frequency"),
        F.when(F.max(human) == 1, "human").otherwise(F.max_by("source", latest)).alias("source"),
        F.when(F.max(human) == 1, 1.0).otherwise(0.8).alias("confidence"),
        F.array_sort(F.collect_set("page")).alias("pages"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )


def merge(memory: DataFrame, fresh: DataFrame) -> DataFrame:
    """Two memories as one: frequencies add up, pages unite, a human's value wins, then the later one."""
    both = memory.unionByName(fresh)
    human = (F.col("source") == "human").cast("int")
    latest = F.struct(human.alias("h"), F.col("last_seen"), F.col("corrected"))
    return both.groupBy("subject", "original").agg(
        F.max_by("corrected", latest).alias("corrected"), F.sum("frequency").alias("frequency"), F.max_by("source", latest).alias("source"),
        F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )


def trusted(memory: DataFrame) -> DataFrame:
    return memory.where("frequency >= 2 or source = 'human'")


def promote(memory: DataFrame, least: int = 3) -> DataFrame:
    """Corrections seen often enough become ``auto_promoted`` unless a human made them."""
    up = (F.col("source") != "human") & (F.col("frequency") >= least)
    return memory.withColumn("source", F.when(up, "auto_promoted").otherwise(F.col("source")))


def memory_stats(memory: DataFrame) -> DataFrame:
    return memory.groupBy("subject").agg(
        F.count("*").alias("corrections"), F.count_if(F.col("source") == "human").alias("human"), F.count_if(F.col("source") == "auto_promoted").alias("promoted"),
        F.count_if(F.col("frequency") >= 5).alias("high_frequency"), F.sum("frequency").alias("events"),
    )


def human_edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """``doc_id, pos, original, edited``: words that differ at the same place of both texts, up to the shorter."""
    a = before.select("doc_id", blanks("text").alias("a"))
    b = after.select("doc_id", blanks("text").alias("b"))
    n = F.least(F.size("a"), F.size("b"))
    zipped = F.arrays_zip(F.slice("a", F.lit(1), n).alias("original"), F.slice("b", F.lit(1), n).alias("edited"))
    rows = a.join(b, "doc_id").select("doc_id", F.posexplode(zipped).alias("pos", "z"))
    return rows.select("doc_id", "pos", "z.original", "z.edited").where("original <> edited")


def correct(docs: DataFrame, memory: DataFrame, known: DataFrame | None = None, least: int = 2) -> DataFrame:
    """``doc_id, text`` of ``docs`` (doc_id, subject, text) as :func:`corrected` leaves them."""
    return corrected(docs.select("doc_id", "subject", "text"), memory, known, least).select("doc_id", "text")


def _corrector(table: list[tuple[str, str | None]], phrases: bool) -> Callable:
    """:func:`corrected` of a text and its subject by a table of terms, which begin with their subject; no answer protects."""
    by_subject: dict[str, tuple[dict, dict]] = {}
    for term, answer in table:
        for at in re.finditer("\n", term):
            word = term[at.end() :]
            answers, sizes = by_subject.setdefault(term[: at.start()], ({}, {}))
            # of equal terms one without an answer counts, else the smallest
            answers[word] = answer if word not in answers else None if None in (answer, answers[word]) else min(answer, answers[word])
            parts = wordwise.words_of(word)
            n = len(parts) // 2 + 1
            if n == 1 or (phrases and n <= 4):
                sizes.setdefault(parts[0], set()).add(n)
    longest = {s: {w: sorted(n, reverse=True) for w, n in sizes.items()} for s, (_, sizes) in by_subject.items()}

    def change(text: str, subject: str | None) -> tuple[str, int]:
        if subject not in by_subject:
            return text, 0
        answers, sizes = by_subject[subject][0], longest[subject]
        parts = wordwise.words_of(text)
        last = len(parts) if parts[-1] else len(parts) - 2
        end = count = 0
        for i, w in enumerate(parts[::2]):
            if w in sizes and w and 2 * i >= end:
                for n in sizes[w]:
                    to = 2 * (i + n) - 1
                    term = w if n == 1 else "".join(parts[2 * i : to])
                    if to <= last and term in answers:
                        end = to
                        if answers[term] is not None:
                            parts[2 * i] = answers[term]
                            count += 1
                        break
        return ("".join(parts) if count else text), count

    return change


def corrected(docs: DataFrame, memory: DataFrame, known: DataFrame | None = None, least: int = 2, count_col: str | None = None, keep: Callable | None = None) -> DataFrame:
    """``docs`` with trusted corrections applied word by word, white space as it was; ``count_col`` gets their number.

    Words of a phrase in ``known`` (subject, phrase, frequency) that occurs
    ``least`` times in its subject are protected: of the phrases in a text the
    leftmost count, the longest of those that begin at the same word, none in
    another.  White space inside a phrase is one blank.  A null text stays null,
    and a row without a subject has no corrections.  The memory is that of an
    earlier epoch, so a document never corrects itself.  ``keep`` is applied to
    documents that are read more than once.
    """
    pieces = wordwise.blank_pieces(F.col("text"))
    named = lambda term: F.concat_ws("\n", F.col("subject"), term)
    word = lambda p: F.when(F.col("subject").isNotNull() & ~p.rlike(f"^{SPACE}"), named(p))
    table = trusted(memory).select(named(F.col("original")).alias("term"), F.col("corrected").alias("answer")).where("term is not null and answer is not null")
    questions = wordwise.at_words(pieces, word)
    if known is not None:
        # n words are 2 n - 1 pieces, and the blanks between them single
        def phrases_of(p: Column) -> Column:
            each = lambda n: F.transform(p, lambda x, i: F.when(~x.rlike(f"^{SPACE}"), F.struct(i.alias("pos"), F.lit(2 * n - 1).alias("n"), named(F.array_join(F.slice(p, i + 1, 2 * n - 1), "")).alias("term"))))
            return F.filter(F.concat(*[each(n) for n in (2, 3, 4)]), lambda q: q.isNotNull() & (q["pos"] + q["n"] <= F.size(p)) & F.col("subject").isNotNull())

        questions = F.concat(questions, wordwise.bound(pieces, phrases_of))
        safe = known.where((F.col("frequency") >= least) & F.contains("phrase", F.lit(" ")))
        table = table.unionByName(safe.select(named(F.col("phrase")).alias("term"), F.lit(None).cast("string").alias("answer")).distinct())
    if (rows := wordwise.held(table)) is not None:
        terms, protects, n = [tuple(r) for r in rows], known is not None, count_col or f"_{uuid.uuid4().hex}"
        return wordwise.rewritten(docs, lambda: _corrector(terms, protects), [n], also=("subject",)).select(*docs.columns, *([n] if count_col else []))
    done = wordwise.answered(keep(docs) if keep else docs, questions, table, ["subject", "text"], "_answers")
    done = done.withColumn("_answers", F.filter(wordwise.without_overlaps(F.col("_answers")), lambda a: a["answer"].isNotNull()))
    text = wordwise.put_back(F.col("text"), pieces, F.col("_answers"), lambda _, a: a["answer"])
    count = [F.coalesce(F.size("_answers"), F.lit(0)).alias(count_col)] if count_col else []
    return done.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], *count)


def match_phrases(docs: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """``doc_id, phrase, frequency``: known phrases in each document, by n-gram equality."""
    t = tokens(docs).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("w"))
    grams = t.select("doc_id", F.explode(F.array_distinct(F.concat(*[ngrams(F.col("w"), n) for n in (2, 3, 4)]))).alias("phrase"))
    return grams.join(known.where(F.col("frequency") >= least).select("phrase", "frequency"), "phrase").select("doc_id", "phrase", "frequency")
