"""What is learnt from books and feedback, kept by epoch and subject.

Every epoch adds its own share of each table in a folder of its own, so an epoch
that runs again replaces that and counts once, and no other folder is touched.
The memory as of an epoch is the aggregate of all shares up to it: counts add up
and sources unite, so books in any split give the same memory.  Documents of
epoch n are corrected by the memory of the epochs before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.unicode import blanks
from foliant.operators import memory
from foliant.operators.corpus import ngrams
from foliant.schema import FEEDBACK

GENERAL = "general"
#: Subjects that have a memory of their own; all others share that of GENERAL.
SUBJECTS = (*memory.SUBJECTS, GENERAL)

_SHARES = {
    "books": "book_title string, documents bigint",
    "phrases": "phrase string, source string, n bigint",
    "contexts": "word string, neighbor string, n bigint",
    "feedback": ", ".join(c for c in FEEDBACK.split(", ") if not c.startswith("subject")),
}


def known_subject(subject: Column, text: Column | None = None, subjects: tuple[str, ...] = SUBJECTS) -> Column:
    """The subject if it is a known one, that of the text if none is named, else GENERAL."""
    named = F.coalesce(subject, memory.subject_of(text)) if text is not None else subject
    return F.when(named.isin(*subjects), named).otherwise(GENERAL)


class Learning:
    """The store under ``path``: learn, correct, take feedback, report."""

    def __init__(self, spark: SparkSession, path: str, subjects: tuple[str, ...] = SUBJECTS):
        self.spark, self.path, self.subjects = spark, path.rstrip("/"), subjects

    def _add(self, table: str, share: DataFrame, epoch: int) -> None:
        # one file or few for each subject; counts are small next to the texts they come from
        share.write.mode("overwrite").partitionBy("subject").parquet(f"{self.path}/{table}/epoch={epoch}")

    def _shares(self, table: str, upto: int | None) -> DataFrame:
        schema = f"{_SHARES[table]}, epoch int, subject string"
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        return rows if upto is None else rows.where(F.col("epoch") <= upto)

    def learn(self, books: DataFrame, epoch: int, useful=memory.is_useful) -> None:
        """Add the phrases and contexts of ``books`` (subject, book_title, text) as the share of an epoch."""
        text = F.coalesce("text", F.lit(""))
        own = books.select(known_subject(F.col("subject"), text, self.subjects).alias("subject"), F.coalesce("book_title", F.lit("")).alias("source"), text.alias("text"))
        self._add("books", own.groupBy("subject", F.col("source").alias("book_title")).agg(F.count("*").alias("documents")), epoch)
        grams = F.concat(*[ngrams(F.col("w"), n) for n in (2, 3, 4)])
        each = own.select("subject", "source", blanks(F.col("text")).alias("w")).select("subject", "source", F.explode(grams).alias("phrase"))
        self._add("phrases", each.where(useful(F.col("phrase"))).groupBy("subject", "phrase", "source").agg(F.count("*").alias("n")), epoch)
        self._add("contexts", _contexts(own), epoch)

    def feedback(self, log: DataFrame, epoch: int) -> None:
        """Add a log of corrections (the columns of ``FEEDBACK``) as the share of an epoch; an event counts once."""
        self._add("feedback", log.select(known_subject(F.col("subject"), None, self.subjects).alias("subject"), *[c.split()[0] for c in _SHARES["feedback"].split(", ")]), epoch)

    def phrases(self, upto: int | None = None) -> DataFrame:
        """``subject, phrase, words, frequency, sources``; sources in order, the nameless one left out."""
        rows = self._shares("phrases", upto)
        out = rows.groupBy("subject", "phrase").agg(F.sum("n").alias("frequency"), F.array_sort(F.collect_set(F.when(F.col("source") != "", F.col("source")))).alias("sources"))
        return out.select("subject", "phrase", F.split("phrase", " ").alias("words"), "frequency", "sources")

    def contexts(self, upto: int | None = None) -> DataFrame:
        return self._shares("contexts", upto).groupBy("subject", "word", "neighbor").agg(F.sum("n").alias("n"))

    def corrections(self, upto: int | None = None, promoted: int = 3) -> DataFrame:
        """The memory of corrections, those seen ``promoted`` times promoted."""
        log = self._shares("feedback", upto).dropDuplicates(["event_id"])
        return memory.promote(memory.corrections(log), promoted)

    def books(self, upto: int | None = None) -> DataFrame:
        """``subject, book_title, documents``."""
        return self._shares("books", upto).groupBy("subject", "book_title").agg(F.sum("documents").alias("documents"))

    def correct(self, docs: DataFrame, epoch: int) -> DataFrame:
        """``docs`` (with subject, text) corrected by what the epochs before this one have left, phrases protected."""
        own = docs.withColumn("subject", known_subject(F.col("subject"), F.col("text"), self.subjects))
        done = memory.corrected(own, self.corrections(epoch - 1), self.phrases(epoch - 1))
        return done.select(*docs.columns)

    def process(self, docs: DataFrame, epoch: int) -> DataFrame:
        """The documents (doc_id, subject, book_title, text) corrected by earlier epochs; what they teach becomes this epoch's share."""
        done = self.correct(docs, epoch)
        self.learn(done, epoch)
        return done

    def stats(self, upto: int | None = None) -> DataFrame:
        return totals(self.corrections(upto), self.phrases(upto), self.contexts(upto), self.books(upto))

    def report(self, upto: int | None = None) -> DataFrame:
        return report(self.stats(upto), top_corrections(self.corrections(upto)))


def _contexts(books: DataFrame, reach: int = 3) -> DataFrame:
    """``subject, word, neighbor, n`` of words of two letters or more within ``reach`` of one another, short ones left out first."""
    w = F.filter(blanks(F.col("text")), lambda x: F.length(x) > 1)
    rows = books.select("subject", w.alias("w"))
    ahead = F.transform("w", lambda x, i: F.transform(F.slice(F.col("w"), i + 2, reach), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    pairs = rows.select("subject", F.explode(F.flatten(ahead)).alias("p")).groupBy("subject", "p.a", "p.b").agg(F.count("*").alias("n"))
    # each pair counts in both directions
    both = pairs.select("subject", F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("neighbor")), F.struct(F.col("b").alias("word"), F.col("a").alias("neighbor")))).alias("d"), "n")
    return both.groupBy("subject", "d.word", "d.neighbor").agg(F.sum("n").alias("n"))


def totals(corrections: DataFrame, phrases: DataFrame, contexts: DataFrame, books: DataFrame) -> DataFrame:
    """A row for each subject, and one for all with a null subject.

    ``subject, corrections, auto, human, promoted, high_frequency, phrases,
    context_entries, books, documents, per_book, human_pct``; the last two to one
    decimal, with one book and one correction at least.
    """
    is_ = lambda s: (F.col("source") == s).cast("long")
    one = F.lit(1).cast("long")
    names = ["corrections", "auto", "human", "promoted", "high_frequency", "phrases", "context_entries", "books", "documents"]
    parts = [
        (corrections, {"corrections": one, "auto": is_("auto"), "human": is_("human"), "promoted": is_("auto_promoted"), "high_frequency": (F.col("frequency") >= 5).cast("long")}),
        (phrases, {"phrases": one}),
        (contexts, {"context_entries": one}),
        (books, {"books": (F.col("book_title") != "").cast("long"), "documents": F.col("documents")}),
    ]
    rows = None
    for frame, counts in parts:  # each is summed by subject before they meet
        part = frame.groupBy("subject").agg(*[F.sum(counts.get(c, F.lit(0).cast("long"))).alias(c) for c in names])
        rows = part if rows is None else rows.unionByName(part)
    out = rows.rollup("subject").agg(*[F.sum(c).alias(c) for c in names])
    return out.select(
        "*", F.bround(F.col("corrections") / F.greatest("books", F.lit(1)), 1).alias("per_book"), F.bround(F.col("human") / F.greatest("corrections", F.lit(1)) * 100, 1).alias("human_pct")
    )


def top_corrections(corrections: DataFrame, k: int = 20) -> DataFrame:
    """``scope, rank, subject, original, corrected, frequency, source``: the most frequent of each subject, and of all (scope null).

    Each task keeps its first k of a subject before anything is shuffled, and
    those of all are among those of the subjects.
    """
    order = [F.desc("frequency"), F.asc("original"), F.asc("subject")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    rows = corrections.select("subject", "original", "corrected", "frequency", "source")
    each = rows.withColumn("rank", rank("subject")).where(F.col("rank") <= k)
    first = each.orderBy(*order).limit(k).drop("rank")
    all_of = first.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))  # k rows
    cols = ["rank", "subject", "original", "corrected", "frequency", "source"]
    return each.select(F.col("subject").alias("scope"), *cols).unionByName(all_of.select(F.lit(None).cast("string").alias("scope"), *cols))


def report(stats: DataFrame, top: DataFrame) -> DataFrame:
    """``report``: one text as Markdown; a line for each subject that learnt anything, the totals, the first corrections of all, progress."""
    line = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(x).cast("string") for x in c]), F.lit(" |"))
    table = ["corrections", "phrases", "auto", "human", "promoted"]
    some = (F.col("corrections") > 0) | (F.col("phrases") > 0)
    by = stats.groupBy().agg(
        F.array_sort(F.collect_list(F.when(F.col("subject").isNotNull() & some, line("subject", *table)))).alias("subjects"),
        F.max(F.when(F.col("subject").isNull(), F.struct("corrections", "phrases", "human", "promoted", "books", "per_book", "human_pct"))).alias("all"),
    )
    best = top.where("scope is null").groupBy().agg(F.array_sort(F.collect_list(F.struct("rank", line("original", "corrected", "frequency", "subject", "source").alias("t")))).alias("best"))
    named = [F.concat(F.lit(f"- {c}: "), F.coalesce(F.col(f"all.{c}").cast("string"), F.lit("0"))) for c in ("books", "corrections", "per_book", "human_pct", "promoted", "phrases")]
    text = F.concat_ws(
        "\n", F.lit("| subject | " + " | ".join(table) + " |"), F.lit("|" + " --- |" * 6), F.col("subjects"), F.lit(""),
        F.lit("| original | corrected | frequency | subject | source |"), F.lit("|" + " --- |" * 5), F.transform("best", lambda x: x["t"]), F.lit(""), *named,
    )
    one = F.lit(1).alias("k")
    return by.select("*", one).join(best.select("*", one), "k").select(text.alias("report"))  # one row each
