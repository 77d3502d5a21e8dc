"""Readers: text folders, recognised words, layout blocks, saved memories and lexicons.

Recognition itself needs an external engine, so scans enter as tables of words
or blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.unicode import AR, strip
from foliant.operators.layout import with_questions_in_order
from foliant.schema import CORRECTIONS, LEXICON


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """``file, text`` of the .txt files of a folder; bytes that are no UTF-8 are replaced."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return raw.select(F.col("path").alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def library_stats(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder and their bytes, without reading them."""
    return spark.read.format("binaryFile").load(path).select("length").agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """A saved memory; a record that breaks the schema is an error, never an empty memory."""
    return spark.read.schema(CORRECTIONS).option("mode", "FAILFAST").json(path)


def lexicon(spark: SparkSession, path: str, custom: str | None = None) -> DataFrame:
    """``term, subject`` from CSV, with custom terms from another file."""
    base = spark.read.schema(LEXICON).option("mode", "FAILFAST").csv(path, header=True)
    return (base.unionByName(spark.read.schema(LEXICON).csv(custom, header=True)) if custom else base).distinct()


def is_digital(pages: DataFrame, per_page: int = 100) -> DataFrame:
    """``doc_id, digital``: whether the pages hold more than ``per_page`` characters of text on average."""
    return pages.groupBy("doc_id").agg((F.sum(F.length(strip(F.coalesce("text", F.lit(""))))) > per_page * F.count("*")).alias("digital"))


def scanned_pages(words: DataFrame, doubt: int = 30, shown: int = 6) -> DataFrame:
    """``doc_id, page_no, text, doubtful`` from recognised words: lines by block, paragraph and line."""
    own = words.where((F.trim("text") != "") & (F.col("conf") >= 0))
    line = own.groupBy("doc_id", "page_no", "block_num", "par_num", "line_num").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda x: x["text"]), " ").alias("line"),
        F.collect_set(F.when((F.col("conf") > 0) & (F.col("conf") < doubt) & (F.length("text") >= 3) & (F.regexp_count("text", F.lit(f"[{AR}]")) >= 3), F.col("text"))).alias("bad"),
    )
    return line.groupBy("doc_id", "page_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_num", "par_num", "line_num", "line"))), lambda x: x["line"]), "\n").alias("text"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("bad")))), 1, shown).alias("doubtful"),
    )


def digital_pages(blocks: DataFrame) -> DataFrame:
    """``doc_id, page_no, text`` from layout blocks: right column first, rows of 15 points, no header or footer."""
    footer = F.col("y1") > F.col("page_h") - 45
    header = (F.col("y0") < 40) & F.contains("text", F.lit("النموذج"))
    own = blocks.where(~footer & ~header)
    column = F.when(F.col("x0") > F.col("page_w") / 2 - 30, 0).otherwise(1)
    item = F.struct(column.alias("c"), F.bround(F.col("y0") / 15).alias("r"), "block_idx", strip(F.regexp_replace("text", r"\s*\n\s*", " ")).alias("t"))
    page = own.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(item)).alias("b"), ((F.max("n_images") > 0) | (F.max("n_drawings") > 5)).alias("visual"))
    text = F.array_join(F.transform("b", lambda x: x["t"]), "\n")
    return page.select("doc_id", "page_no", text.alias("text"), "visual")


# What stands for pictures on a page, and how a page is announced.
NOTICE = "⚠️ [تنويه: يحتوي هذا الجزء/السؤال على شكل رسم بياني أو خريطة أو صورة توضيحية 🖼️]"
PAGE_HEAD = "---\n\n--- [ صفحة %d ] ---\n\n---\n\n"


def digital_text(blocks: DataFrame, margin: float = 45, top: float = 40, row: float = 15, overlap: float = 30) -> DataFrame:
    """``doc_id, page_no, n_blocks, text``: each page of layout blocks in reading order, under its page mark.

    Blocks that end within ``margin`` of the foot go, and those that begin above
    ``top`` and name a model paper.  The right column is read first: what begins
    right of the middle less ``overlap``.  Within a column blocks go by rows of
    ``row`` points, then as they came.  Line ends inside a block become blanks.
    A page with pictures or more than five drawings begins with a notice, and
    numbered questions are put in order.  A page whose blocks all go keeps its mark.
    """
    text = strip(F.regexp_replace(strip(F.coalesce("text", F.lit(""))), r"\n+", " "))
    gone = (F.col("y1") > F.col("page_h") - margin) | ((F.col("y0") < top) & F.contains(F.coalesce("text", F.lit("")), F.lit("النموذج"))) | (text == "")
    column = F.when(F.col("x0") > F.col("page_w") / 2 - overlap, 0).otherwise(1)
    item = F.struct(column.alias("c"), F.bround(F.col("y0") / row).alias("r"), "block_idx", text.alias("t"))
    page = blocks.groupBy("doc_id", "page_no").agg(
        F.array_sort(F.collect_list(F.when(~F.coalesce(gone, F.lit(False)), item))).alias("b"), (F.coalesce(F.max("n_images"), F.lit(0)) > 0).alias("i"), (F.coalesce(F.max("n_drawings"), F.lit(0)) > 5).alias("d")
    )
    shown = F.concat(F.when(F.col("i") | F.col("d"), F.array(F.lit(NOTICE))).otherwise(F.array().cast("array<string>")), F.transform("b", lambda x: x["t"]))
    whole = with_questions_in_order(F.array_join(shown, "\n\n"))
    return page.select("doc_id", "page_no", F.size("b").alias("n_blocks"), F.concat(F.format_string(PAGE_HEAD, "page_no"), whole).alias("text"))


def digital_documents(blocks: DataFrame) -> DataFrame:
    """``doc_id, pages, text``: the pages of :func:`digital_text` by number, an empty line between."""
    each = digital_text(blocks).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    return each.select("doc_id", F.size("p").alias("pages"), F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def page_count(text):
    """Page marks in a text; the word for a page in prose counts nothing."""
    return F.regexp_count(text, F.lit(r"\[ ?صفحة \d+ ?\]"))


def distinct_pages(pages: DataFrame) -> DataFrame:
    """Pages whose whole content was not seen before, by document and page; one row of each content.

    Null is a content of its own, apart from the empty text.  Of repeated rows one stays.
    """
    content = F.coalesce(F.sha2("text", 256), F.lit("none"))
    first = pages.groupBy(content).agg(F.min_by(F.struct(*pages.columns), F.struct("doc_id", "page_no")).alias("page"))
    return first.select("page.*")


def safe_name(name):
    """A file name without characters that paths reserve."""
    return F.regexp_replace(name, r'[\\/:*?"<>|]', "_")
