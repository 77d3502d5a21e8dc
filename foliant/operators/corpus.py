"""Documents as lines, tokens and n-grams; each derivation is a narrow projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.rewrite import knowledge_text
from foliant.functions.unicode import TASHKEEL, blanks, strip, words

#: What ends a line of the knowledge base.
LINE_ENDS = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]"


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, line_no, text, stripped``, a row for each line."""
    out = docs.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("line_no", "text"))
    return out.withColumn("stripped", strip(F.col("text")))


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, pos, token`` over whole documents."""
    return docs.select(id_col, F.posexplode(blanks(F.coalesce(text_col, F.lit("")))).alias("pos", "token"))


def line_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, line_no, line, words``: the cleaned line and its words, for lines that have any."""
    source = F.split(F.coalesce(text_col, F.lit("")), LINE_ENDS)
    out = docs.select(id_col, F.posexplode(source).alias("line_no", "raw"))
    # the words come from one split of the raw line; the cleaned line is only computed where it is asked for
    own = words(F.regexp_replace("raw", TASHKEEL, ""))
    return out.select(id_col, "line_no", knowledge_text(F.col("raw")).alias("line"), own.alias("words")).where(F.size("words") > 0)


def ngrams(items: Column, n: int) -> Column:
    """Runs of ``n`` items as strings, in order; none if there are fewer."""
    size = F.size(items) - (n - 1)
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda i: F.array_join(F.slice(items, i, n), " "))).otherwise(
        F.array().cast("array<string>")
    )
