"""Rules over the order of lines, as array functions on the text of a row instead of a loop with state.

A document's lines stay in its row, so the rules need no shuffle, and rows that
repeat an id do not mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from foliant.functions.classify import is_table_row, line_class
from foliant.functions.rewrite import each_match, only
from foliant.functions.unicode import strip
from foliant.operators.corpus import lines
from foliant.operators.wordwise import bound

#: A line that ends so is complete.
ENDS = r"[.؟!:؛\"»]$"


def joined(rows: DataFrame, order: str = "line_no", text: str = "text") -> DataFrame:
    """Documents again, their rows joined by newlines in order."""
    return rows.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "\n").alias("text")
    )


def _order() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_no")


def _so_far() -> WindowSpec:
    return _order().rowsBetween(Window.unboundedPreceding, 0)


def _text_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _by_line(docs: DataFrame, each) -> DataFrame:
    """``doc_id`` and the fields of the structs that ``each(lines, stripped lines)`` makes of a text."""
    text = F.coalesce("text", F.lit(""))
    both = F.struct(_text_lines(text).alias("l"), F.transform(_text_lines(text), strip).alias("s"))
    return docs.select("doc_id", F.explode(bound(both, lambda x: each(x["l"], x["s"]))).alias("_x")).select("doc_id", "_x.*")


def _segments(items: Column, starts, make) -> Column:
    """``make(number, first, length)`` of the runs of ``items`` that begin where ``starts(i)`` holds; numbers from 1."""
    size = F.size(items)
    at = F.filter(F.transform(items, lambda _, i: F.when((i == 0) | starts(i), i)), lambda i: i.isNotNull())
    return bound(at, lambda at: F.transform(at, lambda i, k: make(k + 1, i, F.coalesce(F.get(at, k + 1), size) - i)))


def drop_repeated_lines(docs: DataFrame, short: int = 20) -> DataFrame:
    """Lines without later copies (white space aside) in their document; lines shorter than ``short`` stay."""
    rows = lines(docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()).select(F.struct("doc_id", "_row").alias("doc_id"), "text"))
    key = F.md5(F.regexp_replace("stripped", r"\s+", " "))
    nth = F.row_number().over(Window.partitionBy("doc_id", key).orderBy("line_no"))
    kept = rows.withColumn("nth", nth).where((F.col("nth") == 1) | (F.length("stripped") < short))
    return kept.select("doc_id.doc_id", "line_no", "text")


def _run(same: Column) -> Column:
    """Number of the run a row is in, a run starting where ``same`` is not true."""
    return F.sum(F.when(same, 0).otherwise(1)).over(_so_far())


def _kept_of_runs(rows: Column, s: Column, most: int, make) -> Column:
    exempt = lambda i: (F.get(s, i) == "") | F.get(s, i).rlike(r"^(?:#|---|\[|\*\*|>|- )")

    def again(i: Column) -> Column:
        out = F.lit(True)
        for k in range(1, most + 1):
            out = out & F.coalesce(F.get(s, i) == F.get(s, i - k), F.lit(False))
        return out

    each = F.transform(rows, lambda x, i: F.when(exempt(i) | ~again(i), make(x, i)))
    return F.filter(each, lambda x: x.isNotNull())


def limit_runs(docs: DataFrame, most: int = 2) -> DataFrame:
    """``doc_id, line_no, text``: at most ``most`` equal lines in a row; blank and marked lines stay and end a run."""
    return _by_line(docs, lambda rows, s: _kept_of_runs(rows, s, most, lambda x, i: F.struct(i.alias("line_no"), x.alias("text"))))


def limited_runs(text: Column, most: int = 2) -> Column:
    """The text as :func:`limit_runs` leaves it."""
    both = F.struct(_text_lines(text).alias("l"), F.transform(_text_lines(text), strip).alias("s"))
    return bound(both, lambda x: F.array_join(_kept_of_runs(x["l"], x["s"], most, lambda line, _: line), "\n"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, par_no, line_no, text``: broken lines joined up to a line that ends in a stop.

    Blank lines, rules, headings, list items, notes and bracketed lines stand alone.
    """
    return _by_line(docs, lambda _, s: _paragraphs_of(s))


def _paragraphs_of(s: Column) -> Column:
    alone = lambda x: (x == "") | x.rlike(r"^(?:---|📌|#|-|\*|\()") | F.contains(x, F.lit("تنويه"))
    starts = lambda i: alone(F.get(s, i)) | alone(F.get(s, i - 1)) | F.get(s, i - 1).rlike(ENDS)
    make = lambda k, i, n: F.struct(k.cast("long").alias("par_no"), i.alias("line_no"), F.array_join(F.slice(s, i + 1, n), " ").alias("text"))
    return _segments(s, starts, make)


def joined_paragraphs(text: Column) -> Column:
    """The text with its broken lines joined, a line for each paragraph of :func:`paragraphs`."""
    return bound(F.transform(_text_lines(text), strip), lambda s: F.array_join(F.transform(_paragraphs_of(s), lambda p: p["text"]), "\n"))


def _taking(s: Column, short: int, use) -> Column:
    """``use`` of marks by line: T takes the next line, S is taken, 0 stands alone.

    Whether a line could take the next depends on the two alone; a string of
    these flags is read from left to right, each that can taking the one after it.
    """
    special = lambda x: x.rlike(r"^(?:#|---|\[|\(|>|\*\*|- |س)") | x.rlike(r"^\d+[.\-)]")
    joins = lambda x: F.coalesce((x != "") & ~x.rlike(r"^(?:#|---|\[|\(|>)"), F.lit(False))
    can = lambda x, i: (x != "") & ~special(x) & (F.length(x) < short) & ~x.rlike(ENDS) & joins(F.get(s, i + 1))
    flags = F.array_join(F.transform(s, lambda x, i: F.when(can(x, i), "1").otherwise("0")), "")
    return bound(F.split(F.regexp_replace(flags, "1.", "TS"), ""), use)


def _merged(s: Column, short: int, make) -> Column:
    def use(m: Column) -> Column:
        text = lambda x, i: F.when(F.get(m, i) == "T", F.concat_ws(" ", x, F.get(s, i + 1))).otherwise(x)
        each = F.transform(s, lambda x, i: F.when(F.get(m, i) != "S", make(text(x, i), i)))
        return F.filter(each, lambda x: x.isNotNull())

    return _taking(s, short, use)


def merge_pairs(docs: DataFrame, short: int = 80) -> DataFrame:
    """``doc_id, line_no, text``: a short unfinished line takes the next one, which then takes none; lines are stripped."""
    return _by_line(docs, lambda _, s: _merged(s, short, lambda t, i: F.struct(i.alias("line_no"), t.alias("text"))))


def merged_pairs(text: Column, short: int = 80) -> Column:
    """The text as :func:`merge_pairs` leaves it."""
    return bound(F.transform(_text_lines(text), strip), lambda s: F.array_join(_merged(s, short, lambda t, _: t), "\n"))


def _cells(row: Column) -> Column:
    parts = F.when(F.contains(row, F.lit("|")), F.split(row, r"\|")).when(F.contains(row, F.lit("\t")), F.split(row, "\t")).otherwise(F.split(row, r"\s{3,}"))
    return F.filter(F.transform(parts, strip), lambda c: c != "")


def _rendered(grid: Column) -> Column:
    """Lines of a Markdown table, its rows filled up to the widest."""
    line = lambda c: F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |"))
    full = lambda w: F.transform(grid, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), w - F.size(r)))))
    rule = lambda w: F.array(line(F.array_repeat(F.lit("---"), w)))
    return bound(F.array_max(F.transform(grid, F.size)), lambda w: F.concat(F.slice(full(w), 1, 1), rule(w), F.slice(full(w), F.lit(2), F.size(grid))))


def tables(docs: DataFrame) -> DataFrame:
    """``doc_id, table_no, n_rows, n_cols, markdown``: runs of two or more rows of cells."""

    def each(rows: Column, _) -> Column:
        is_row = lambda i: is_table_row(F.get(rows, i))
        run = lambda k, i, n: F.struct(k.cast("long").alias("table_no"), F.transform(F.slice(rows, i + 1, n), _cells).alias("grid"), is_row(i).alias("row"))
        found = F.filter(_segments(rows, lambda i: ~(is_row(i) & is_row(i - 1)), run), lambda r: r["row"] & (F.size(r["grid"]) > 1))
        show = lambda r: F.struct(
            r["table_no"], F.size(r["grid"]).cast("long").alias("n_rows"), F.array_max(F.transform(r["grid"], F.size)).alias("n_cols"), F.array_join(_rendered(r["grid"]), "\n").alias("markdown")
        )
        return F.transform(found, show)

    return _by_line(docs, each)


#: Stands before rows of cells while they are gathered; Unicode keeps it out of texts, and it is removed from them.
_ROW_MARK = "\ufffe"


def tables_in(text: Column) -> Column:
    """The text with runs of two or more rows of cells as Markdown tables, an empty line after each; a single row's cells by tabs."""
    some = lambda t: F.contains(t, F.lit("|")) | F.contains(t, F.lit("\t")) | F.contains(t, F.lit(_ROW_MARK)) | t.rlike(r"\s{3}")
    return only(text, some, _with_tables)


def _with_tables(text: Column) -> Column:
    own = F.replace(text, F.lit(_ROW_MARK), F.lit(""))
    marked = F.array_join(F.transform(_text_lines(own), lambda x: F.when(is_table_row(x), F.concat(F.lit(_ROW_MARK), x)).otherwise(x)), "\n")

    def table(run: Column) -> Column:
        shown = lambda grid: F.when(F.size(grid) > 1, F.concat(F.array_join(_rendered(grid), "\n"), F.lit("\n"))).otherwise(F.array_join(F.get(grid, F.lit(0)), "\t"))
        return bound(F.transform(_text_lines(F.replace(run, F.lit(_ROW_MARK), F.lit(""))), _cells), shown)

    return each_match(marked, rf"{_ROW_MARK}[^\n]*+(?:\n{_ROW_MARK}[^\n]*+)*+", table)


#: A numbered question at the start of a line; a range of numbers is none.
QUESTION = r"^\s*\d+ *[-–](?!\d)"


def with_questions_in_order(text: Column) -> Column:
    """The text with its numbered blocks by number, equal numbers in their order; what precedes the first comes first, each after an empty line.

    A text without numbered blocks stays as it is.
    """
    blocks = F.filter(F.transform(F.split(text, f"(?m)(?={QUESTION})"), strip), lambda b: b != "")
    number = lambda b: F.coalesce(F.when(b.rlike(QUESTION), F.regexp_extract(b, r"^(\d+)", 1).try_cast("long")), F.lit(-1).cast("long"))
    shown = lambda b: F.when(number(b) >= 0, F.concat(number(b).cast("string"), F.lit(" - "), strip(F.regexp_replace(b, r"^\d+ *[-–]", "")))).otherwise(b)
    parts = F.array_sort(F.transform(blocks, lambda b, i: F.struct(number(b).alias("n"), i.alias("i"), shown(b).alias("t"))))
    return F.when(text.rlike(f"(?m){QUESTION}"), F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n")).otherwise(text)


def questions_in_order(docs: DataFrame) -> DataFrame:
    """``doc_id, q_ord, q_num, text``: numbered blocks of a document by number; equal numbers keep their order.

    A block starts with ``N -`` at the start of a line; what precedes the first
    has number null and comes first.
    """
    mark = r"(?m)(?=^\s*\d+ *[-–](?!\d))"
    blocks = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), mark)).alias("pos", "block")).where(strip(F.col("block")) != "")
    number = F.regexp_extract("block", r"^\s*(\d+) *[-–]", 1)
    blocks = blocks.withColumn("q_num", F.when(number != "", number.try_cast("long")))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("q_num").asc_nulls_first(), "pos"))
    return blocks.select("doc_id", nth.alias("q_ord"), "q_num", strip(F.col("block")).alias("text"))


def markdown(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: each line by its class; paragraphs that go on are joined, blank runs kept to two."""
    rows = lines(docs).withColumn("kind", line_class(F.col("text")))
    go_on = (F.col("kind") == "paragraph") & (F.lag("kind").over(_order()) == "paragraph") & (F.col("stripped") != "") & (F.lag("stripped").over(_order()) != "") & ~F.lag("stripped").over(_order()).rlike(ENDS)
    rows = rows.withColumn("run", _run(go_on))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "stripped"))), lambda x: x["stripped"]), " ")
    block = rows.groupBy("doc_id", "run").agg(F.first("kind").alias("kind"), text.alias("t"))
    t = F.col("t")
    shown = (
        F.when(t == "", "").when(F.col("kind") == "page_break", "---").when(F.col("kind") == "visual_note", F.concat(F.lit("> ⚠️ "), t))
        .when(F.col("kind") == "chapter_title", F.concat(F.lit("# "), t)).when(F.col("kind") == "section_title", F.concat(F.lit("## "), t))
        .when(F.col("kind") == "question", F.concat(F.lit("### "), t)).when(F.col("kind") == "choice", F.concat(F.lit("- "), t))
        .when(F.col("kind") == "equation", F.concat(F.lit("> 📐 "), t)).otherwise(t)
    )
    return joined(block.select("doc_id", "run", shown.alias("text")), "run").withColumn("text", F.regexp_replace("text", r"\n{4,}", "\n\n\n"))
