"""What five filters remove in every order, from one table of counts by mask of failures.

The filters of a row make a mask of five bits, and everything about any order
follows from how many rows each mask has.  Four bits come from the text alone.
For the fifth, copies of earlier rows, a counting Bloom filter goes first: each
task counts the hashes of its texts, the counters are merged, and a text with a
counter that only it has touched is unique for sure.  The others alone are
shuffled, whole, to find the smallest id of each text.
"""

from __future__ import annotations

import itertools
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm._common import cut

#: Letters of the filters; the k-th has bit k of a mask.
FILTERS = "ABCDE"
#: Fewest words; least share of distinct words and most of capitals, in percent; forbidden characters.
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 2, b"#$%&*|"
#: Counters for each row, and their number in all: a map of those above one has 16 MB at most.
COUNTERS_EACH, FEWEST, MOST = 8, 1 << 15, 1 << 27
#: Counters in a row of the map.
ROW_BITS = 1 << 15

_CAPITALS = string.ascii_uppercase.encode()


def mask_of(text: str) -> int:
    """Failures of a text in filters A to D."""
    data = text.encode()
    words = data.split()
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    return (
        (len(words) < FEWEST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS * len(text)) << 2
        | any(c in data for c in MARKS) << 3
    )


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = pa.array([mask_of(x.as_py()) for x in b.column(3)], pa.int32())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], found], names=["id", "part", "hash", "mask"])


def _counters(n: int) -> tuple[Column, Column]:
    """The two counters of a text among ``n``."""
    return F.col("hash").bitwiseAND(F.lit(n - 1)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(n - 1))


def _shared(rows: DataFrame, n: int) -> DataFrame:
    """Map of the counters that more than one row has touched: rows of 4 kB."""
    counted = rows.select(F.explode(F.array(*_counters(n))).alias("at")).groupBy("at").agg(F.count("*").alias("n")).where("n > 1")
    return counted.groupBy(F.floor(F.col("at") / ROW_BITS).alias("row")).agg(F.bitmap_construct_agg(F.col("at") % ROW_BITS).alias("bits"))


def _with_doubt(rows: DataFrame, shared: DataFrame, n: int) -> DataFrame:
    """``rows`` and ``maybe``: false where the text is unique for sure, since one of its counters is its own."""
    out = rows.withColumn("maybe", F.lit(True))
    for at in _counters(n):
        place = F.pmod(at, F.lit(ROW_BITS)).cast("int")
        byte = F.conv(F.hex(F.substring("bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
        met = F.coalesce(F.getbit(byte, place.bitwiseAND(F.lit(7))) == 1, F.lit(False))
        bits = F.broadcast(shared)  # at most MOST / ROW_BITS rows
        out = out.join(bits, F.floor(at / ROW_BITS) == F.col("row"), "left").withColumn("maybe", F.col("maybe") & met).drop("row", "bits")
    return out


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: rows of each part by their failures, and how many of them are labelled.

    A null text counts as empty, a null part as the empty string.  A row is a
    copy if a row with a smaller id has the same text, in any part; a null id is
    neither smaller nor larger, and rows that repeat id and text are no copies of
    one another.  A document is good (toxic) if one of its labels says so; null
    and repeated labels, and labels of a null id, add nothing.  Other columns are ignored.
    """
    own = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    own = own.select("id", "part", F.xxhash64("text").alias("hash"), "text")
    rows = cut(own.mapInArrow(_masks, own.drop("text").schema.add("mask", "integer")))
    n, size = FEWEST, rows.count()
    while n < min(COUNTERS_EACH * size, MOST):
        n *= 2
    shared = cut(_shared(rows, n))
    # equal texts of a task become one row before the shuffle, so a large group weighs little
    first = _with_doubt(own.select("id", "hash", "text"), shared, n).where("maybe").groupBy("text").agg(F.min("id").alias("id"))
    first = first.where("id is not null").select("id", F.xxhash64("text").alias("hash"), F.lit(True).alias("first"))
    copy = F.col("maybe") & F.col("first").isNull() & F.col("id").isNotNull()
    masks = F.col("mask").bitwiseOR(F.when(copy, 1 << 4).otherwise(0))
    flagged = _with_doubt(rows, shared, n).join(first, ["id", "hash"], "left").select("id", "part", masks.alias("mask"))
    told = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    each = flagged.join(told, "id", "left")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return each.groupBy("part", "mask").agg(F.count("*").alias("n"), count("good"), count("toxic"))


def _orders() -> Column:
    return F.array(*[F.lit("".join(p)) for p in itertools.permutations(FILTERS)])


def interactions(masks: DataFrame) -> DataFrame:
    """What each filter does at each step of every order, from :func:`mask_counts`.

    ``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``.  A mask with k failures is removed by each
    of its filters in the same share, 1/k, of all orders.
    """
    cells = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))
    each = masks.groupBy("part").agg(cells.alias("cells"))  # at most 32 entries
    rows = each.select("part", "cells", F.explode(_orders()).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    rows = rows.withColumn("own", F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, step, 1)) - 1)"))
    rows = rows.withColumn(
        "before", F.expr(f"aggregate(sequence(1, step), 0, (a, k) -> a | if(k < step, shiftleft(1, instr('{FILTERS}', substring(filter_order, k, 1)) - 1), 0))")
    )
    total = lambda what, where: F.expr(f"aggregate(map_entries(cells), 0L, (a, e) -> a + if({where}, {what}, 0L))")
    fails, free = "(e.key & own) <> 0", "(e.key & before) = 0"
    orders = len(list(itertools.permutations(FILTERS)))
    return rows.select(
        "part", "filter_order", "step",
        total("e.value.n", f"(e.key & own) = 0 AND {free}").alias("kept"), total("e.value.n", f"{fails} AND {free}").alias("removed"),
        total("e.value.n", f"{fails} AND NOT {free}").alias("redundant"), total("e.value.n", "e.key = own").alias("unique_fails"),
        total("e.value.good", f"{fails} AND {free}").alias("good_lost"), total("e.value.toxic", f"{fails} AND {free}").alias("toxic_lost"),
        total(f"e.value.n * {orders} div bit_count(e.key)", fails).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`interactions` of the documents; an empty table gives an empty result."""
    return interactions(mask_counts(docs, labels))


def oracle() -> str:
    """The same question in DuckDB's SQL."""
    letters = ", ".join(f"('{x}', {1 << k})" for k, x in enumerate(FILTERS))
    return f"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
          w AS (SELECT *, list_filter(string_split_regex(text, '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM d),
          m AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
            + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
            + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM w),
          l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
          c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
          f(x, b) AS (VALUES {letters}),
          o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM f p, f q, f r, f s, f t WHERE p.b | q.b | r.b | s.b | t.b = 31),
          k AS (SELECT filter_order, step, bits[step] AS own, list_sum(bits[:step]) - bits[step] AS before FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM o))
        SELECT part, filter_order, step::INT AS step,
          coalesce(sum(n) FILTER (mask & own = 0 AND mask & before = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
          coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
          coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
          coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & own <> 0), 0)::BIGINT AS shapley
        FROM c, k GROUP BY ALL"""
