"""Line de-duplication by a prefix-filtered set-similarity join, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm._common import cut, drop_cut, marked, marks, release

#: Similarity from which lines match, as a fraction, so that tests on counts are exact.
NUM, DEN = 4, 5
#: Counters of word frequency by hash; their levels travel with the plan.
COUNTERS = 1 << 16
#: Groups of more lines than this meet their earliest line first.
CROWD = 16
#: A word of this level (twice the binary logarithm of its count) is a key only with the next word that two lines share.
COMMON = 26
#: A table of up to so many leading lines is broadcast, a longer one is shuffled.
SHIPPED = 100_000

#: Lines of more words have two more 64-bit maps, each of half of the words, since one map tells little of so many.
LONG = 72

_LOW = (1 << 31) - 1
_MAPS = ("bits", "half0", "half1")


def line_tokens(line: Column) -> Column:
    """Words of a line in lower case; words are what blanks part."""
    low = F.lower(line)
    odd = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c"))
    return F.split(F.when(odd, F.translate(low, "\t\r\x0b\x0c", "    ")).otherwise(low), " ")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``d, h, text``: document id, hash of the row, text."""
    rows = docs.select(F.col(id_col).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("d", F.xxhash64("d", "text").alias("h"), "text")


def _lines(rows: DataFrame) -> DataFrame:
    """``d, h, l, line``: number and text of each line of the rows."""
    return rows.select("d", "h", F.posexplode(F.split("text", "\n")).alias("l", "line"))


def rarity(docs: DataFrame, text_col: str = "text") -> list[int]:
    """Level of frequency for each hash of a word, twice the binary logarithm of its count.

    ``COUNTERS`` counts reach the driver, whatever the input.  The order of words
    is the same for all lines even where words share a counter, so the join
    stays exact; only its speed depends on how well the levels tell words apart.
    """
    text = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n"), F.lit(" "))
    words = docs.select(F.explode(line_tokens(text)).alias("w"))
    levels = [0] * COUNTERS
    for bucket, n in words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(COUNTERS - 1)).alias("b")).agg(F.count("*").alias("n")).collect():
        levels[bucket] = min(62, int(2 * math.log2(n)))
    return levels


def _keys(line: Column, levels: list[int]) -> Column:
    """Distinct words of a line as numbers, rarest first: six bits of level, then 57 of hash."""
    table = F.split(F.lit(",".join(str(x << 57) for x in levels)), ",").cast("array<long>")  # folded to a literal once
    at = lambda w: F.get(table, F.xxhash64(w).bitwiseAND(F.lit(COUNTERS - 1)).cast("int"))
    words = F.array_remove(line_tokens(line), "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: at(w).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 7)))))


def _signature(common: int) -> Column:
    """Keys of which two lines that match share one, with the overlap that is possible from there.

    Two lines that match share a word of their prefixes.  A word from the level
    ``common`` on, found last in a prefix, is replaced by its pairs with the words
    after it up to one beyond the prefix, where the next shared word must be.  An
    entry holds 31 bits of the key's hash and, above them, the largest overlap.
    Lines of fewer words than ``NUM / (DEN - NUM)`` match only equal sets.
    """
    n = F.size("keys")
    length = n - F.ceil(n * NUM / DEN).cast("int") + 1
    entry = lambda h, most: F.shiftleft(most.cast("long"), 31).bitwiseOR(h.bitwiseAND(F.lit(_LOW)))
    rare = F.size(F.filter(F.slice("keys", F.lit(1), length), lambda k: k < F.lit(common << 57)))
    single = F.transform(F.slice("keys", F.lit(1), rare), lambda k, i: entry(k, n - i))
    paired = F.flatten(F.transform(
        F.sequence(rare, length - 1),
        lambda i: F.transform(F.slice("keys", i + 2, length - i), lambda q, j: entry(F.xxhash64(F.get("keys", i), q), n - i - j)),
    ))
    none = F.array().cast("array<long>")
    return F.when(n * (DEN - NUM) < NUM, none).when(rare == length, single).otherwise(F.concat(single, paired))


def _prefix(reps: DataFrame) -> DataFrame:
    """A row for each key of a line: ``token, r, n, m`` and the maps."""
    rows = reps.select("r", "n", *_MAPS, F.explode("signature").alias("s"))
    return rows.select(F.col("s").bitwiseAND(F.lit(_LOW)).cast("int").alias("token"), "r", "n", F.shiftright("s", 31).cast("int").alias("m"), *_MAPS)


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int"))


def _map(words: str | Column) -> Column:
    """64 bits that tell whether an odd number of words falls there."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda b, k: b.bitwiseXOR(_bit(k)))


def _half(part: int) -> Column:
    """Map of the words of one half; 0 for a line of up to ``LONG`` words, which does without."""
    return F.when(F.size("keys") > LONG, _map(F.filter("keys", lambda k: F.shiftright(k, 6).bitwiseAND(F.lit(1)) == part))).otherwise(F.lit(0).cast("long"))


def _meet(a: DataFrame, b: DataFrame, earlier: Column) -> DataFrame:
    """Lines ``a`` and earlier ones ``b`` that share a key: ``r, other``, and what :func:`_close` tells them apart by."""
    ends = [F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in ("n", *_MAPS)]
    return a.alias("a").join(b.alias("b"), (F.col("a.token") == F.col("b.token")) & earlier).select(F.col("a.r").alias("r"), F.greatest("b.r", F.bitwise_not("b.r")).alias("other"), *ends)


def _close(met: DataFrame, long: int) -> DataFrame:
    """The distinct pairs that neither length nor maps exclude.

    Each bit in which two maps differ stands for a word of one line only.  Spark
    moves the filter into the join, so pairs that it excludes are not made.
    """
    apart = lambda c: F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}")))
    near = lambda bits: (NUM + DEN) * bits <= (DEN - NUM) * (F.col("a_n") + F.col("b_n"))
    both = (F.col("a_n") > long) & (F.col("b_n") > long)
    return (
        met.where(DEN * F.least("a_n", "b_n") >= NUM * F.greatest("a_n", "b_n")).where(near(apart("bits")))
        .where(~both | near(apart("half0") + apart("half1"))).select("r", "other").distinct()
    )


def _matching(pairs: DataFrame, reps: DataFrame, rows: DataFrame, levels: list[int]) -> DataFrame:
    """``r``: the later lines of the candidate pairs (r, other) whose Jaccard similarity reaches the threshold."""
    involved = cut(pairs.select(F.explode(F.array("r", "other")).alias("r")).distinct().join(reps.select("r", "d", "h", "l"), "r"))
    near = _lines(marked(rows, marks(involved, "h"), "h"))  # rows that are surely not involved are not split,
    near = marked(near, marks(involved, "h", "l"), "h", "l")  # and such lines go before the shuffle
    used = cut(
        near.alias("x").join(involved.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.l") == F.col("y.l")) & F.col("x.d").eqNullSafe(F.col("y.d")))
        .select("r", "line").dropDuplicates(["r"]).select("r", _keys(F.col("line"), levels).alias("keys"))
    )
    both = pairs.join(used.withColumnRenamed("keys", "x"), "r").join(used.select(F.col("r").alias("other"), F.col("keys").alias("y")), "other")
    shared = F.size(F.array_intersect("x", "y"))
    found = cut(both.where((NUM + DEN) * shared >= NUM * (F.size("x") + F.size("y"))).select("r").distinct())
    drop_cut(used, involved)
    return found


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON, shipped: int = SHIPPED) -> DataFrame:
    """One row per input row: ``id_col, n_lines, n_removed, removed, text``.

    Lines are ordered by document id (null first), then by a hash of the row,
    then by place.  A line is removed if any earlier line of the corpus, itself
    removed or not, has a Jaccard similarity of 0.8 or more over distinct
    lower-case words.  ``removed`` lists the numbers of removed lines from 0, and
    ``text`` is what is left.  Lines without words always stay.

    Lines of equal word sets form a class whose first line stands for it; these
    are numbered in order.  Words are ordered by rarity; lines that share a key
    of their prefixes (see :func:`_signature`) and pass the length and positional
    filters are candidates.  Where a key brings more than ``CROWD`` lines
    together, each meets the earliest first, and what that removes is not
    compared again, so a group of near copies costs a pair for each member and
    not for each two; the others are compared in full.

    A null text counts as empty.  Rows that repeat id and text are one document
    and share its fate.  An empty table gives an empty result; other columns are
    ignored.  Words are compared by 57 bits of their hash, sets by 96.
    """
    levels = rarity(docs, text_col)
    rows = _rows(docs, id_col, text_col)
    sets = cut(
        _lines(rows).select("d", "h", "l", _keys(F.col("line"), levels).alias("keys")).select(
            "d", "h", "l", F.xxhash64("keys").alias("k"), F.hash("keys").alias("k2"), F.size("keys").alias("n"),
            _map("keys").alias("bits"), _half(0).alias("half0"), _half(1).alias("half1"), _signature(common).alias("signature"),
        ).withColumn("u", F.monotonically_increasing_id())
    )
    some = sets.where("n > 0")
    first = cut(
        some.groupBy("k", "k2").agg(F.min(F.struct("d", "h", "l", "u")).alias("m")).select("k", "k2", "m.*")
        .orderBy(F.col("d").asc_nulls_first(), "h", "l").withColumn("r", F.monotonically_increasing_id())
    )
    with_first = some.join(first.select("k", "k2", "r", F.col("d").alias("d0"), F.col("h").alias("h0"), F.col("l").alias("l0"), F.col("u").alias("u0")), ["k", "k2"])
    same = F.col("d").eqNullSafe(F.col("d0")) & (F.col("h") == F.col("h0")) & (F.col("l") == F.col("l0"))
    is_first = F.col("u") == F.col("u0")  # one row, even if a document is repeated
    known = cut(with_first.where(is_first | ~same).select("d", "h", "l", F.when(is_first, F.col("r")).alias("r"), "n", *_MAPS, F.when(is_first, F.col("signature")).alias("signature")))
    drop_cut(sets, first)
    release(docs.sparkSession)
    again = known.where("r IS NULL").select("d", "h", "l")
    reps = known.where("r IS NOT NULL")

    prefix = _prefix(reps)
    crowded = prefix.groupBy("token").agg(F.count("*").alias("c"), F.min("r").alias("r")).where(F.col("c") > CROWD)
    leads = cut(crowded.join(reps.select("r", "n", *_MAPS), "r").select("token", "r", "n", *_MAPS))
    small = leads.count() <= shipped
    crowd = cut(_close(_meet(prefix, F.broadcast(leads) if small else leads, F.col("a.r") > F.col("b.r")), LONG))
    release(docs.sparkSession)
    done = _matching(crowd, reps, rows, levels)
    release(docs.sparkSession)
    # a removed line meets no earlier one again; its number is turned over, so that both sides of the join are the same rows and shuffled once
    marked_done = reps.join(done.withColumn("gone", F.lit(True)), "r", "left").withColumn("r", F.when(F.col("gone"), F.bitwise_not("r")).otherwise(F.col("r")))
    marked_done = marked_done.where("r IS NOT NULL")  # always so; the join would say it of one side only
    every = _prefix(marked_done)
    fits = (NUM + DEN) * F.least("a.m", "b.m") >= NUM * (F.col("a.n") + F.col("b.n"))
    pairs = cut(_close(_meet(every, every, (F.greatest("b.r", F.bitwise_not("b.r")) < F.col("a.r")) & fits), LONG))
    release(docs.sparkSession)
    gone = done.union(_matching(pairs, reps, rows, levels))

    dropped = again.union(reps.join(gone, "r", "left_semi").select("d", "h", "l"))
    by_row = cut(dropped.groupBy("d", "h").agg(F.sort_array(F.collect_set("l")).alias("removed")))
    drop_cut(known, leads, crowd, pairs)
    release(docs.sparkSession)
    out = rows.withColumn("n_lines", F.size(F.split("text", "\n")).cast("long")).alias("x").join(by_row.alias("y"), (F.col("x.h") == F.col("y.h")) & F.col("x.d").eqNullSafe(F.col("y.d")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(removed, i))
    return out.select(
        F.col("x.d").alias(id_col), "n_lines", F.size(removed).cast("long").alias("n_removed"),
        removed.alias("removed"), F.array_join(left, "\n").alias("text"),
    )
