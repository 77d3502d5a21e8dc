"""Exact de-duplication with the heavy groups removed on the map side."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm._common import cut

#: As many frequent digests are broadcast as there are shuffle partitions, but within these bounds, whatever the input.
HOT_DIGESTS, MOST_DIGESTS = 128, 2048
#: Counters that each Misra-Gries summary holds for each of them.
COUNTERS = 16
#: Groups of tasks whose counters are merged.
GROUPS = 32


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased and every other character kept; null is empty."""
    t = F.coalesce(text, F.lit(""))
    # lower() touches other letters too, so it serves only where all characters are ASCII
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(
        F.translate(t, string.ascii_uppercase, string.ascii_lowercase)
    )


def frequent(rows: DataFrame, key: str, hot: int = HOT_DIGESTS) -> DataFrame:
    """Candidates for the most frequent values of ``key``, at most ``GROUPS * hot`` rows.

    Misra-Gries counters run in every task and are merged in ``GROUPS`` groups of
    tasks.  A value with a share of the rows has at least that share of some
    group, so the leaders of the groups hold all values above ``1 / hot``.
    """
    return (
        rows.where(F.col(key).isNotNull())
        .groupBy(F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("g"))
        .agg(F.expr(f"approx_top_k({key}, {hot}, {hot * COUNTERS})").alias("top"))
        .select(F.explode("top.item").alias(key))
        .distinct()
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z only; the row with
    the largest id of a group stays.  Candidates from :func:`frequent` are
    counted exactly; the largest, one for each shuffle partition within
    ``HOT_DIGESTS`` and ``MOST_DIGESTS``, win, are broadcast and settle the members
    of large groups where they are read.  The rest has no group above the mean
    of a partition (or ``rows / MOST_DIGESTS``) and is shuffled by digest.

    A null text counts as empty.  A null id never wins over another; if a group
    holds only null ids its ``keep_id`` is null and all its rows are kept.
    Rows that repeat an id with equal text count in ``group_size`` and share
    the fate of that id.  An empty table gives an empty result; other columns
    are ignored.
    """
    base = cut(docs.select(F.col(id_col).alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("digest")))
    hot = min(MOST_DIGESTS, max(HOT_DIGESTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    facts = [F.max("id").alias("keep_id"), F.count("*").alias("group_size")]
    winners = cut(
        base.join(F.broadcast(frequent(base, "digest", hot)), "digest", "left_semi").groupBy("digest").agg(*facts)
        .orderBy(F.desc("group_size"), "digest").limit(hot)
    )
    settled = base.join(F.broadcast(winners), "digest")
    cold = base.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    cold = cold.join(cold.groupBy("digest").agg(*facts), "digest")
    return settled.unionByName(cold).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, by id and text, with their columns unchanged."""
    own, text = (f"{x}_{uuid.uuid4().hex}" for x in ("stay", "digest"))  # names that no column of the input has
    stay = exact_dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias(own), F.col("text_sha256").alias(text)).distinct()
    same = docs[id_col].eqNullSafe(F.col(own)) & (F.sha2(normalised(docs[text_col]), 256) == F.col(text))
    return docs.join(stay, same, "left_semi")
