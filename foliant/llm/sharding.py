"""Sharding by vector bin packing over bytes, tokens and rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm._common import cut

#: Small groups meet in so many bins by the hash of their text.
BINS = 32768
#: A group above this share of any total is counted by itself, in parts of about PIECE of it.
LARGE, PIECE = 1 / 1024, 1 / 4096


def pack(vectors: np.ndarray, n_shards: int, weights: tuple[float, ...]) -> np.ndarray:
    """Shard of each vector (rows: bytes, tokens, rows).

    Largest first, each goes where its dot product with the residual capacity
    is highest; the first such shard wins a tie.
    """
    total = np.maximum(vectors.sum(axis=0), 1)
    v = vectors / total
    w = np.asarray(weights)
    residual = np.full((n_shards, v.shape[1]), 1.0 / n_shards)
    out = np.zeros(len(v), dtype=np.int32)
    for i in np.argsort(-v.max(axis=1), kind="stable"):
        s = int(np.argmax(residual @ (v[i] * w)))
        residual[s] -= v[i]
        out[i] = s
    return out


def shard(
    docs: DataFrame,
    n_shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: tuple[float, float, float] = (4.0, 1.0, 1.0),
) -> DataFrame:
    """One row per input row: ``id_col, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``bytes``: the sums of ``size`` (UTF-8 bytes of the text plus 1)
    are near equal; tokens and rows are balanced along.  Equal texts form a
    group.  Groups below ``LARGE`` of every total meet in ``BINS`` bins by text
    hash; larger ones, of which there are at most ``3 / LARGE``, are units of
    their own up to the size of a shard; one above it makes as many units as it
    would fill shards, by the hash of the id.  So the driver packs at most ``BINS + 3 / PIECE + 6 / LARGE`` vectors,
    whatever the input.  ``slot`` runs from 0 without gaps in each shard: the
    bins of a shard follow one another and a window ranks the rows of a bin.

    A null text is empty and has size 1; null ids come last in their bin;
    repeated rows take a slot each; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"),
            F.xxhash64(text).alias("h"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            (F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1).cast("long").alias("tokens"),
            F.crc32(text.cast("binary")).alias("crc"),
        )
    )
    groups = rows.groupBy("h").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r"))
    tb, tt, tr = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    tb, tt, tr = tb or 1, tt or 1, tr or 1
    share = F.greatest(F.col("b") / tb, F.col("t") / tt, F.col("r") / tr)
    # at most 3 / LARGE rows can exceed the share, each of three totals being 1
    large = groups.select("h", share.alias("share")).where(F.col("share") > LARGE).orderBy("h").collect()
    pieces, first = [], BINS
    for g in large:
        n = int(np.ceil(g.share / PIECE))
        pieces.append((g.h, first, n))
        first += n
    large_df = spark.createDataFrame(pieces, T.StructType.fromDDL("h long, first int, n int"))
    units = rows.join(F.broadcast(large_df), "h", "left").select(
        "id", "size", "crc", "tokens",
        F.when(F.col("first").isNull(), F.pmod("h", F.lit(BINS)))
        .otherwise(F.col("first") + F.pmod(F.xxhash64("id", F.lit(5)), F.col("n")))
        .cast("int").alias("bin"),
    )
    sums = units.groupBy("bin").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r"))
    bins = sorted(tuple(x) for x in sums.collect())
    whole = {}  # parts of a large group -> the first part of their unit
    for g, (_, at, n) in zip(large, pieces, strict=True):
        units_of = int(np.ceil(g.share * n_shards))
        for k in range(n):
            whole[at + k] = at + -(-(k * units_of // n) * n // units_of)
    unit = [whole.get(x[0], x[0]) for x in bins]
    names = sorted(set(unit))
    where = {u: k for k, u in enumerate(names)}
    vectors = np.zeros((len(names), 3))
    for u, x in zip(unit, bins, strict=True):
        vectors[where[u]] += x[1:]
    put = pack(vectors, n_shards, weights) if names else []
    placed, used = [], [0] * n_shards
    for u, x in zip(unit, bins, strict=True):
        s = int(put[where[u]])
        placed.append((x[0], s, used[s]))
        used[s] += x[3]
    place = spark.createDataFrame(placed, T.StructType.fromDDL("bin int, shard int, start long"))
    rank = Window.partitionBy("bin").orderBy(F.col("id").asc_nulls_last(), "size", "crc")
    return (
        units.join(F.broadcast(place), "bin")
        .withColumn("slot", F.col("start") + F.row_number().over(rank) - 1)
        .select(
            F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
            "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        )
    )
