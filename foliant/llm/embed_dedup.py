"""Embedding near-duplicates by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm._common import components, cut, drop_cut

#: Leading principal dimensions that make the grid.
LEADING = 6
#: The sorted sequence is cut in blocks of so many rows, whatever its length.
BLOCK = 2048
#: An interval of the sequence has so many parts on the next level.
FAN = 8
#: Inside a pair of blocks the recursion stops at intervals of so many rows.
LEAF = 512
#: Products in single precision are settled in double precision within this distance of the threshold, for vectors of
#: up to some 800 components; for longer ones within what rounding of so many terms can make of it.
MARGIN, ROUNDING = 1e-4, 2.0**-23


def _raw(kind: pa.DataType, item: str):
    """Rows whose vector has only finite components and is not zero, as (id, dim, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, vec in zip(b.column(0), b.column(1), strict=True):
                if not vec.is_valid or vec.values.null_count or not len(vec.values):
                    continue
                v = vec.values.to_numpy(zero_copy_only=False).astype(item)
                if np.isfinite(v).all() and v.any():
                    out.append((x.as_py(), len(v), v.tobytes()))
            ids, dims, raws = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], names=["id", "dim", "vec"])

    return run


def _matrix(column, item: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=item).reshape(-1, dim).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # lest the squares leave the range of doubles
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _moments(item: str, dim: int):
    """Sums of the products of components over a partition, dim * dim rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                u = _unit(_matrix(b.column(0), item, dim))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(range(dim * dim), pa.int32()), pa.array(total.ravel())], names=["k", "v"])

    return run


def _project(item: str, dim: int, axes: np.ndarray, eps: float):
    """Coordinates on the leading axes, the length of the rest, and the grid cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u = _unit(_matrix(b.column("vec"), item, dim))
            p = u @ axes
            rest = np.sqrt(np.maximum(0, 1 - (p * p).sum(axis=1)))
            cells = np.floor(p / eps).astype(np.int32)
            flat = pa.array(np.column_stack([p, rest]).ravel())
            n = axes.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns,
                    pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * (n + 1)), flat),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * n), pa.array(cells.ravel())),
                ],
                names=[*b.schema.names, "at", "cell"],
            )

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with their index in it."""
    n = 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(n, n + b.num_rows), pa.int64())], names=[*b.schema.names, "idx"])
        n += b.num_rows


def interval_pairs(low: np.ndarray, high: np.ndarray, a: tuple[int, int], b: tuple[int, int], eps: float, leaf: int):
    """Pairs of intervals of a sorted sequence that may hold close points.

    ``low`` and ``high`` bound the coordinates of each element.  Two intervals
    whose boxes are over ``eps`` apart are skipped whole; others are halved
    until they have ``leaf`` elements.  For one interval with itself each pair
    comes once.
    """
    boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(i):
        if i not in boxes:
            boxes[i] = low[i[0] : i[1]].min(axis=0), high[i[0] : i[1]].max(axis=0)
        return boxes[i]

    todo = [(a, b)] if a[0] < a[1] and b[0] < b[1] else []
    while todo:
        x, y = todo.pop()
        if x != y:
            (la, ha), (lb, hb) = box(x), box(y)
            gap = np.maximum(0, np.maximum(la - hb, lb - ha))
            if gap @ gap > eps * eps * (1 + 1e-9) + 1e-12:
                continue
        nx, ny = x[1] - x[0], y[1] - y[0]
        if max(nx, ny) <= leaf:
            yield x, y
        elif x == y:
            m = (x[0] + x[1]) // 2
            todo += [((x[0], m), (x[0], m)), ((x[0], m), (m, x[1])), ((m, x[1]), (m, x[1]))]
        elif nx >= ny:
            m = (x[0] + x[1]) // 2
            todo += [((x[0], m), y), ((m, x[1]), y)]
        else:
            m = (y[0] + y[1]) // 2
            todo += [(x, (y[0], m)), (x, (m, y[1]))]


def _join(item: str, dim: int, eps: float, threshold: float):
    """Links between the rows of two blocks: per row its number and a link to the first row of its cluster."""
    margin = max(MARGIN, (dim + 4) * ROUNDING)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("pos", "ascending")])
        block, pos = table.column("block").to_numpy(), table.column("pos").to_numpy()
        n, u = table.column("n").to_numpy(), _unit(_matrix(table.column("vec"), item, dim))
        at = np.array(table.column("at").to_pylist())
        single = u.astype(np.float32)
        cutoff = int(np.searchsorted(block, block[0], side="right"))
        whole = (0, len(u))
        first, second = (whole, whole) if cutoff == len(u) else ((0, cutoff), (cutoff, len(u)))
        count, label = np.zeros(len(u), dtype=np.int64), np.arange(len(u))
        for x, y in interval_pairs(at, at, first, second, eps, LEAF):
            c = single[x[0] : x[1]] @ single[y[0] : y[1]].T
            i, j = np.nonzero(c >= threshold - margin)
            near = c[i, j] < threshold + margin
            i, j = i + x[0], j + y[0]
            if x == y:
                keep = i < j
                i, j, near = i[keep], j[keep], near[keep]
            if near.any():
                ok = ~near
                ok[near] = np.einsum("ij,ij->i", u[i[near]], u[j[near]]) >= threshold
                i, j = i[ok], j[ok]
            if not len(i):
                continue
            count += np.bincount(i, weights=n[j], minlength=len(u)).astype(np.int64)
            count += np.bincount(j, weights=n[i], minlength=len(u)).astype(np.int64)
            while True:
                a, b = label[i], label[j]
                open_ = a != b
                if not open_.any():
                    break
                a, b = a[open_], b[open_]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label[label] != label).any():
                    label = label[label]
        hit = count > 0
        return pa.table({"pos": pos[hit], "links": count[hit], "root": pos[label[hit]]})

    return run


def close_blocks(ordered: DataFrame, dims: int, blocks: int, eps: float) -> DataFrame:
    """``i, j`` (i <= j): pairs of blocks whose boxes are at most ``eps`` apart.

    Blocks are the leaves of a tree of intervals of ``FAN`` parts.  From the
    root down, pairs of close intervals are replaced by the pairs of their parts
    that are close, so a distant pair is dropped with all below it and no list
    of blocks passes the driver.
    """
    each, least = [f"l{d}" for d in range(dims)], [f"h{d}" for d in range(dims)]
    levels = [cut(ordered.groupBy("block").agg(
        *[F.min(F.col("at")[d]).alias(x) for d, x in enumerate(each)], *[F.max(F.col("at")[d]).alias(x) for d, x in enumerate(least)]
    ))]
    size = blocks
    while size > 1:
        size = -(-size // FAN)
        up = levels[-1].groupBy(F.floor(F.col("block") / FAN).alias("block"))
        levels.append(cut(up.agg(*[F.min(x).alias(x) for x in each], *[F.max(x).alias(x) for x in least])))
    pairs = levels.pop().select(F.col("block").alias("i"), F.col("block").alias("j"))  # the root
    gap = [F.greatest(F.lit(0.0), F.col(f"a.l{d}") - F.col(f"b.h{d}"), F.col(f"b.l{d}") - F.col(f"a.h{d}")) for d in range(dims)]
    apart = sum((g * g for g in gap), F.lit(0.0))
    parts = lambda x: F.explode(F.sequence(F.col(x) * FAN, F.col(x) * FAN + (FAN - 1)))
    for boxes in reversed(levels):
        finer = pairs.select(parts("i").alias("i"), "j").select("i", parts("j").alias("j")).where("i <= j")
        near = finer.join(boxes.alias("a"), F.col("i") == F.col("a.block")).join(boxes.alias("b"), F.col("j") == F.col("b.block"))
        coarse, pairs = pairs, cut(near.where((F.col("i") == F.col("j")) | (apart <= eps * eps * (1 + 1e-9) + 1e-12)).select("i", "j"))
        drop_cut(coarse, boxes)
    return pairs


def _linked(rows: DataFrame, item: str, dim: int, threshold: float, block: int) -> DataFrame:
    """Classes of equal vectors of one dimension: ``vec, n_links, component_id``."""
    spark = rows.sparkSession
    eps = float(np.sqrt(2 - 2 * threshold))
    classes = cut(rows.groupBy("vec").agg(F.count("*").alias("n"), F.min("id").alias("low")))
    sums = classes.select("vec").mapInArrow(_moments(item, dim), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    moment = np.zeros(dim * dim)
    for k, v in sums:
        moment[k] = v
    _, axes = np.linalg.eigh(moment.reshape(dim, dim))
    axes = axes[:, ::-1][:, : min(LEADING, dim)]
    placed = classes.mapInArrow(
        _project(item, dim, axes, eps), T.StructType([*classes.schema, T.StructField("at", T.ArrayType(T.DoubleType())), T.StructField("cell", T.ArrayType(T.IntegerType()))])
    ).orderBy("cell", F.xxhash64("vec"), "vec")
    placed = placed.withColumn("part", F.spark_partition_id())
    ordered = cut(placed.mapInArrow(_numbered, T.StructType([*placed.schema, T.StructField("idx", T.LongType())])))
    # one row for each partition of the sort
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
    total, starts = 0, []
    for part, n in sizes:
        starts.append((part, total))
        total += n
    begin = spark.createDataFrame(starts, "part int, start long")
    pos = F.col("start") + F.col("idx")
    by_part, ordered = ordered, cut(ordered.join(F.broadcast(begin), "part").select(
        pos.alias("pos"), F.floor(pos / block).alias("block"), "vec", "n", "low", "at"
    ))
    drop_cut(by_part)
    pairs = close_blocks(ordered, axes.shape[1] + 1, -(-total // block), eps)
    sides = pairs.select("i", "j", F.col("i").alias("block")).union(pairs.where("i != j").select("i", "j", F.col("j").alias("block")))
    links = cut(
        ordered.select("block", "pos", "n", "vec", "at").join(sides, "block")
        .groupBy("i", "j").applyInArrow(_join(item, dim, eps, threshold), "pos long, links long, root long")
    )
    counts = links.groupBy("pos").agg(F.sum("links").alias("links"))
    comp = cut(components(links.select(F.col("pos").alias("a"), F.col("root").alias("b"))))
    member = ordered.select("pos", "vec", "n", "low").join(counts, "pos", "left").join(comp.withColumnRenamed("node", "pos"), "pos", "left")
    member = cut(member.withColumn("component", F.coalesce("component", "pos")))
    lowest = cut(member.groupBy("component").agg(F.min("low").alias("component_id")))
    return member.join(lowest, "component").select(
        "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )


def embedding_dedup(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per input row: ``id_col, n_links, component_id, kept``.

    Two vectors link when their cosine in double precision is ``threshold`` or
    more.  Unit vectors are sorted by their cells of width epsilon (the distance
    at the threshold) on the leading principal dimensions; the sequence is cut
    in blocks of ``block`` rows, so that a task holds two of them whatever the
    input, and pairs of intervals of blocks, then of blocks, then of intervals in
    them, are skipped where their boxes are over epsilon apart.  All other pairs are compared, so the
    result is exact.  Equal vectors are compared once and counted as often as
    they occur.  A task returns a count and one link for each row, never pairs.

    Vectors that are null, empty, zero or hold a null, NaN or infinite component
    link with nothing; so do vectors of different length.  A null id takes part
    with a null ``component_id`` only if all ids of its component are null (it
    counts as a link), and is kept if so.  Repeated rows count as vectors of
    their own.  An empty table gives an empty result; other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = vectors.schema[id_col].dataType
    element = vectors.schema[vec_col].dataType.elementType
    item = "<f4" if isinstance(element, T.FloatType) else "<f8"
    plain = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>" if item == "<f4" else "array<double>").alias("vec"))
    rows = cut(plain.mapInArrow(_raw(to_arrow_type(kind), item), f"id {kind.simpleString()}, dim int, vec binary"))
    out = None
    for (dim,) in rows.select("dim").distinct().orderBy("dim").collect():
        own = rows.where(F.col("dim") == dim).select("id", "vec")
        got = own.join(_linked(own, item, dim, threshold, block), "vec").select("id", "n_links", "component_id")
        out = got if out is None else out.unionByName(got)
    v = F.col("vec")
    bad = v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: F.coalesce(x, F.lit(0)) != 0)
    alone = plain.where(bad).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = alone if out is None else out.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
