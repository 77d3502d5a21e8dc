"""Helpers shared by the corpus operators: durable intermediates and components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a map that tells which keys surely do not occur; its 512 kB are broadcast.
MARKS = 1 << 22

#: Seconds between two collections of the driver's garbage at least.
BRIEF = 4.0

_LOCAL: dict[str, str] = {}
_LAST: dict[str, float] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or the one set on the context.

    Only a local session without either gets a temporary folder of its own; on
    a cluster that would be invisible to the executors, so it is an error there.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="foliant-")
    return _LOCAL["dir"]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends at the written files, so a lost executor costs one re-read
    and not a re-run, and several consumers share one computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(*frames: DataFrame) -> None:
    """Delete the files behind frames that :func:`cut` returned, once nothing reads them."""
    for df in frames:
        spark = df.sparkSession
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/cut-" in parent:
                path = spark._jvm.org.apache.hadoop.fs.Path(parent)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now.

    They stay until the driver happens to collect its garbage, which may be
    never on a large heap; what has been cut does not need them any more.  Steps
    that took less than ``BRIEF`` seconds leave little and wait for the next call.
    """
    if time.monotonic() - _LAST.get("release", -BRIEF) < BRIEF:
        return
    for _ in range(2):  # what the first pass finds holds more
        gc.collect()  # Python's frames hold those of the JVM, and one another in cycles
        spark._jvm.System.gc()
    _LAST["release"] = time.monotonic()


def _mark(*keys: str) -> Column:
    return F.xxhash64(*keys).bitwiseAND(F.lit(MARKS - 1))


def marks(rows: DataFrame, *keys: str) -> DataFrame:
    """A map of ``MARKS`` bits of the hashes of ``keys``, in 128 rows of 4 kB at most, whatever the input."""
    return rows.select(_mark(*keys).alias("_mark")).groupBy(F.shiftright("_mark", 15).alias("_part")).agg(
        F.bitmap_construct_agg(F.col("_mark").bitwiseAND(F.lit((1 << 15) - 1))).alias("_bits")
    )


def marked(rows: DataFrame, bits: DataFrame, *keys: str) -> DataFrame:
    """The rows whose ``keys`` may be among those that :func:`marks` saw: all of these, and a few more."""
    at = F.col("_mark").bitwiseAND(F.lit((1 << 15) - 1)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    own = rows.withColumn("_mark", _mark(*keys)).withColumn("_part", F.shiftright("_mark", 15))
    return own.join(F.broadcast(bits), "_part").where(F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1).select(*rows.columns)


def _digest(edges: DataFrame):
    """Number and order-free hash of the edges."""
    return edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: ``node, component`` (smallest node).

    Alternates large-star and small-star steps until no edge moves, so long
    chains finish in a logarithmic number of rounds.  Each step keeps one
    partial minimum per node before the shuffle and joins it from written
    files, which lets adaptive execution split the edges of a hub.  Edges with
    a null end and self loops are ignored; repeated edges count once; nodes
    without an edge are not returned.
    """
    cur = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    before = _digest(cur)
    while True:
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large-star: link every larger neighbour to the smallest one
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        star = cut(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # small-star: link every smaller neighbour, and the node itself, to the smallest one
        low2 = cut(star.groupBy("u").agg(F.min("v").alias("m")))
        moved = star.join(low2, "u")
        new = cut(
            moved.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(moved.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = _digest(new)
        for old in (low, star, low2, cur):
            drop_cut(old)
        cur = new
        if after == before:
            break
        before = after
    root = cur.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(root)
