"""Near-duplicates by consistent weighted sampling of TF-IDF shingles."""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm._common import components, cut, drop_cut, marked, marks, release
from foliant.llm.shingles import Shingler, mix

#: A signature has BANDS bands of ROWS samples.  At a similarity of 0.8 a pair misses all bands with probability 0.002.
BANDS, ROWS = 12, 4
#: Document frequencies are told apart down to 1 / 2 ** LEVELS of the documents.
LEVELS = 6
#: The rarest shingles weigh 1 + DAMPING, those of most documents 1.
DAMPING = 0.25
#: Counters of document frequencies by hash.
COUNTERS = 1 << 19
#: Rows in which a task sends its counters.
PARTS = 64
#: Triples (r, c, beta) of the sampling table.
TRIPLES = 1 << 16
#: Elements that are sampled at a time.
CHUNK = 1 << 14
#: Leaders are tried while at least this share of a round's pairs links; what is left is compared across components.
FRUITFUL = 0.05
#: Bits of each of a document's two maps of its shingles, one for those of the highest level.
BITS = 512
#: Members of a group that a task compares with those outside its main component.
SALTED = 512
#: Logarithm of the ratio between the weights of two classes of texts.
STEP = math.log(1 / 0.9)

_STEP = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)


def idf(level: np.ndarray) -> np.ndarray:
    """Weight of a shingle by its level, floor(log2(documents / frequency)), at most LEVELS.

    It is damped so that in a large group of near copies, whose common
    shingles are frequent, single edits do not outweigh the common text.
    """
    return 1 + DAMPING * level / LEVELS


class _Weights:
    """Weights of the shingles of a text: occurrences times damped inverse document frequency."""

    def __init__(self, levels: np.ndarray):
        self.idf = idf(levels)

    def __call__(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts * self.idf[(hashes % np.uint64(COUNTERS)).astype(np.int64)]


class _Sampler:
    """Improved consistent weighted sampling.

    For each sample an element of weight w draws r, c ~ Gamma(2, 1) and
    beta ~ U(0, 1) by its hash, from a table of TRIPLES triples; with
    t = floor(ln w / r + beta) and ln y = r (t - beta), the element of least
    ln c - ln y - r is the sample, which two documents share with the
    probability of their weighted Jaccard similarity.  Its 64 bits hold that
    value and the element, so t, on which the value depends, is told apart too.
    """

    def __init__(self):
        rng = np.random.default_rng(20240229)
        self.r, self.c = rng.gamma(2, 1, TRIPLES), rng.gamma(2, 1, TRIPLES)
        self.beta = rng.random(TRIPLES)
        self.kinds = np.zeros(0)
        self.table = np.zeros((0, TRIPLES), dtype=np.uint64)

    def _column(self, w: float) -> np.ndarray:
        t = np.floor(np.log(w) / self.r + self.beta)
        value = (np.log(self.c) - self.r * (t - self.beta) - self.r).astype(np.float32)
        bits = value.view(np.uint32)
        order = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))  # unsigned order of the floats
        return order.astype(np.uint64) << np.uint64(32)

    def _rows(self, weights: np.ndarray) -> np.ndarray:
        """Place in the table of the first triple of each weight."""
        at = np.searchsorted(self.kinds, weights)
        if not len(self.kinds) or (self.kinds[np.minimum(at, len(self.kinds) - 1)] != weights).any():
            kinds = np.unique(weights)
            if len(self.kinds) > 200:
                self.kinds, self.table = self.kinds[:0], self.table[:0]
            new = np.setdiff1d(kinds, self.kinds)
            both = np.concatenate([self.kinds, new])
            order = np.argsort(both)
            self.kinds, self.table = both[order], np.concatenate([self.table, [self._column(w) for w in new]])[order]
            at = np.searchsorted(self.kinds, weights)
        return at.astype(np.uint64) * np.uint64(TRIPLES)

    def __call__(self, hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Samples as 32-bit fingerprints, a row for each document; ``starts`` are its first elements."""
        base = self._rows(weights)
        table = self.table.ravel()
        out = np.empty((len(starts), BANDS * ROWS), dtype=np.uint64)
        x, y, keys = (np.empty_like(hashes) for _ in range(3))  # written over and over
        for k, step in enumerate(_STEP):
            np.multiply(hashes, step, out=x)
            np.right_shift(x, np.uint64(29), out=y)
            np.bitwise_xor(x, y, out=x)
            np.right_shift(x, np.uint64(48), out=y)
            np.add(y, base, out=y)
            np.take(table, y.view(np.int64), out=keys, mode="clip")
            np.bitwise_and(x, np.uint64(0xFFFFFFFF), out=x)
            np.bitwise_or(keys, x, out=keys)
            out[:, k] = np.minimum.reduceat(keys, starts)
        return (mix(out) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _maps(hashes: np.ndarray, rare: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Maps of the shingles of each document as 64-bit numbers, first that of the rare ones.

    A bit tells whether an odd number of shingles has its hash, so each bit in
    which two maps differ stands for a shingle of one document only.
    """
    of = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(hashes)))
    at = (of * 2 + ~rare) * BITS + (hashes >> np.uint64(40)).astype(np.int64) % BITS
    odd = np.bincount(at, minlength=len(starts) * 2 * BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of the partition have a shingle for each counter's hash, packed in ``PARTS`` rows."""
    shingles, n = Shingler(), np.zeros(COUNTERS, dtype=np.int64)
    held, size = [], 0
    for b in batches:
        for text in b.column(0):
            h, _ = shingles(text.as_py() or "")
            held.append((h % np.uint64(COUNTERS)).astype(np.int32))
            size += len(h)
            if size >= COUNTERS:
                n += np.bincount(np.concatenate(held), minlength=COUNTERS)
                held, size = [], 0
    if held:
        n += np.bincount(np.concatenate(held), minlength=COUNTERS)
    packed = [zlib.compress(np.ascontiguousarray(part.view(np.uint8).reshape(-1, 4).T), 1) for part in np.split(n.astype("<u4"), PARTS)]
    yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(packed, pa.binary())], names=["part", "counts"])


def _sums(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    """Sums of the packed counters of each part; a task holds those of its parts only."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1)
            sums[part] = sums.get(part, 0) + np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    return sums


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters and their sums, a row for each."""
    for part, n in _sums(batches).items():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)) + part * len(n), pa.int32()), pa.array(n)], names=["k", "n"])


def shingle_levels(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Level of document frequency for each counter, over all documents.

    A counter holds the documents that have a shingle of its hash, so it is the
    frequency of a frequent shingle plus that of the few that share its place.
    A task sends its counters packed, a part for each of ``PARTS`` sums, so what
    is shuffled follows the number of tasks by a megabyte each at most.  Only
    counters of at least 1 / 2 ** LEVELS of the documents reach the driver,
    ``COUNTERS`` of them at most.
    """
    total = docs.count()
    levels = np.full(COUNTERS, LEVELS, dtype=np.int64)
    packed = docs.select(F.col(text_col).alias("text")).mapInArrow(_counters, "part int, counts binary")
    counted = packed.repartition(PARTS, "part").mapInArrow(_summed, "k int, n long")
    for k, n in counted.where((F.col("n") > 0) & (F.col("n") >= total / 2**LEVELS)).collect():
        levels[k] = min(LEVELS, max(0, int(np.floor(np.log2(total / n)))))
    return levels


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Eight times the binary logarithm of the sums, a byte for each counter, a row for each part; 0 stands for one document at most."""
    for part, n in _sums(batches).items():
        order = np.ceil(8 * np.log2(np.maximum(n, 1))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([order.tobytes()], pa.binary())], names=["part", "order"])


def shingle_order(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How frequent the shingles of each counter are among ``docs``, in ``PARTS`` rows of 8 kB whatever the input."""
    order = np.zeros((PARTS, COUNTERS // PARTS), dtype=np.uint8)
    packed = docs.select(F.col(text_col).alias("text")).mapInArrow(_counters, "part int, counts binary")
    for part, own in packed.repartition(PARTS, "part").mapInArrow(_ordered, "part int, order binary").collect():
        order[part] = np.frombuffer(own, dtype=np.uint8)
    return order.ravel()


def _signatures(levels, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, weigh, sample = Shingler(), _Weights(levels.value), _Sampler()
        for b in batches:
            held, size = [], 0
            for k, text in enumerate(b.column(2)):
                h, n = shingles(text.as_py() or "")
                if len(h):
                    held.append((k, h, weigh(h, n)))
                    size += len(h)
                if held and (size >= CHUNK or k == b.num_rows - 1):
                    rows = pa.array([x[0] for x in held])
                    starts = np.cumsum([0, *(len(x[1]) for x in held[:-1])])
                    hashes = np.concatenate([x[1] for x in held])
                    sig = sample(hashes, np.concatenate([x[2] for x in held]), starts)
                    ends = np.arange(len(held) + 1, dtype=np.int32) * np.int32(BANDS * ROWS)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(rows), b.column(1).take(rows), pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.ravel()))],
                        names=["id", "key", "sig"],
                    )
                    held, size = [], 0

    return run


def _similar(levels):
    """Weighted Jaccard similarity of the two texts of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, weigh = Shingler(), _Weights(levels.value)
        last, own = None, None
        for b in batches:
            likeness = []
            for a, s, t in zip(b.column("a"), b.column("text_a"), b.column("text_b"), strict=True):
                if last != a:
                    h, n = shingles(s.as_py())
                    last, own = a, (h, weigh(h, n))
                h, n = shingles(t.as_py())
                w = weigh(h, n)
                at = np.minimum(np.searchsorted(own[0], h), len(own[0]) - 1)
                both = np.where(own[0][at] == h, np.minimum(own[1][at], w), 0.0).sum()
                likeness.append(both / (own[1].sum() + w.sum() - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(likeness, pa.float64())], names=["a", "b", "likeness"])

    return run


def _prefixes(levels, order, threshold: float):
    """The shingles of which two similar texts share one, ``node, component, weight, token, reach, map``.

    A text's shingles are ordered, those of few documents first.  From the first
    shingle on that two texts share, ``rest`` of their weights is left, and the
    smaller rest is the most that they can have in common.  So the other text
    weighs ``reach`` at most, which must be ``threshold`` of the own weight at least.
    The first row of a text has its maps (see :func:`_maps`), the others none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, weigh = Shingler(), _Weights(levels.value)
        for b in batches:
            of, weights, tokens, reaches, maps = [], [], [], [], []
            for k, text in enumerate(b.column("text")):
                h, n = shingles(text.as_py())
                often = order.value[(h % np.uint64(COUNTERS)).astype(np.int64)]
                by = np.lexsort((h, often))
                w = weigh(h, n)[by]
                whole, rest = w.sum(), np.cumsum(w[::-1])[::-1]
                reach = rest * (1 + threshold) / threshold - whole * (1 - 1e-6)
                used = (reach >= threshold * whole) & (often[by] > 0)  # what one document has is shared by none
                if not used.any():
                    continue
                rare = levels.value[(h % np.uint64(COUNTERS)).astype(np.int64)] == LEVELS
                maps += [_maps(h, rare, np.array([0])), *[None] * (used.sum() - 1)]
                of.append(np.full(used.sum(), k))
                weights.append(np.full(used.sum(), whole))
                tokens.append(h[by][used].view(np.int64))
                reaches.append(reach[used])
            if of:
                rows = pa.array(np.concatenate(of).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [b.column("node").take(rows), b.column("component").take(rows), *(pa.array(np.concatenate(x)) for x in (weights, tokens, reaches)), pa.array(maps, pa.list_(pa.int64()))],
                    names=["node", "component", "weight", "token", "reach", "map"],
                )

    return run


def _close(a: str, b: str, threshold: float) -> Column:
    """Whether two texts can be similar by their maps, which differ (see :func:`_maps`) in so few bits that the shingles of only one of them can weigh little enough."""
    bits = lambda k: F.bit_count(F.col(f"{a}.map")[k].bitwiseXOR(F.col(f"{b}.map")[k]))
    rare, rest = (reduce(add, [bits(k) for k in range(i, i + BITS // 64)]) for i in (0, BITS // 64))
    apart = rare * (1 + DAMPING) + rest  # the other shingles weigh 1 at least
    return apart * (1 + threshold) <= (1 - threshold) * (F.col(f"{a}.weight") + F.col(f"{b}.weight")) + 1e-6


def _across(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` that no link connects yet and that can be similar, each once, and their components ``ca, cb``.

    ``members`` are the rows of :func:`_prefixes`.  Two similar texts meet at the
    first shingle that they share, each within the reach of the other.  Texts are
    classed by weight, and a row goes only to the classes within its reach, so texts
    that have too much of their own are not even grouped with one another, however
    many share the rest.  Shingles of one component only are left out.  In each group
    those outside its main component meet all that are in another one, and their maps
    are looked at as they meet: near copies that have lost different parts of one text
    share its beginning, but are no pair.  Nothing is left out but what cannot reach the threshold.
    """
    class_of = lambda w: F.floor(F.log(w) / STEP).cast("int")
    members = cut(members)
    shared = members.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("token")
    rows = members.join(shared, "token").withColumn("own", class_of(F.col("weight"))).withColumn(
        "other", F.explode(F.sequence(class_of(F.col("weight") * (threshold - 1e-6)), class_of(F.col("reach"))))
    )
    key = F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))
    rows = cut(rows.select(key.alias("key"), "node", "component", "weight", "reach", "own", "other"))
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = (
        parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max_by("component", F.struct("n", "component")).alias("main"))
        .where("parts > 1").select("key", "main", F.ceil(F.col("n") / SALTED).cast("int").alias("salts"))
    )
    inside = cut(rows.join(mixed, "key").join(members.where("map is not null").select("node", "map"), "node"))
    x = inside.where("component != main").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("x")
    y = inside.withColumn("salt", F.pmod(F.xxhash64("node", "key"), "salts").cast("int")).alias("y")
    near = (
        (F.col("x.key") == F.col("y.key")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.own") == F.col("y.other")) & (F.col("x.other") == F.col("y.own"))
        & (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
        & (F.col("x.weight") <= F.col("y.reach")) & (F.col("y.weight") <= F.col("x.reach")) & _close("x", "y", threshold)
    )
    turned = F.col("x.node") > F.col("y.node")
    end = lambda c, k: F.when(turned == k, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}"))
    pairs = cut(x.join(y, near).select(end("node", True).alias("a"), end("node", False).alias("b"), end("component", True).alias("ca"), end("component", False).alias("cb")).distinct())
    drop_cut(members, rows, inside)
    return pairs


def _sampled(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The ``pairs`` with ``same``, how many samples the two share."""
    of = lambda end: sigs.select(F.col("node").alias(end), F.col("sig").alias(f"sig_{end}"))
    same = reduce(add, [(F.col("sig_a")[k] == F.col("sig_b")[k]).cast("int") for k in range(BANDS * ROWS)])
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ca", "cb", same.alias("same"))


def _merged(comp: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``comp`` (node, component) with the components that ``links`` (a, b) touch made one, and the ``root`` of each such component."""
    if links.isEmpty():
        return comp, None
    of = lambda end: comp.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    roots = cut(components(ends)).select(F.col("node").alias("component"), F.col("component").alias("root"))
    alone = roots.select(F.col("component").alias("node"), "component").join(comp, "node", "left_anti")
    both = comp.unionByName(alone).join(roots, "component", "left")
    return cut(both.select("node", F.coalesce("root", "component").alias("component"))), roots


def near_dedup(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, class_id, class_size, kept``.

    Documents link when the weighted Jaccard similarity of their five-word
    shingles is ``threshold`` or more; a class is a connected component and
    ``class_id`` the smallest id in it, which stays.  Equal texts are sampled
    and compared once.  The members of a bucket are verified against one leader
    (the smallest id in even bands, the largest in odd ones), never all against
    all; those not similar to it are dealt anew by one more sample and get
    leaders of their own, until no bucket holds two or a round finds few links.
    That settles most members at a cost that follows their number.  Then the
    members of buckets that still hold several components are joined by the
    prefixes of their shingles, rarest first, which misses no similar pair; components
    are compared first by the pair that shares most samples, and where that does not
    join them by all pairs.  So two documents that share a bucket of any band are in
    one class, are compared, or are excluded by an exact bound.

    A null or empty text, or one without words, is like no other and stays.  So
    does a row with a null id: it takes no part, its ``class_id`` is null and its
    ``class_size`` 1.  An id stands for one document: rows
    that repeat it share a class.  An empty table gives an empty result; other
    columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    levels = spark.sparkContext.broadcast(shingle_levels(rows).astype(np.uint8))
    name = kind.simpleString()
    signed = cut(rows.mapInArrow(_signatures(levels, to_arrow_type(kind)), f"id {name}, key string, sig array<int>"))
    nodes = cut(signed.groupBy("key").agg(F.min("id").alias("node")))
    member = signed.select("id", "key").join(nodes, "key").select("id", "node").distinct()
    sigs = cut(signed.join(nodes, "key").where("id = node").select("node", "sig").dropDuplicates(["node"]))

    buckets = F.array(*[F.xxhash64(F.lit(k), *[F.col("sig")[k * ROWS + r] for r in range(ROWS)]) for k in range(BANDS)])
    dealt = sigs.select("node", F.posexplode(buckets).alias("band", "bucket")).select((F.col("band") % 2).alias("odd"), "bucket", "node")
    verify, linked = _similar(levels), F.col("likeness") >= threshold - 1e-9
    seen = edges = first = used = None
    turn = 0
    release(spark)

    def compared(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
        texts = marked(used, marks(ends, "node"), "node")  # those of no pair go before the shuffle
        return cut(
            pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
            .mapInArrow(verify, f"a {name}, b {name}, likeness double")
        )

    def more(old: DataFrame | None, new: DataFrame) -> DataFrame:
        if old is None:
            return cut(new)
        both = cut(old.unionByName(new))
        drop_cut(old)
        return both

    while True:
        lead = cut(
            dealt.groupBy("odd", "bucket").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"))
            .where("n > 1").select("odd", "bucket", F.when(F.col("odd") == 0, F.col("lo")).otherwise(F.col("hi")).alias("leader"))
        )
        if lead.isEmpty():
            break
        led = cut(
            dealt.join(lead, ["odd", "bucket"]).where("node != leader")
            .select("odd", "bucket", "node", F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
        )
        pairs = led.select("a", "b").distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        if used is None:  # texts of all documents that share a bucket; later rounds need no others
            involved = cut(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node").select(F.col("node").alias("id"), "key"))
            near = marked(rows, marks(involved, "id", "key"), "id", "key")
            used = cut(near.join(involved, ["id", "key"]).select(F.col("id").alias("node"), "text").dropDuplicates(["node"]))
            drop_cut(involved)
            release(spark)
        found = compared(pairs)
        if first is None:
            first = cut(led.select("odd", "bucket", "node").union(lead.select("odd", "bucket", "leader")))
        seen = more(seen, pairs)
        n_pairs, n_linked = found.agg(F.count("*"), F.count_if(linked)).first()
        edges = more(edges, found.where(linked).select("a", "b"))
        left = led.join(edges, ["a", "b"], "left_anti").select("odd", "bucket", "node")
        turn += 1
        again = F.xxhash64("bucket", F.col("sig")[(turn * 5 + 1) % (BANDS * ROWS)])
        dealt = cut(left.join(sigs, "node").select("odd", again.alias("bucket"), "node"))
        drop_cut(led, lead, pairs, found)
        release(spark)
        if n_linked < FRUITFUL * n_pairs:
            break
    out = member
    if edges is not None:
        comp = cut(components(edges))
        members = cut(first.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")))
        mixed = members.groupBy("odd", "bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
        inside = cut(members.join(mixed, ["odd", "bucket"]).select("node", "component").distinct())
        texts = cut(marked(used, marks(inside, "node"), "node").join(inside, "node"))
        order = spark.sparkContext.broadcast(shingle_order(texts))
        posts = texts.mapInArrow(_prefixes(levels, order, threshold), f"node {name}, component {name}, weight double, token long, reach double, map array<long>")
        pairs = cut(_sampled(_across(posts, threshold).join(seen, ["a", "b"], "left_anti"), sigs))
        drop_cut(members, inside, texts)
        release(spark)
        # one link joins two components, so first the pair of each component that shares most samples, then all pairs still apart
        ends = pairs.select("a", "b", "same", F.explode(F.array("ca", "cb")).alias("component"))
        best = cut(ends.groupBy("component").agg(F.max_by(F.struct("a", "b"), F.struct("same", "a", "b")).alias("p")).select("p.*").distinct())
        comp, roots = _merged(comp, cut(compared(best).where(linked)))
        rest = pairs.join(best, ["a", "b"], "left_anti")
        if roots is not None:
            of = lambda end: roots.select(F.col("component").alias(f"c{end}"), F.col("root").alias(f"r{end}"))
            rest = rest.join(of("a"), "ca", "left").join(of("b"), "cb", "left").where(F.coalesce("ra", "ca") != F.coalesce("rb", "cb"))
        rest = cut(rest.select("a", "b").distinct())
        drop_cut(pairs)
        release(spark)
        comp, _ = _merged(comp, cut(compared(rest).where(linked)))
        out = member.join(comp, "node", "left").select("id", F.coalesce("component", "node").alias("class_id"))
    else:
        out = member.select("id", F.col("node").alias("class_id"))
    # an id with several texts takes the smallest of their classes; texts without words have none
    out = cut(out.groupBy("id").agg(F.min("class_id").alias("class_id")))
    every = rows.select("id").join(out, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))
    sizes = cut(every.groupBy("class_id").agg(F.count("*").alias("class_size")))
    release(spark)
    whole = every.join(sizes, "class_id").select(
        F.col("id").alias(id_col), "class_id", "class_size", (F.col("id") == F.col("class_id")).alias("kept")
    )
    none = F.lit(None).cast(kind)
    nameless = docs.where(F.col(id_col).isNull()).select(none.alias(id_col), none.alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return whole.unionByName(nameless)


def keep_near(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one document of each class, with their columns unchanged; null ids stay."""
    own = f"gone_{uuid.uuid4().hex}"  # a name that no column of the input has
    gone = near_dedup(docs, threshold, id_col, text_col).where("not kept").select(F.col(id_col).alias(own)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(own), "left_anti")
