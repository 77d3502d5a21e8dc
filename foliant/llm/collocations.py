"""Phrase collocations by Toivonen's sampling: a sample proposes, full passes count exactly until closed.

A phrase can only be frequent if the phrases without its last and without its
first word are.  So what the full pass counts is all that have both parts in the
set of proposed phrases: the proposed ones and their negative border.  Where
border phrases prove frequent, an expansion pass counts every longer phrase that
holds one of them and whose other parts are known or of the same kind, to the
full length, and with that the result is closed.  The sample's phrases are found
length by length under a lower threshold.

Phrases travel as 96-bit keys, counted in blocks before the shuffle; the set of
known ones reaches the tasks as a bit map of bounded size, which may let a few
more phrases be counted but none less.  Each frequent phrase is then named once,
by the block that the counting has remembered for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm._common import cut, drop_cut, release
from foliant.llm.shingles import mix

#: Words in the longest phrase.
LONGEST = 5
#: A phrase is frequent from so many occurrences on.
LEAST = 100
#: One document of so many is in the sample; a phrase is proposed at this share of its expected count.
SAMPLE, LOWERED = 8, 0.5
#: Phrases of a language that are returned.
TOP = 2000
#: Words that a worker counts before it hands on.
BLOCK = 1_500_000
#: Numbers of blocks in a partition that are told apart.
PLACES = 64
#: Bits of the map of proposed phrases: so many for each, within these bounds (16 MB at most).
BITS_EACH, FEWEST_BITS, MOST_BITS = 16, 1 << 20, 1 << 27
#: Bits in a row of the map.
ROW_BITS = 1 << 15
#: A language's candidates are ranked in so many parts first.
PARTS = 64

UNKNOWN = "und"
# Characters that end a piece; both kinds of blank between words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_STOP = b"\xff"  # in no UTF-8 text
_PLAIN = bytes.maketrans(
    PIECE_ENDS + b"\t" + bytes(range(65, 91)), _STOP * len(PIECE_ENDS) + b" " + bytes(range(97, 123))
)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got


class _Block:
    """Words of some documents as numbers, languages as seeds of the keys."""

    def __init__(self):
        self.codes, self.parts, self.langs, self.size = _Codes({_STOP: 0}), [], [], 0

    def add(self, lang: str, text: str) -> None:
        data, begin = text.encode().translate(_PLAIN), 0
        while begin < len(data):  # a very long text in steps that end with a piece
            end = data.find(_STOP, begin + 8 * BLOCK) + 1 or len(data)
            words = data[begin:end].replace(_STOP, b" \xff ").split()
            words.append(_STOP)
            self.parts.append(np.fromiter(map(self.codes.__getitem__, words), dtype=np.int32, count=len(words)))
            self.langs.append(lang)
            self.size += len(words)
            begin = end

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of all words, 0 where a piece ends; the key of each as a phrase of one word; a second hash of it."""
        import xxhash

        each = np.array([xxhash.xxh3_64_intdigest(w) for w in self.codes], dtype=np.uint64)
        seeds = np.array([xxhash.xxh3_64_intdigest(x.encode(), 1) for x in self.langs], dtype=np.uint64)
        codes = np.concatenate(self.parts)
        own = each[codes]
        return codes, mix(own ^ np.repeat(seeds, [len(p) for p in self.parts])), own * _ODD


class _Map:
    """Whether a key may be in a set."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        def probe(at: np.ndarray) -> np.ndarray:
            return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

        out = probe(keys & self.mask)
        some = np.flatnonzero(out)
        out[some] = probe((keys[some] >> np.uint64(32)) & self.mask)
        return out


def _levels(block: _Block, known, before=None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By length: places, keys and second hashes of the phrases with both parts in ``known``, and whether a pass with ``before`` met them.

    After such a pass, those that it did not meet count as parts too, known or not.
    """
    codes, one, second = block.keys()
    at = np.flatnonzero(codes)
    keys, checks, met = one[at], second[at], np.full(len(at), before is not None)
    yield 1, at, keys, checks, met
    for k in range(2, LONGEST + 1):
        inside = known(keys)
        if before is not None:
            inside |= ~met
            met[met] = before(keys[met])
        at, keys, checks, met = at[inside], keys[inside], checks[inside], met[inside]
        near = np.flatnonzero(at[1:] == at[:-1] + 1)  # both parts are there and the pieces do not end between
        if not len(near):
            return
        met = met[near] & met[near + 1]
        at, last = at[near], at[near] + (k - 1)
        keys, checks = mix(keys[near] * _ODD + one[last] + np.uint64(k)), (checks[near] ^ (checks[near] >> np.uint64(29))) * _ODD + second[last]
        yield k, at, keys, checks, met


def _each_block(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """``work(block, place)`` for the blocks of a partition; the place is that of the partition and the block in it."""
    from pyspark import TaskContext

    block, place = _Block(), TaskContext.get().partitionId() * PLACES
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            block.add(lang.as_py(), text.as_py())
            if block.size >= BLOCK:
                yield from work(block, place)
                block, place = _Block(), place + 1  # a partition of more than PLACES blocks shares places, which names some phrases twice
        pa.default_memory_pool().release_unused()
    if block.parts:
        yield from work(block, place)


def _at(keys: np.ndarray, place: int) -> np.ndarray:
    """Keys of pairs of a phrase and a place; :func:`_pairs` in numpy."""
    return keys ^ np.uint64(place ^ place << 32)


def _pairs() -> Column:
    return F.col("key").bitwiseXOR(F.col("place")).bitwiseXOR(F.shiftleft("place", 32))


def _runs(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the phrases, and where each run of equal ones begins in it."""
    order = np.argsort(keys)
    k, c = keys[order], checks[order] >> np.uint64(32)
    return order, np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])) if len(k) else order


def _count(known, before):
    """Keys of phrases whose parts are in ``known``, less those that the pass with ``before`` met; with their counts and place."""

    def work(block: _Block, place: int) -> Iterator[pa.RecordBatch]:
        for _, _, keys, checks, met in _levels(block, known.value, before.value if before else None):
            if before:
                keys, checks = keys[~met], checks[~met]
            order, begins = _runs(keys, checks)
            lead, n = order[begins], np.diff(np.append(begins, len(order)))
            cols = keys[lead].view(np.int64), (checks[lead] >> np.uint64(32)).astype(np.uint32).view(np.int32), n, np.full(len(n), place, np.int64)
            for x in range(0, len(n), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[x : x + 200_000]) for c in cols], names=["key", "check", "n", "place"])

    return lambda batches: _each_block(batches, work)


def _name(wanted, schema: pa.Schema, everywhere: bool):
    """Language and words of the phrases in ``wanted``, at their place or everywhere; the empty phrase counts a language's words."""

    def work(block: _Block, place: int) -> Iterator[pa.RecordBatch]:
        words, known = list(block.codes), wanted.value
        codes = np.concatenate(block.parts)
        ends = np.cumsum([len(p) for p in block.parts])
        rows = []
        if not everywhere:
            total: dict[str, int] = {}
            for lang, part in zip(block.langs, block.parts, strict=True):
                total[lang] = total.get(lang, 0) + int(np.count_nonzero(part))
            rows = [(None, None, lang, "", n) for lang, n in total.items()]
        for k, at, keys, checks, _ in _levels(block, known[0]):
            inside = known[1](keys if everywhere else _at(keys, place))
            at, keys, checks = at[inside], keys[inside], checks[inside]
            order, begins = _runs(keys, checks)
            lead = order[begins]
            langs = np.searchsorted(ends, at[lead], side="right").tolist()
            marks = keys[lead].view(np.int64).tolist(), (checks[lead] >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist()
            for x, lang, key, check in zip(at[lead].tolist(), langs, *marks, strict=True):
                rows.append((key, check, block.langs[lang], b" ".join([words[c] for c in codes[x : x + k]]).decode(), None))
                if len(rows) == 100_000:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)

    def out(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return lambda batches: _each_block(batches, work)


def _map_of(keys: DataFrame) -> _Map:
    """The keys as a bit map; its bits follow their number up to ``MOST_BITS``."""
    size, bits = keys.count(), FEWEST_BITS
    while bits < min(BITS_EACH * size, MOST_BITS):
        bits *= 2
    own = np.zeros(bits // 8, np.uint8)
    if size:
        ats = F.array(F.col("key").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(bits - 1)))
        rows = (
            keys.select(F.explode(ats).alias("at")).groupBy(F.floor(F.col("at") / ROW_BITS).alias("row"))
            .agg(F.bitmap_construct_agg(F.col("at") % ROW_BITS).alias("bits"))
        )
        for row in rows.toLocalIterator():  # at most MOST_BITS / ROW_BITS rows of 4 kB
            begin = row["row"] * ROW_BITS // 8
            own[begin : begin + ROW_BITS // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)[: ROW_BITS // 8]
    return _Map(own)


def _frequent(rows: DataFrame, least: int, known, before=None) -> DataFrame:
    """``key, check, n, place`` of the phrases that one pass finds ``least`` times."""
    counts = rows.mapInArrow(_count(known, before), "key long, check int, n long, place long")
    out = cut(counts.groupBy("key", "check").agg(F.sum("n").alias("n"), F.min("place").alias("place")).where(F.col("n") >= least))
    release(rows.sparkSession)
    return out


def _proposed(sample: DataFrame, least: int) -> DataFrame:
    """``key`` of the phrases that occur ``least`` times in the sample, a pass for each length."""
    send = sample.sparkSession.sparkContext.broadcast
    known, before, size = cut(sample.select(F.lit(0).cast("long").alias("key")).limit(0)), None, 0
    for _ in range(LONGEST):
        current = send(_map_of(known))
        found = _frequent(sample, least, current)
        more = cut(known.unionByName(found.select("key")).distinct())
        drop_cut(known, found)
        known, grown = more, more.count()
        if grown == size:
            break
        size = grown
    return known


def phrase_counts(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, phrase, f``: phrases of one to ``LONGEST`` words that occur ``least`` times in their language, and how often.

    The empty phrase stands for all words of the language.  Texts are lower-cased
    in A-Z, split into pieces at stops and line ends, and those into words at
    blanks; phrases do not reach over the end of a piece.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    send = docs.sparkSession.sparkContext.broadcast
    own = [F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    rows = docs.select(*own)
    chosen = F.pmod(F.xxhash64(*[c for c in docs.columns if c in ("doc_id", lang_col, text_col)]), F.lit(SAMPLE)) == 0
    sample = cut(docs.where(chosen).select(*own))
    proposed = _proposed(sample, max(1, int(least / SAMPLE * LOWERED)))
    first = send(_map_of(proposed))
    found = _frequent(rows, least, first)
    failed = cut(found.join(proposed, "key", "left_anti").select("key"))
    if failed.count():
        second = send(_map_of(proposed.unionByName(failed)))
        more = _frequent(rows, least, second, first)
        both = cut(found.unionByName(more).groupBy("key", "check").agg(F.max("n").alias("n"), F.min("place").alias("place")))
        drop_cut(found, more)
        found = both
    drop_cut(sample, proposed, failed)

    schema = T.StructType.fromDDL("key long, check int, lang string, phrase string, n long")
    at_home = found.select(_pairs().alias("key"))
    known = _map_of(found)
    named = cut(rows.mapInArrow(_name(send((known, _map_of(at_home))), to_arrow_schema(schema), False), schema))
    lost = cut(found.join(named, ["key", "check"], "left_anti").select("key"))
    names = named.where("key is not null")
    if lost.count():  # the input was not dealt as before, so these are named wherever they occur
        names = names.unionByName(rows.mapInArrow(_name(send((known, _map_of(lost))), to_arrow_schema(schema), True), schema))
    each = names.groupBy("key", "check").agg(F.min(F.struct("lang", "phrase")).alias("p"))
    totals = named.where("key is null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    return found.join(each, ["key", "check"]).select("p.lang", "p.phrase", F.col("n").alias("f")).unionByName(totals)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Candidates are phrases of two words or more with ``a >= least``.  A cut in
    two gives the counts ``l`` and ``r`` of its parts and the score
    floor(1000 a n / (l r)); the lowest cut counts, the earliest of equals.  A
    candidate that a longer one of the same count contains is dropped.  Ranks go
    by falling score, then falling ``a``, then the bytes of the phrase.

    A null text counts as empty, a null language as ``und``.  Null and repeated
    ids matter nothing; rows that repeat count each; an empty table gives an
    empty result; other columns are ignored.
    """
    counts = cut(phrase_counts(docs, least, text_col, lang_col))
    words = F.split("phrase", " ")
    some = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    all_of = cut(counts.where("phrase = ''").select("lang", F.col("f").alias("n")))
    cands = counts.where("phrase <> ''").select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), F.size(words).alias("k")).where("k > 1")
    # a longer phrase of the same count contains one of the same count that is one word longer
    longer = cands.where("k > 2").select("lang", F.explode(F.array(some(F.lit(1), F.col("k") - 1), some(F.lit(2), F.col("k") - 1))).alias("phrase"), F.col("a").alias("f"))
    kept = cands.join(longer.groupBy("lang", "phrase").agg(F.max("f").alias("f")), ["lang", "phrase"], "left").where(F.col("f").isNull() | (F.col("f") < F.col("a")))
    cuts = kept.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cuts = cuts.select("lang", "phrase", "a", "at", some(F.lit(1), F.col("at")).alias("first"), some(F.col("at") + 1, F.col("k") - F.col("at")).alias("rest"))
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(all_of, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    both = both.withColumn("top", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).withColumn("bottom", wide("l") * wide("r"))
    scored = both.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("top div bottom").alias("score"), "at", "l", "r")).alias("c"))
    rows = scored.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part_of = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    best = rows.withColumn("part", part_of).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle() -> str:
    """The same question in DuckDB's SQL."""
    return f"""
        WITH p AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents),
          w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM p),
          t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
          g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
            FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS k FROM w) WHERE len(w) >= k)),
          f AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
          c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
          d AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN (SELECT lang, f, k, string_split(phrase, ' ') AS w, phrase FROM f) x
            ON x.lang = c.lang AND x.k > c.k AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * x.f >= 100 * c.a),
          s AS (SELECT lang, phrase, a, array_to_string(w[1:i], ' ') AS x, array_to_string(w[i + 1:k], ' ') AS y, i
            FROM (SELECT *, unnest(range(1, k)) AS i FROM c ANTI JOIN d USING (lang, phrase))),
          q AS (SELECT s.lang, s.phrase, s.a, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * s.a * t.n // (l.f::HUGEINT * r.f))::BIGINT AS score, s.i
            FROM s JOIN f l ON l.lang = s.lang AND l.phrase = s.x JOIN f r ON r.lang = s.lang AND r.phrase = s.y JOIN t ON t.lang = s.lang),
          b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM b QUALIFY rank <= {TOP}"""
