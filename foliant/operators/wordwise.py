"""Words that are looked up in a table and put back where they stood.

A text is a sequence of pieces whose concatenation it is.  A row asks about some
of its pieces by place; the questions alone are shuffled, the answers return by
row and place, and the text is put together again with its separators.  Rows are
told apart by a digest of what the answer depends on, so rows that repeat share
their answers and no row number is needed.

A table of few rows goes to every task instead, which rewrites its texts alone:
nothing is shuffled, and a text is read once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from foliant.functions.unicode import AR, TASHKEEL
from foliant.operators.lexicon import spell_check

#: A table of at most so many rows goes to every task; a larger one is joined by shuffling, after a map of its terms.
SMALL = 50_000
#: Decisions that a task remembers.
KNOWN = 1 << 19
#: Bits of that map, 512 kB.
BITS = 1 << 22
_ROW = 1 << 15

LETTERS = f"[{AR}A-Za-z]"
#: White space as Java's [\\s\\p{Z}], for a class in Python.
WHITE = " \t\n\x0b\f\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES, _RUNS = re.compile(f"([{WHITE}]+)"), re.compile(f"([{AR}A-Za-z]+)")


def held(table: DataFrame) -> list[Row] | None:
    """The rows of a table if it is small."""
    rows = table.limit(SMALL + 1).collect()
    return rows if len(rows) <= SMALL else None


class Decided(dict):
    """What becomes of a word, decided when it is first met; forgotten when there are many."""

    def __init__(self, decide: Callable):
        super().__init__()
        self.decide = decide

    def __missing__(self, word):
        if len(self) >= KNOWN:
            self.clear()
        self[word] = out = self.decide(word)
        return out


def only_words(text: str) -> list[str]:
    """The words of :func:`words_of` that are not empty."""
    # Python's own white space is that and these five signs
    return [w for w in words_of(text)[::2] if w] if any(c in text for c in "\x1c\x1d\x1e\x1f\x85") else text.split()


def words_of(text: str) -> list[str]:
    """Words at even places, the white space between them at odd ones; the first and the last word may be empty."""
    return _SPACES.split(text)


def counted(docs: DataFrame, make: Callable, counts: list[str], text_col: str = "text") -> DataFrame:
    """``docs`` with ``counts`` as ``make()`` says of their texts instead of these; 0 for a null text."""
    made: dict[str, Callable] = {}
    names = [f"n{k}" for k in range(len(counts))]

    @F.arrow_udf(", ".join(f"{n} int" for n in names))
    def count(texts: pa.Array) -> pa.Array:
        if "of" not in made:
            made["of"] = make()
        rows = [(0,) * len(names) if x is None else made["of"](x) for x in texts.to_pylist()]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], names=names)

    out = f"_{uuid.uuid4().hex}"
    done = docs.withColumn(out, count.asNondeterministic()(F.col(text_col)))
    return done.select(*[c for c in docs.columns if c != text_col], *[F.col(f"{out}.{n}").alias(c) for n, c in zip(names, counts, strict=True)])


def rewritten(docs: DataFrame, make: Callable, counts: list[str], text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with texts and ``counts`` as ``make()`` says, a function of a text and the columns ``also`` that each task makes for its texts once.

    A null text stays null, with counts of 0.
    """
    names = [f"n{k}" for k in range(len(counts))]
    nothing = (None, *[0] * len(counts))

    @F.arrow_udf(", ".join(["text string", *[f"{n} int" for n in names]]))
    def change(texts: pa.Array, *more: pa.Array) -> pa.Array:
        if "to" not in made:
            made["to"] = make()
        to = made["to"]
        rows = [nothing if x[0] is None else to(*x) for x in zip(texts.to_pylist(), *[c.to_pylist() for c in more], strict=True)]
        columns = list(zip(*rows, strict=True)) or [()] * (1 + len(names))
        return pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int32()) for c in columns[1:]]], names=["text", *names])

    made: dict[str, Callable] = {}
    out = f"_{uuid.uuid4().hex}"
    done = docs.withColumn(out, change.asNondeterministic()(F.col(text_col), *[F.col(c) for c in also]))
    return done.select(*[F.col(f"{out}.text").alias(c) if c == text_col else F.col(c) for c in docs.columns], *[F.col(f"{out}.{n}").alias(c) for n, c in zip(names, counts, strict=True)])


def blank_pieces(text: Column) -> Column:
    """Words and the white space between them."""
    return F.regexp_extract_all(text, F.lit(r"[^\s\p{Z}]+|[\s\p{Z}]+"), F.lit(0))


def letter_pieces(text: Column) -> Column:
    """Runs of Arabic and Latin letters, and what stands between them."""
    return F.regexp_extract_all(text, F.lit(f"[{AR}A-Za-z]+|[^{AR}A-Za-z]+"), F.lit(0))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, also where ``use`` loops over it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def at_words(pieces: Column, ask) -> Column:
    """Questions ``(pos, n, term)``, n pieces being answered at once; ``ask(piece)`` is null where there is none."""
    each = F.transform(pieces, lambda p, i: F.struct(i.alias("pos"), F.lit(1).alias("n"), ask(p).alias("term")))
    return F.filter(each, lambda q: q["term"].isNotNull())


def _bit() -> Column:
    return F.xxhash64("term").bitwiseAND(F.lit(BITS - 1))


def _possible(asked: DataFrame, table: DataFrame) -> DataFrame:
    """The questions whose term the table may have."""
    row, at = F.floor(_bit() / _ROW), F.pmod(_bit(), F.lit(_ROW)).cast("int")
    bits = table.select(row.alias("_row"), (_bit() % _ROW).alias("_at")).groupBy("_row").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    kept = asked.join(F.broadcast(bits), row == F.col("_row")).where(F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1)  # at most 128 rows
    return kept.select(*asked.columns)


def answered(docs: DataFrame, questions: Column, table: DataFrame, depends: list[str], out: str) -> DataFrame:
    """``docs`` with the answers in ``out``: structs of ``pos, n`` and the columns of ``table`` but ``term``, by place, longest first.

    ``table`` holds each term once.  Up to ``SMALL`` rows it is broadcast.  A
    larger one meets only the questions that a map of its terms lets through, in
    a shuffle by term, whose hot terms adaptive execution splits.  ``questions``
    must follow from the columns ``depends``; no questions, no answers (null).
    """
    key = f"_{uuid.uuid4().hex}"
    # rows without questions meet nothing and are dealt evenly
    digest = F.sha2(F.to_json(F.struct(*depends)), 256)
    all_of = f"{key}q"
    own = docs.withColumn(all_of, questions).withColumn(key, F.when(F.size(all_of) > 0, digest).otherwise(F.concat(F.lit("-"), F.spark_partition_id())))
    asked = own.select(F.col(key).alias("_key"), F.explode(all_of).alias("_q")).select("_key", "_q.pos", "_q.n", "_q.term")
    if table.limit(SMALL + 1).count() <= SMALL:
        met = asked.join(F.broadcast(table), "term")
    else:
        met = _possible(asked, table).join(table, "term")
    fields = [c for c in table.columns if c != "term"]
    order = F.struct("pos", (-F.col("n")).alias("shorter"), *fields)
    replies = met.groupBy("_key").agg(F.array_sort(F.collect_set(order)).alias("_r"))
    replies = replies.select("_key", F.transform("_r", lambda r: F.struct(r["pos"].alias("pos"), (-r["shorter"]).alias("n"), *[r[c].alias(c) for c in fields])).alias(out))
    return own.join(replies, own[key] == replies["_key"], "left").select(*docs.columns, out)


def without_overlaps(answers: Column) -> Column:
    """Of answers in order, each that begins after the end of the last one kept: leftmost first, longest first."""
    start = F.struct(F.lit(0).alias("end"), F.filter(answers, lambda a: F.lit(False)).alias("kept"))
    step = lambda s, a: F.when(a["pos"] < s["end"], s).otherwise(F.struct((a["pos"] + a["n"]).alias("end"), F.concat(s["kept"], F.array(a)).alias("kept")))
    return F.aggregate(answers, start, step, lambda s: s["kept"])


def put_back(text: Column, pieces: Column, answers: Column, change) -> Column:
    """The text with ``change(piece, answer)`` in place of each answered piece; as it was where there are no answers."""

    def build(x: Column) -> Column:
        parts, found = x["p"], x["a"]
        n = F.size(found)
        end_of = lambda k: F.when(k == 0, 0).otherwise(F.get(found, k - 1)["pos"] + 1)
        next_of = lambda k: F.when(k == n, F.size(parts)).otherwise(F.get(found, k)["pos"])
        between = lambda k: F.array_join(F.slice(parts, end_of(k) + 1, next_of(k) - end_of(k)), "")
        new = lambda k: F.when(k == n, "").otherwise(change(F.get(parts, F.get(found, k)["pos"]), F.get(found, k)))
        return F.array_join(F.transform(F.sequence(F.lit(0), n), lambda k: F.concat(between(k), new(k))), "")

    return F.when(F.size(answers) > 0, bound(F.struct(pieces.alias("p"), answers.alias("a")), build)).otherwise(text)


def spelling(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``term, answer``: words that the lexicon writes otherwise; without vowel marks, or in the lexicon's case."""
    found = spell_check(words, lexicon).where("found and step > 1")
    bare = F.regexp_replace("word", TASHKEEL, "")
    return found.select(F.col("word").alias("term"), F.when(F.col("step") < 4, bare).otherwise(F.col("term")).alias("answer")).where("answer <> term")


def _speller(terms: list[str]) -> Callable:
    """:func:`spelling` of one word, and of the words of a text."""
    from foliant.operators.lexicon import ARTICLE

    known, lower, marks = set(terms), {}, re.compile(TASHKEEL)
    for t in sorted(known, reverse=True):
        if re.search("^[A-Za-z]+$", t):
            lower[t.lower()] = t  # the smallest stays

    def spell(word: str) -> str:
        if len(word) < 2 or word in known:
            return word
        bare = marks.sub("", word)
        if bare in known or (bare.startswith(ARTICLE) and len(bare) > 3 and bare[2:] in known):
            return bare
        return lower.get(word.lower(), word) if word.isascii() else word

    decided = Decided(spell)

    def change(text: str) -> tuple[str, int]:
        parts = _RUNS.split(text)
        words = parts[1::2]
        parts[1::2] = new = [decided[w] for w in words]
        n = sum(map(str.__ne__, words, new))
        return ("".join(parts) if n else text), n

    return change


def spell_check_text(docs: DataFrame, lexicon: DataFrame, text_col: str = "text", count_col: str | None = None, keep: Callable | None = None) -> DataFrame:
    """``docs`` with each word of its text written as in the lexicon, if that knows it; all else stays.

    Words are runs of Arabic and Latin letters of two or more.  Each distinct one
    is decided once.  A null text stays null; ``count_col`` gets the number of
    words changed.  ``keep`` is applied to documents that are read more than once.
    """
    from foliant.durable import written

    if (rows := held(lexicon.select("term").where("term is not null").distinct())) is not None:
        terms, n = [r.term for r in rows], count_col or f"_{uuid.uuid4().hex}"
        return rewritten(docs, lambda: _speller(terms), [n], text_col).select(*docs.columns, *([n] if count_col else []))
    docs = keep(docs) if keep else docs
    pieces = letter_pieces(F.col(text_col))
    questions = at_words(pieces, lambda p: F.when(p.rlike(f"^{LETTERS}{{2,}}$"), p))
    words = docs.select(F.explode(questions).alias("q")).select(F.col("q.term").alias("word")).distinct()
    words = written(words)  # read twice, and each reader would split all texts again
    out = f"_{uuid.uuid4().hex}"
    done = answered(docs, questions, written(spelling(words, lexicon)), [text_col], out)
    kept = [F.col(c) if c != text_col else put_back(F.col(text_col), pieces, F.col(out), lambda _, a: a["answer"]).alias(text_col) for c in docs.columns]
    return done.select(*kept, *([F.coalesce(F.size(out), F.lit(0)).alias(count_col)] if count_col else []))
