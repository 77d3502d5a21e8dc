"""Phrases of two to four words counted with little to shuffle and nothing to spill.

A phrase goes to the part that its first two words name: the longer of both,
so that neighbouring phrases mostly go together and travel as one stretch of
text, or both if they are short and so probably common.  Stretches are packed
and compressed before the shuffle; a part is small enough to be counted in
memory, whatever the input.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.unicode import TASHKEEL
from foliant.operators.corpus import LINE_ENDS

#: Words in a phrase.
MOST = 4
#: Bytes of input that a part stands for, and the most parts.
PART, PARTS = 1 << 20, 1 << 15
#: Words that a task deals at once, and places where a stretch begins a phrase.
DEALT, LONG = 1 << 19, 200
#: Words of so many letters go to parts by themselves.
RARE = 4
#: Stands for a missing number.
NONE = (1 << 63) - 1

_WORD = re.compile(r"\w+")  # letters, digits and underscores, as in functions.unicode
_BLANKS = re.compile("[^ \t\n\x0b\f\r\xa0  -     　]+")  # as Java's [^\s\p{Z}]
_ENDS, _MARKS = re.compile(LINE_ENDS), re.compile(TASHKEEL)
_PACKED = "p int, kind int, grp string, size int, data binary"

Unit = tuple[str | None, int | str, int, list[str]]


def parts_of(docs: DataFrame, text_col: str = "text") -> int:
    """Parts for a table of this size."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 50:  # not known
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, min(PARTS, size // PART))


def _words(text: str) -> list[str]:
    return _WORD.findall(text if text.isascii() else _MARKS.sub("", text))


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[Unit]:
    """The lines of documents (doc_id, text) that have two words or more."""
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for no, line in enumerate(_ENDS.split(text or "")):
                if len(words := _words(line)) > 1:
                    yield "", NONE if name is None else name, no, words


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[Unit]:
    """Whole texts (subject, source, text), their words between white space."""
    for batch in batches:
        for group, name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(words := _BLANKS.findall(text or "")) > 1:
                # a source that is no number stands as a text, a missing one as an empty one
                yield group, name if isinstance(name, int) else NONE if pa.types.is_integer(batch.schema.field(1).type) else "" if name is None else f"s{name}", 0, words


def _packed(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of ``(part, kind, group, what)``, what being compressed."""
    held, size = [], 0
    for p, kind, group, what in rows:
        raw = pickle.dumps(what, protocol=5)
        data = pa.compress(raw, codec="zstd", asbytes=True)
        held.append((int(p), kind, group, len(raw), data))
        size += len(data)
        if size > 1 << 23:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("p", pa.int32()), ("kind", pa.int32()), ("grp", pa.string()), ("size", pa.int32()), ("data", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """``(part, kind, group, what)`` of the rows of :func:`_packed`."""
    for batch in batches:
        for p, kind, group, size, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield p, kind, group, pickle.loads(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True))


def _together(rows: Iterable[tuple]) -> Iterator[tuple]:
    """``(part, group, all of its whats)`` of rows in order of part and group."""
    last, held = None, []
    for p, _, group, what in rows:
        if held and last != (p, group):
            yield *last, held
            held = []
        last = (p, group)
        held.append(what)
    if held:
        yield *last, held


class _Rank(dict):
    """A number of each word: its hash, with a bit above that for words that are probably rare."""

    def __missing__(self, word: str) -> int:
        if len(self) > DEALT:
            self.clear()
        self[word] = out = zlib.crc32(word.encode()) | (len(word) >= RARE) << 32
        return out


def _stretches(units: list[Unit], parts: int, rank: _Rank) -> Iterator[tuple]:
    """``(part, (ids, nos, runs, text))`` of units of one group: stretches, each with the number of places where its phrases begin."""
    words = [w for u in units for w in u[3]]
    size = np.array([len(u[3]) for u in units])
    ends, unit = np.cumsum(size), np.repeat(np.arange(len(units)), size)
    key = np.fromiter(map(rank.__getitem__, words), np.uint64, len(words))
    a, b, low = key[:-1], key[1:], np.uint64((1 << 32) - 1)
    top = np.maximum(a, b)
    route = np.where(top > low, top & low, (a * np.uint64(31) + b) & low) % np.uint64(parts)
    at = np.flatnonzero(unit[:-1] == unit[1:])
    r, u = route[at], unit[at]
    new = np.ones(len(at), bool)
    new[1:] = (r[1:] != r[:-1]) | (u[1:] != u[:-1])
    first = np.flatnonzero(new)
    new |= (np.arange(len(at)) - first[np.cumsum(new) - 1]) % LONG == 0
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(at)))
    begin, u, r = at[first], u[first], r[first]
    end = np.minimum(begin + run + MOST - 1, ends[u])
    order = np.argsort(r, kind="stable")
    begin, end, run, u, r = begin[order], end[order], run[order], u[order], r[order]
    texts = [" ".join(words[x:y]) for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
    ids, nos = np.array([x[1] for x in units]), np.array([x[2] for x in units], np.int32)
    cuts = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else []
    for x, y in zip(cuts, [*cuts[1:], len(r)], strict=True):
        yield r[x], (ids[u[x:y]], nos[u[x:y]], run[x:y].astype(np.uint8), "\n".join(texts[x:y]))


def _deal(read, parts: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = _Rank()

        def rows() -> Iterator[tuple]:
            held, size = {}, 0
            for unit in read(batches):
                held.setdefault(unit[0], []).append(unit)
                size += len(unit[3])
                if size >= DEALT:
                    yield from dealt(held)
                    held, size = {}, 0
            yield from dealt(held)

        def dealt(held: dict) -> Iterator[tuple]:
            for group, units in held.items():
                for p, what in _stretches(units, parts, rank):
                    yield p, 0, group, what

        return _packed(rows())

    return deal


def _in_order(whats: list[tuple]) -> tuple[np.ndarray, np.ndarray, list, list[str], list[int]]:
    """Ids, places, runs and texts of the stretches of a part, and their order by id and place."""
    ids, nos, runs = (np.concatenate([w[k] for w in whats]) for k in range(3))
    texts = [t for w in whats for t in w[3].split("\n")]
    return ids, nos, runs.tolist(), texts, np.lexsort((nos, ids)).tolist()


def _counts(runs: list[int], texts: list[str], order: list[int]) -> tuple[dict[str, int], list[int]]:
    """How often each phrase occurs, and the stretch where each, in the order of the dictionary, occurs first."""
    count: dict[str, int] = {}
    first: list[int] = []
    get = count.get
    for k in order:
        w = texts[k].split(" ")
        for s in range(runs[k]):
            p = w[s]
            for x in w[s + 1 : s + MOST]:
                p = f"{p} {x}"
                c = get(p)
                if c is None:
                    count[p] = 1
                    first.append(k)
                else:
                    count[p] = c + 1
    return count, first


def _dealt(docs: DataFrame, read, parts: int) -> DataFrame:
    packed = docs.mapInArrow(_deal(read, parts), _PACKED)
    return packed.repartitionById(parts, F.col("p")).sortWithinPartitions("p", "grp")


def totals(docs: DataFrame) -> DataFrame:
    """``phrases, most, phrase`` of each part of the lines of ``docs`` (doc_id, text): how many, the frequency of the most frequent and the first of these."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, whats in _together(_unpacked(batches)):
            _, _, runs, texts, order = _in_order(whats)
            count, _ = _counts(runs, texts, order)
            most = max(count.values())
            yield pa.RecordBatch.from_pydict({"phrases": [len(count)], "most": [most], "phrase": [min(p for p, n in count.items() if n == most)]})

    own = docs.select(F.col("doc_id").cast("long"), "text")
    return _dealt(own, _lines, parts_of(docs)).mapInArrow(total, "phrases long, most long, phrase string")


def of_lines(docs: DataFrame, least: int, shown: int) -> DataFrame:
    """``phrase, ngram_len, frequency, context_window``: phrases of lines that occur ``least`` times, with ``shown`` characters of the first line by document and place.

    The phrases go to the part of that document, where its lines are.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = parts_of(docs)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, _, whats in _together(_unpacked(batches)):
                ids, nos, runs, texts, order = _in_order(whats)
                count, first = _counts(runs, texts, order)
                kept = [(p, n, k) for (p, n), k in zip(count.items(), first, strict=True) if n >= least]
                at = np.array([k for _, _, k in kept], int)
                to = ids[at] % parts
                for p in np.unique(to):
                    own = np.flatnonzero(to == p)
                    yield p, 1, "", (ids[at[own]], nos[at[own]], np.array([kept[i][1] for i in own]), "\n".join(kept[i][0] for i in own))

        return _packed(rows())

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, size = [[] for _ in range(parts)], 0
            for _, name, no, words in _lines(batches):
                if name != NONE:
                    held[name % parts].append((name, no, " ".join(words)[:shown]))
                    size += 1
                if size >= DEALT >> 1:
                    yield from ((p, 0, "", x) for p, x in enumerate(held) if x)
                    held, size = [[] for _ in range(parts)], 0
            yield from ((p, 0, "", x) for p, x in enumerate(held) if x)

        return _packed(rows())

    def shown_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, {}
        for p, kind, _, what in _unpacked(batches):
            if p != last:
                last, known = p, {}
            if kind == 0:
                for name, no, line in what:
                    known[name, no] = min(line, known.get((name, no), line))
                continue
            ids, nos, counts, text = what
            phrases = text.split("\n")
            yield pa.RecordBatch.from_pydict({
                "phrase": phrases, "ngram_len": pa.array([x.count(" ") + 1 for x in phrases], pa.int32()), "frequency": pa.array(counts, pa.int64()),
                "context_window": pa.array([known.get(x) for x in zip(ids.tolist(), nos.tolist(), strict=True)], pa.string()),
            })

    found = _dealt(own, _lines, parts).mapInArrow(frequent, _PACKED)
    both = found.unionByName(own.mapInArrow(lines, _PACKED)).repartitionById(parts, F.col("p")).sortWithinPartitions("p", "kind")
    return both.mapInArrow(shown_with, "phrase string, ngram_len int, frequency long, context_window string")


def of_texts(texts: DataFrame, subject: Column, source: Column, text: Column, least: int = 1) -> DataFrame:
    """``subject, phrase, frequency, n_sources``: phrases across lines that occur ``least`` times in a subject; a missing source does not count as one."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group, whats in _together(_unpacked(batches)):
            ids, _, runs, parts, order = _in_order(whats)
            names, number = np.unique(ids, return_inverse=True)
            missing = {k for k, x in enumerate(names.tolist()) if x in (NONE, "")}
            number = number.tolist()
            count: dict[str, int] = {}
            last: dict[str, int] = {}
            sources: dict[str, int] = {}  # of phrases that have not just one
            for k in order:
                w, name = parts[k].split(" "), number[k]
                for s in range(runs[k]):
                    p = w[s]
                    for x in w[s + 1 : s + MOST]:
                        p = f"{p} {x}"
                        c = count.get(p)
                        if c is None:
                            count[p], last[p] = 1, name
                            if name in missing:
                                sources[p] = 0
                        else:
                            count[p] = c + 1
                            if last[p] != name:
                                last[p] = name
                                if name not in missing:
                                    sources[p] = sources.get(p, 1) + 1
            kept = [p for p, n in count.items() if n >= least]
            for x in range(0, len(kept), 1 << 16):
                some = kept[x : x + (1 << 16)]
                yield pa.RecordBatch.from_pydict({
                    "subject": pa.array([group] * len(some), pa.string()), "phrase": pa.array(some, pa.string()),
                    "frequency": pa.array([count[p] for p in some], pa.int64()), "n_sources": pa.array([sources.get(p, 1) for p in some], pa.int64()),
                })

    own = texts.select(subject.cast("string").alias("subject"), source.alias("source"), text.alias("text"))
    whole = dict(own.dtypes)["source"] in ("tinyint", "smallint", "int", "bigint")
    own = own.withColumn("source", F.col("source").cast("long" if whole else "string"))
    return _dealt(own, _texts, parts_of(own)).mapInArrow(counted, "subject string, phrase string, frequency long, n_sources long")
