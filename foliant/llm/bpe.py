"""Byte-level BPE: every distinct word is encoded once for the whole corpus.

One pass reads the documents in blocks.  A block numbers its distinct words
(pre-tokens), and a document becomes the sequence of these numbers, whose order
holds the positions.  Sequences and word lists are written once, in a table
bucketed by block, so that both come from the same reading of the input.  The
word lists are shuffled by word hash over all blocks; each distinct word is
encoded once there, and its ids go back to the blocks that hold it, where they
meet the sequences, which stay where they are, and put the ids of each document
together by position.  Sequences and lists travel as packed binary columns.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm._common import shared_dir

#: A block of documents with one word list ends at so many characters.
BLOCK_CHARS = 8_000_000
#: Words are dealt by hash to so many buckets at most when blocks are written.
BUCKETS = 1024
#: Where the lists of a bucket hold more words than this on average, buckets are split before the shuffle; so a worker's memo stays small.
BUCKET_WORDS = 1_000_000
#: A worker's memo of pieces takes no more entries than this; it is emptied with the block.
MEMO = 100_000
#: A worker hands on so many ids or words at a time.
CHUNK = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file; as large as the vocabulary."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _pack(values) -> bytes:
    """Unsigned 32-bit values as four compressed byte planes."""
    v = np.ascontiguousarray(values, dtype="<u4")
    return _squeeze(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_expand(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


class Splitter:
    """Numbers of the pre-tokens of a text, in order, with a memo by the pieces between spaces.

    A space before a character other than white space always starts a
    pre-token, since the pattern lets one leading space join what follows and
    nothing else reach over it.  So a text can be cut there.
    """

    def __init__(self, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.odd = re.compile(r" (?:\s|\Z)").search
        self.blank = regex.compile(r"\s").match
        self.start()

    def start(self) -> None:
        self.memo: dict[str, tuple[int, ...]] = {}
        self.codes: dict[str, int] = {}

    def _find(self, text: str) -> tuple[int, ...]:
        codes = self.codes
        return tuple([codes.setdefault(w, len(codes)) for w in self.find(text)])

    def _piece(self, p: str) -> tuple[int, ...]:
        """Numbers of a space and a piece; letters, and letters with a mark at their end, need no pattern."""
        codes = self.codes
        if p.isalpha():
            return (codes.setdefault(" " + p, len(codes)),)
        if p[-1] in ".,;:!?" and p[:-1].isalpha():
            return codes.setdefault(" " + p[:-1], len(codes)), codes.setdefault(p[-1], len(codes))
        return self._find(" " + p)

    def __call__(self, text: str) -> np.ndarray:
        pieces = text.split(" ")
        if self.odd(text):
            joined = [pieces[0]]
            for p in pieces[1:]:
                if p == "" or self.blank(p):
                    joined[-1] += " " + p
                else:
                    joined.append(p)
            pieces = joined
        out = list(self._find(pieces[0]))
        memo, extend = self.memo, out.extend
        for p in pieces[1:]:
            got = memo.get(p)
            if got is None:
                got = self._piece(p)
                if len(memo) < MEMO:
                    memo[p] = got
            extend(got)
        return np.array(out, dtype=np.uint32)


def _blocks(pattern: str, buckets: int, schema: pa.Schema):
    """Blocks of a partition's documents: packed sequences of some documents each, and word lists by bucket.

    Numbers follow falling frequency, then the word.
    """
    none = dict.fromkeys(schema.names)

    def finish(block, ids, held, split):
        words = list(split.codes)
        n = np.bincount(np.concatenate(held), minlength=len(words))
        order = sorted(sorted(range(len(words)), key=words.__getitem__), key=(-n).tolist().__getitem__)
        rank = np.empty(len(words), dtype=np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        first, size = 0, 0
        for k, codes in enumerate(held):
            size += len(codes)
            if size >= CHUNK or k == len(held) - 1:
                some = held[first : k + 1]
                yield none | {"block": block, "ids": ids[first : k + 1], "lens": _pack([len(x) for x in some]), "seq": _pack(rank[np.concatenate(some)])}
                first, size = k + 1, 0
        dealt: dict[int, tuple[list, list]] = {}
        for number, k in enumerate(order):
            data = words[k].encode()
            numbers, names = dealt.setdefault(zlib.crc32(data) % buckets, ([], []))
            numbers.append(number)
            names.append(data)
        for bucket, (numbers, names) in sorted(dealt.items()):
            yield none | {
                "block": block, "bucket": bucket, "n": len(names), "codes": _pack(np.diff(np.array(numbers), prepend=0)),
                "sizes": _pack([len(x) for x in names]), "words": _squeeze(b"".join(names)),
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, chars, ids, held, block = Splitter(pattern), 0, [], [], None

        def out():
            rows = []
            for x in finish(block, ids, held, split):
                rows.append(x)
                if len(rows) == 50:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            for row, text in zip(batch.column(0), batch.column(1), strict=True):
                block = block or uuid.uuid4().hex
                text = text.as_py() or ""
                ids.append(row.as_py())
                held.append(split(text))
                chars += len(text) + 50
                if chars >= BLOCK_CHARS:
                    yield from out()
                    split.start()
                    chars, ids, held, block = 0, [], [], None
        if held:
            yield from out()
        split.start()
        pa.default_memory_pool().release_unused()

    return run


def _split_buckets(buckets: int, parts: int, schema: pa.Schema):
    """Word lists dealt on, each to ``parts`` finer buckets; the numbers of a list still rise, so their steps are packed anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                data, ends, numbers = _expand(x["words"]), np.cumsum(_unpack(x["sizes"])).tolist(), np.cumsum(_unpack(x["codes"])).tolist()
                dealt: dict[int, tuple[list, list]] = {}
                for begin, end, number in zip([0, *ends[:-1]], ends, numbers, strict=True):
                    mine, names = dealt.setdefault(zlib.crc32(data[begin:end]) // buckets % parts, ([], []))
                    mine.append(number)
                    names.append(data[begin:end])
                rows = [
                    x | {
                        "bucket": x["bucket"] + buckets * part, "codes": _pack(np.diff(np.array(mine), prepend=0)),
                        "sizes": _pack([len(w) for w in names]), "words": _squeeze(b"".join(names)),
                    }
                    for part, (mine, names) in sorted(dealt.items())
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _encode_words(ranks, pattern: str, schema: pa.Schema):
    """Ids of the words in lists sorted by bucket; a word that many blocks hold is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        encode, memo, at = encoding._encode_single_piece, {}, None
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if x["bucket"] != at:
                    at, memo = x["bucket"], {}
                data, ends, ids, begin = _expand(x["words"]), np.cumsum(_unpack(x["sizes"])).tolist(), [], 0
                for end in ends:
                    word = data[begin:end]
                    begin = end
                    got = memo.get(word)
                    if got is None:
                        got = memo[word] = encode(word)
                    ids.append(got)
                rows.append({
                    "block": x["block"], "codes": x["codes"],
                    "sizes": _pack([len(g) for g in ids]), "tokens": _pack(np.fromiter(chain.from_iterable(ids), dtype=np.uint32)),
                })
                if len(rows) == 50:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


class _Tokens:
    """The token-byte table, for joins by id."""

    def __init__(self, tokens: list[bytes]):
        self.flat, self.lens = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens])
        self.starts = np.cumsum(self.lens) - self.lens

    def __call__(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lens)):
            raise ValueError("an id is not in the token table")
        n = self.lens[ids]
        if not n.all():
            raise ValueError("an id is not in the token table")
        return self.flat[np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()


def _assemble(schema: pa.Schema, table=None):
    """Join the ids of a block's words to its sequences, by position; with a token-byte table, decode them too."""

    def run(lists: pa.Table, seqs: pa.Table) -> pa.Table:
        parts = [(np.cumsum(_unpack(x["codes"])), _unpack(x["sizes"]), _unpack(x["tokens"])) for x in lists.to_pylist()]
        if parts:
            numbers, sizes, flat = (np.concatenate(y) for y in zip(*parts, strict=True))
            starts, lens = np.empty(len(numbers), np.int64), np.empty(len(numbers), np.int64)
            starts[numbers], lens[numbers] = np.cumsum(sizes, dtype=np.int64) - sizes, sizes
        tokens = _Tokens(table.value) if table else None
        batches = []
        for k in range(seqs.num_rows):
            x = seqs.slice(k, 1)
            names, counts, codes = x.column("ids")[0].values, _unpack(x.column("lens")[0].as_py()).astype(np.int64), _unpack(x.column("seq")[0].as_py())
            if len(codes):
                n = lens[codes]
                ids = flat[np.repeat(starts[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
            else:
                ids, ends = np.zeros(0, np.uint32), np.zeros(len(counts) + 1, np.int64)
            if tokens:
                each = [ids[a:b].astype("<u4") for a, b in zip(ends[:-1], ends[1:], strict=True)]
                cols = [names, pa.array([e.tobytes() for e in each], pa.binary()), pa.array([tokens(e) for e in each], pa.binary())]
            else:
                cols = [names, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))).cast(schema.field(1).type)]
            batches.append(pa.RecordBatch.from_arrays(cols, schema=schema))
        return pa.Table.from_batches(batches, schema=schema)

    return run


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, both: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    ranks = read_ranks(ranks_path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ddl = T.StructType.fromDDL
    schema = T.StructType([T.StructField("block", T.StringType()), T.StructField("ids", T.ArrayType(kind)), *ddl("lens binary, seq binary, bucket int, n int, codes binary, sizes binary, words binary")])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    name, buckets = f"cut_{uuid.uuid4().hex}", min(n, BUCKETS)
    (
        rows.mapInArrow(_blocks(pattern, buckets, to_arrow_schema(schema)), schema)
        .write.bucketBy(n, "block").option("path", f"{shared_dir(spark)}/{name}").option("compression", "none").saveAsTable(name)
    )
    written = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and ``written`` knows them and their buckets
    words = written.where("bucket is not null").select("block", "bucket", "codes", "sizes", "words")
    parts = -(-(written.agg(F.sum("n")).first()[0] or 0) // (buckets * BUCKET_WORDS))
    if parts > 1:
        words = words.mapInArrow(_split_buckets(buckets, parts, to_arrow_schema(words.schema)), words.schema)
    lists = ddl("block string, codes binary, sizes binary, tokens binary")
    coded = (
        words.repartition(n, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(_encode_words(spark.sparkContext.broadcast(ranks), pattern, to_arrow_schema(lists)), lists)
    )
    out = T.StructType([T.StructField(id_col, kind), *ddl("ids binary, decoded binary" if both else "ids array<int>")])
    table = spark.sparkContext.broadcast(_token_bytes(ranks)) if both else None
    seqs = written.where("seq is not null").select("block", "ids", "lens", "seq")
    return coded.groupBy("block").cogroup(seqs.groupBy("block")).applyInArrow(_assemble(to_arrow_schema(out), table), out)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, ids array<int>``, as an encoder without special tokens gives them.

    A null or empty text has no ids.  Null and repeated ids are kept as they
    are, one row each; an empty table gives an empty result; other columns are
    ignored.  Blocks end at ``BLOCK_CHARS``, so a worker's memory is bounded but
    for one text that is longer by itself.  The input is read once, when this is
    called, and written to the folder of ``spark.checkpoint.dir``; the catalogue
    does not keep the table.
    """
    return _encoded(docs, ranks_path, pattern, id_col, text_col, False)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`encode` and :func:`decode` in one task: ``id_col, ids binary, decoded binary``.

    ``ids`` holds little-endian unsigned 32-bit integers; they are joined to the
    token-byte table where they have been put together, so a worker passes each
    document once.
    """
    return _encoded(docs, ranks_path, pattern, id_col, text_col, True)


def _token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        tokens[i] = t
    return tokens


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids in ``out_col binary`` (replaced if it exists).

    The ids are joined to the token-byte table, which is as large as the
    vocabulary and held by each worker.  Null ids give null, no ids give no
    bytes; an id that the table lacks is an error.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = encoded.sparkSession
    table = spark.sparkContext.broadcast(_token_bytes(read_ranks(ranks_path)))
    base = encoded.drop(out_col) if out_col in encoded.columns else encoded
    schema = base.withColumn(out_col, F.lit(None).cast("binary")).schema
    arrow, at = to_arrow_schema(schema), base.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(table.value)
        for batch in batches:
            rows, begin, size = [], 0, 0
            for k, x in enumerate(batch.column(at)):
                rows.append(tokens(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None)
                size += len(x.values) if x.is_valid else 0
                if size >= CHUNK or k == batch.num_rows - 1:
                    part = batch.slice(begin, k + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.binary())], schema=arrow)
                    rows, begin, size = [], k + 1, 0

    return base.mapInArrow(run, schema)
