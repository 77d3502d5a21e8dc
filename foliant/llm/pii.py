"""Personal data: base patterns, and identifiers that contexts learnt from them discover."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm._common import cut, drop_cut

KINDS = ("email", "ip", "card", "phone")
#: Rounds in which patterns and instances score one another.
ROUNDS = 3
#: A pattern needs so many different seeds of a kind.
SUPPORT = 3
#: An unknown instance that nothing speaks for counts against a pattern with this weight, a failed match too short for an identifier with 1.
DOUBT = 0.1
#: A pattern is used, and an instance found, from this confidence on.
CONFIDENCE = 0.8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_RUN = re.compile(r"[0-9]+").finditer
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}").match
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").match
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").match
_DIGIT = re.compile(r"[0-9]").findall
_MARK = re.compile(r"[0-9@]").search
_TOKEN = re.compile(r"[^\s\"'<>()\[\]{},;|]+").finditer
_WORD = re.compile(r"\s*(\S+)").match
_DIGIT_RUN = re.compile(r"[0-9]")
_EDGE = re.compile(r"^[^\w@]+|[^\w@:]+$")


def _luhn(digits: str) -> bool:
    values = list(map(int, reversed(digits)))
    return (sum(values[0::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int, bool]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN(text, at) if start < at else None
        if m:
            yield start, m.end(), True
            done = m.end()
        at = text.find("@", max(done, at + 1))


def _numbers(text: str, runs: list[int], match, valid) -> Iterator[tuple[int, int, bool]]:
    """Matches from the starts of runs of digits; one inside a run fails wherever its start does."""
    done = 0
    for start in runs:
        if start >= done and (m := match(text, start)):
            done = m.end()
            yield start, done, valid(m.group())


def _phones(text: str) -> Iterator[tuple[int, int, bool]]:
    at = text.find("+")
    while at >= 0:
        m = _PHONE(text, at)
        if m:
            yield at, m.end(), 9 <= len(_DIGIT(m.group())) <= 15
        at = text.find("+", m.end() if m else at + 1)


def _is_ip(s: str) -> bool:
    return all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in s.split(".")))


def _is_card(s: str) -> bool:
    digits = "".join(_DIGIT(s))
    return 13 <= len(digits) <= 19 and _luhn(digits)


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Valid matches of each kind, and those that fail its check; by kind, then start."""
    runs = [m.start() for m in _RUN(text)]
    found = (
        _emails(text), _numbers(text, runs, _IP, _is_ip), _numbers(text, runs, _CARD, _is_card), _phones(text),
    )
    good, bad = [], []
    for kind, spans in zip(KINDS, found, strict=True):
        for start, end, ok in spans:
            (good if ok else bad).append((kind, start, end))
    return good, bad


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _words_before(text: str, at: int, n: int) -> list[str]:
    """The last ``n`` words that end before ``at``, whole, however long."""
    out = []
    while len(out) < n:
        while at and text[at - 1].isspace():
            at -= 1
        end = at
        while at and not text[at - 1].isspace():
            at -= 1
        if at == end:
            break
        out.append(text[at:end])
    return out[::-1]


def _context(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: two words before; one before and one after; long words stand by their hash."""
    after = _WORD(text, end)
    left, right = ([_DIGIT_RUN.sub("0", w) for x in words if (w := _EDGE.sub("", x).lower())] for words in (_words_before(text, start, 2), [after.group(1)] if after else []))
    short = lambda w: w if len(w) <= 40 else _key(w)
    out = []
    if len(left) == 2:
        out.append(" ".join(map(short, left)) + " _")
    if left and right:
        out.append(f"{short(left[-1])} _ {short(right[0])}")
    return out


def _unknown(text: str, good: list[tuple[str, int, int]], bad: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of the shape of an identifier (four digits or an at sign) that no valid match touches.

    They are tokens, and matches that fail their check grown to the tokens in
    which they begin and end, spaces between included.  Of a token that a valid
    match touches, only what lies beside it and holds a failed match counts.
    """
    if not _MARK(text):
        return
    valid = sorted((a, z) for _, a, z in good)
    failed = []
    k = 0
    for a, z in sorted((a, z) for _, a, z in bad):
        while k < len(valid) and valid[k][1] <= a:
            k += 1
        if not (k < len(valid) and valid[k][0] < z):
            failed.append((a, z))
    tokens = [m.span() for m in _TOKEN(text) if _MARK(m.group())]
    spans: list[list[int]] = []
    for a, z in sorted(tokens + failed):
        if spans and a < spans[-1][1]:
            spans[-1][1] = max(z, spans[-1][1])
        else:
            spans.append([a, z])
    k = f = 0
    for start, end in spans:
        while k < len(valid) and valid[k][1] <= start:
            k += 1
        pieces, at, touched, v = [], start, False, k
        while v < len(valid) and valid[v][0] < end:
            touched = True
            pieces.append((at, valid[v][0]))
            at = max(at, valid[v][1])
            v += 1
        pieces.append((at, end))
        for a, z in pieces:
            while f < len(failed) and failed[f][0] < a:
                f += 1
            if touched and not (f < len(failed) and failed[f][1] <= z):
                continue
            while z > a and not text[z - 1].isalnum():
                z -= 1
            while a < z and not (text[a].isalnum() or text[a] in "+@"):
                a += 1
            if z - a >= 4 and (text.find("@", a, z) >= 0 or len(_DIGIT(text[a:z])) >= 4):
                yield a, z


def _key(instance: str) -> str:
    """Stands for a whole instance, however long."""
    return hashlib.blake2b(instance.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


_MENTION = T.ArrayType(
    T.StructType().add("label", "string").add("instance", "string").add("start", "integer").add("stop", "integer")
    .add("patterns", T.ArrayType(T.StringType()))
)


def _mentions(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text in b.column(2):
            text = text.as_py() or ""
            good, bad = base_spans(text)
            mentions = []
            maybe = [("", a, z) for a, z in _unknown(text, good, bad)]
            taken = sorted((a, z) for _, a, z in good + maybe)
            no, last, k = [], 0, 0
            for kind, start, end in sorted(bad, key=lambda x: x[1:]):  # too short for an identifier: these speak against a context
                while k < len(taken) and taken[k][0] < end:
                    last = max(last, taken[k][1])
                    k += 1
                if last <= start:
                    no.append((kind, start, end))
            for label, spans in (("", good), ("no", no), ("maybe", maybe)):
                for kind, start, end in spans:
                    patterns = _context(text, start, end)
                    if patterns:
                        mentions.append({"label": label or kind, "instance": _key(text[start:end]), "start": start, "stop": end, "patterns": patterns})
            base = joined(good)
            counts = [sum(k == kind for k, _, _ in good) for kind in KINDS]
            rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), base, mentions))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([*b.columns[:2], *[pa.array(c, schema.field(k + 2).type) for k, c in enumerate(cols)]], schema=schema)


def discover(mentions: DataFrame) -> DataFrame:
    """Found instances: ``instance, kind``.

    ``mentions`` has ``label, instance, pattern``.  Seeds score 1 for their
    kind, failed matches too short for an identifier 0, unknown ones what the
    patterns lend them.  In each round the instances known so far, seeds and those
    found in earlier rounds, induce patterns: every one that at least ``SUPPORT``
    of them have.  A pattern's confidence for a kind is the mean score of its
    different instances (those unknown weigh ``DOUBT`` until scored); confident
    patterns then give each unknown instance 1 - prod(1 - confidence), and those
    that reach ``CONFIDENCE`` are known in the next round.
    """
    edges = cut(mentions.distinct())
    unknown = edges.where("label = 'maybe'").select("instance", "pattern")
    seeds = edges.where(F.col("label").isin(*KINDS)).select("instance", "pattern", F.col("label").alias("kind"), F.lit(1.0).alias("score"))
    scores = None
    for _ in range(ROUNDS):
        known = seeds if scores is None else seeds.unionByName(unknown.join(scores, "instance").select("instance", "pattern", "kind", "score"))
        induced = known.groupBy("pattern", "kind").agg(F.count("*").alias("n"), F.sum("score").alias("value")).where(F.col("n") >= SUPPORT)
        all_of = edges.groupBy("pattern").agg(F.count("*").alias("all"), F.count_if(F.col("label") == "maybe").alias("maybe"))
        scored = known.join(unknown, ["instance", "pattern"], "left_semi").groupBy("pattern", "kind").agg(F.sum("score").alias("told"))
        joined = induced.join(all_of, "pattern").join(scored, ["pattern", "kind"], "left").fillna(0.0, ["told"])
        # unknown instances weigh their score, and DOUBT for what it lacks; all others 1
        weight = F.col("all") - F.col("maybe") + F.col("told") + DOUBT * (F.col("maybe") - F.col("told"))
        patterns = cut(joined.select("pattern", "kind", (F.col("value") / weight).alias("confidence")).where(F.col("confidence") >= CONFIDENCE))
        old = scores
        scores = cut(
            unknown.join(patterns, "pattern").groupBy("instance", "kind")
            .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("score")).where(F.col("score") >= CONFIDENCE)
        )
        drop_cut(patterns, *[old] * (old is not None))
    return scores.groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, n_email, n_ip, n_card, n_phone, base_sha256, base, spans``.

    Base spans are the leftmost non-overlapping matches of each kind over the
    whole text that pass its check; ``spans`` holds them and, as ``found_<kind>``,
    what :func:`discover` adds: unknown tokens of the shape of an identifier, and
    failed matches grown to whole tokens, in contexts that almost only seeds of
    the kind have.  Positions are code
    points, ends exclusive; spans go by kind, then start.

    A null text counts as empty and has no spans.  Null and repeated ids are
    kept, one row each, with the spans of their own text; an empty table gives
    an empty result; other columns are ignored.  Instances are compared by a
    hash of the whole span.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))
    schema = rows.select("id", "key").schema
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    schema = schema.add("base_sha256", "string").add("base", "string").add("mentions", _MENTION)
    arrow = to_arrow_schema(schema)
    parsed = cut(rows.mapInArrow(lambda it: _mentions(it, arrow), schema))
    each = parsed.select("key", F.explode("mentions").alias("m")).select("key", "m.*")
    found = discover(each.select("label", "instance", F.explode("patterns").alias("pattern")))
    maybe = each.where("label = 'maybe'").select("key", "instance", "start", "stop").distinct()
    added = cut(
        maybe.join(found, "instance").groupBy("key")
        .agg(F.array_sort(F.collect_set(F.struct("kind", "start", "stop"))).alias("more"))
        .select("key", F.transform("more", lambda x: F.format_string("found_%s:%d:%d", x["kind"], x["start"], x["stop"])).alias("more"))
    )
    return parsed.drop("mentions").join(added, "key", "left").select(
        F.col("id").alias(id_col), *[f"n_{k}" for k in KINDS], "base_sha256", "base",
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("more") > 0, F.array_join("more", ","))).alias("spans"),
    )
