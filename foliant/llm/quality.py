"""Quality classifier by co-training of a text view and a metadata view."""

from __future__ import annotations

import math
import operator
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm._common import cut, drop_cut

#: The classifiers are fitted on about so many labelled documents, or all if there are fewer.
LABELLED = 20_000
#: Rounds of exchange, and about how many pseudo-labels a view gives the other in a round for each class.
ROUNDS, EXCHANGED = 3, 1_000
#: A pseudo-label needs this calibrated confidence.
CONFIDENT = 0.98
#: One labelled document in so many is held out for calibration.
HELD_OUT = 4
#: Columns of the text view by hash of words, and of three letters in a row.
WORDS, LETTERS = 256, 256
#: Columns of the metadata view by hash of language and source.
LANGS, SOURCES = 16, 64
#: A worker's memo of words is emptied at so many entries.
MEMO = 200_000


class _Bucket(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        got = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS
        return got


class TextView:
    """What a text says, as bytes from 0 to 255, over the whole text.

    Square roots of the shares of hashed words and of hashed runs of three
    letters (bytes of UTF-8), then its length, and the shares of words that repeat the
    one before, of different words, of capitals and of letters.
    """

    width = WORDS + LETTERS + 5

    def __init__(self):
        self.bucket = _Bucket()

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        # a line that recurs, such as a heading, is no repetition of words
        words = "\n".join(dict.fromkeys(text.split("\n"))).split()
        n, m = len(words), max(1, len(words))
        raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
        mixed = (raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA77) + raw[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
        by_letters = np.bincount(mixed % np.uint32(LETTERS), minlength=LETTERS) / max(1, len(mixed))
        by_word = np.bincount(np.fromiter(map(self.bucket.__getitem__, words), dtype=np.int64, count=n), minlength=WORDS) / m
        shape = [
            min(1.0, math.log1p(n) / 12), sum(map(operator.eq, words, words[1:])) / m, len(set(words)) / m,
            sum(len(w) > 2 and w.isupper() for w in words) / m, sum(map(str.isalpha, words)) / m,
        ]
        out = np.concatenate([np.sqrt(by_word), np.sqrt(by_letters), shape])
        return np.rint(out * 255).astype(np.uint8)


class MetaView:
    """Length, and language and source by hash, as bytes; a null has a column of its own."""

    width = 3 + LANGS + SOURCES

    def __call__(self, lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
        out = np.zeros(self.width, dtype=np.uint8)
        if n_chars is not None and n_chars == n_chars:
            out[0] = min(255, round(math.log1p(max(0.0, n_chars)) * 12))
        else:
            out[1] = 255
        out[2] = 127 * ((lang is None) + (source is None))
        if lang is not None:
            out[3 + zlib.crc32(lang.encode("utf-8", "surrogatepass")) % LANGS] = 255
        if source is not None:
            out[3 + LANGS + zlib.crc32(source.encode("utf-8", "surrogatepass")) % SOURCES] = 255
        return out


@dataclass
class View:
    """A logistic model on centred columns, then Platt's two parameters."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    a: float = 1.0
    b: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x.astype(np.float32) - self.mean) / self.scale
        return self.a * (z @ self.weights[:-1] + self.weights[-1]).astype(float) + self.b


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 150) -> np.ndarray:
    """Weights and a constant that minimise the penalised logistic loss, by accelerated gradient steps in single precision."""
    y = y.astype(np.float32)
    power = np.ones(x.shape[1], dtype=np.float32)  # the largest curvature, by power iteration
    for _ in range(15):
        power = x.T @ (x @ power)
        largest = float(np.linalg.norm(power))
        power /= np.float32(largest)
    rate = np.float32(1 / (1.1 * max(largest, len(x)) / 4 + ridge))
    w = look = np.zeros(x.shape[1] + 1, dtype=np.float32)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ look[:-1] + look[-1], -30, 30)))
        grad = np.append(x.T @ (p - y) + np.float32(ridge) * look[:-1], (p - y).sum())
        new = look - rate * grad
        if (look - new) @ (new - w) > 0:  # past the valley: start anew from here
            t = 1.0
        ahead = (1 + math.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + np.float32((t - 1) / ahead) * (new - w), new, ahead
    return w


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 30) -> np.ndarray:
    """The same for a few columns."""
    x = np.column_stack([x, np.ones(len(x))])
    w, reg = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    reg[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(reg), x.T @ (p - y) + reg * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _fit(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> View:
    mean, scale = x.mean(axis=0, dtype=np.float64).astype(np.float32), x.std(axis=0, dtype=np.float64).astype(np.float32)
    scale = np.maximum(scale, 2.0)  # columns that hardly vary are not blown up
    z = x.astype(np.float32)
    z -= mean
    z /= scale
    view = View(mean, scale, _logistic(z, y, 3.0))
    del z
    if len(set(cy.tolist())) == 2:
        raw = view.logit(cx)
        # Platt's targets keep the slope finite where the classes part cleanly
        n1, n0 = cy.sum(), len(cy) - cy.sum()
        a, b = _newton(raw[:, None], np.where(cy > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), 1e-3)
        if a > 0:
            view.a, view.b = float(a), float(b)
        else:  # a view that ranks held-out documents no better than chance says nothing
            view.a, view.b = 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    return view


@dataclass
class Model:
    text: View
    meta: View
    mix: np.ndarray  # weights of the two calibrated logits, and a constant

    def combined(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return np.clip(text, -20, 20) * self.mix[0] + np.clip(meta, -20, 20) * self.mix[1] + self.mix[2]


def _packed(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def _views(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, meta = TextView(), MetaView()
        for b in batches:
            t = _packed([text(x.as_py()) for x in b.column("text")])
            m = _packed([meta(*x) for x in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), t, m], schema=pa.schema([("id", kind), ("h", pa.int64()), ("t", pa.binary()), ("m", pa.binary())]))

    return run


def _logits(views: list[View]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            l0, l1 = views[0].logit(_matrix(b.column("t"), TextView.width)), views[1].logit(_matrix(b.column("m"), MetaView.width))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), pa.array(l0), pa.array(l1)], names=["id", "h", "l0", "l1"])

    return run


def _meta(docs: DataFrame) -> list[Column]:
    kinds = {"lang": "string", "source": "string", "n_chars": "double"}
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]


def _below(h: Column, bound: float) -> Column:
    """Whether a hash is in the lowest part ``bound`` of its range."""
    return F.shiftrightunsigned(h, 11) / float(1 << 53) <= bound


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Co-train on labelled and unlabelled documents; None if the labels lack a class.

    About ``LABELLED`` labelled documents are used, those whose hash of the id is
    below a bound; a quarter of them is held out to calibrate both views.  In each
    round both views are fitted and score all unlabelled documents in Spark; each
    hands the other about ``EXCHANGED`` of a class with the label it gives, drawn
    by a hash from all that it is confident of and has not given before.  A
    logistic model on the calibrated logits combines the views.  Only these
    bounded sets reach the driver.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    )
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(id_col, F.lit(11)).alias("h"), F.col(text_col).alias("text"), *_meta(docs))
    features = cut(named.mapInArrow(_views(to_arrow_type(kind)), f"id {kind.simpleString()}, h long, t binary, m binary"))
    bound = LABELLED / max(LABELLED, features.select("id").join(known, "id").count())
    sample = features.where(_below(F.col("h"), bound)).join(known, "id").select("h", "t", "m", "y").toArrow().sort_by([("h", "ascending"), ("t", "ascending")])
    y = sample.column("y").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        drop_cut(features)
        return None
    xt, xm = _matrix(sample.column("t"), TextView.width), _matrix(sample.column("m"), MetaView.width)
    held = np.arange(len(y)) % HELD_OUT == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:  # too few to hold any out
        held = np.zeros(len(y), dtype=bool)
    cal = held if held.any() else ~held
    # of each view: features and labels of its training set
    sets = [[xt[~held], y[~held]], [xm[~held], y[~held]]]
    given: list[int] = []
    least = math.log(CONFIDENT / (1 - CONFIDENT))
    for turn in range(ROUNDS + 1):
        views = [_fit(*sets[0], xt[cal], y[cal]), _fit(*sets[1], xm[cal], y[cal])]
        if turn == ROUNDS:
            break
        scored = cut(features.mapInArrow(_logits(views), f"id {kind.simpleString()}, h long, l0 double, l1 double").join(known.select("id"), "id", "left_anti"))
        draw = F.xxhash64("h", F.lit(turn))
        new = F.lit(True) if not given else ~F.array_contains(F.array(*map(F.lit, given)), F.col("h"))  # about 4 * EXCHANGED a round
        sure = {f"{k}{label}": (F.col(f"l{k}") * (2 * label - 1) >= least) & new for k in (0, 1) for label in (0, 1)}
        counts = scored.agg(*[F.count_if(c).alias(name) for name, c in sure.items()]).first()
        picked = [F.when(c & _below(draw, min(1.0, EXCHANGED / max(1, counts[name]))), name) for name, c in sure.items()]
        picks = scored.select("id", "h", F.explode(F.array_compact(F.array(*picked))).alias("pick"))
        got = features.join(F.broadcast(picks), ["id", "h"]).select("h", "pick", "t", "m").toArrow().sort_by([("h", "ascending"), ("pick", "ascending"), ("t", "ascending")])
        drop_cut(scored)
        if not got.num_rows:
            break
        picked_by = got.column("pick").to_pylist()
        for k, (column, width) in ((0, ("m", MetaView.width)), (1, ("t", TextView.width))):
            own = np.array([p[0] == str(k) for p in picked_by])
            x = _matrix(got.column(column), width)[own]
            sets[1 - k][0] = np.vstack([sets[1 - k][0], x])
            sets[1 - k][1] = np.concatenate([sets[1 - k][1], np.array([float(p[1]) for p in picked_by])[own]])
        given = sorted(set(given) | set(got.column("h").to_pylist()))
    logits = np.column_stack([views[0].logit(xt[cal]), views[1].logit(xm[cal])])
    mix = _newton(np.clip(logits, -20, 20), y[cal], 0.05)
    drop_cut(features)
    return Model(*views, mix)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with ``p_text, p_meta, p_quality, kept`` (replaced where they exist).

    All rows are scored on their whole text; a null text counts as empty and
    null metadata as unknown.  Without a model (labels of one class or none)
    nothing can be told, so the scores are null and all documents are kept.
    """
    if model is None:
        none = F.lit(None).cast("double")
        return docs.withColumns({"p_text": none, "p_meta": none, "p_quality": none, "kept": F.lit(True)})

    base = docs.drop(*[c for c in ("p_text", "p_meta", "p_quality", "kept") if c in docs.columns])
    own = f"score_{uuid.uuid4().hex}"  # a name that no column of the input has
    return (
        base.withColumn(own, _scores(docs, model, text_col))
        .withColumns({c: F.col(f"{own}.{c}") for c in ("p_text", "p_meta", "p_quality")})
        .withColumn("kept", F.col("p_quality") >= threshold)
        .drop(own)
    )


def _scores(docs: DataFrame, model: Model, text_col: str) -> Column:
    @F.arrow_udf("p_text double, p_meta double, p_quality double")
    def run(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        look, meta, out = TextView(), MetaView(), []
        for k in range(0, len(text), 500):  # a few rows at a time bound the memory
            t = np.array([look(x.as_py()) for x in text[k : k + 500]])
            m = np.array([meta(*x) for x in zip(*(c[k : k + 500].to_pylist() for c in (lang, source, n_chars)), strict=True)])
            lt, lm = np.clip(model.text.logit(t), -20, 20), np.clip(model.meta.logit(m), -20, 20)
            out.append(1 / (1 + np.exp(-np.column_stack([lt, lm, model.combined(lt, lm)]))))
        p = np.concatenate(out) if out else np.zeros((0, 3))
        return pa.StructArray.from_arrays([pa.array(p[:, j]) for j in range(3)], names=["p_text", "p_meta", "p_quality"])

    return run(text_col, *_meta(docs))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a model fitted on them and the labels does not reject, with their columns unchanged."""
    model = fit(docs, labels, id_col, text_col)
    if model is None:
        return docs
    own = f"score_{uuid.uuid4().hex}"  # a name that no column of the input has
    return docs.withColumn(own, _scores(docs, model, text_col)).where(F.col(f"{own}.p_quality") >= threshold).drop(own)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, p_text, p_meta, p_quality, kept``.

    Null ids are scored too but not used for fitting; rows that repeat an id
    are scored each by their own text; labels that disagree are averaged; an
    empty table gives an empty result; other columns are ignored.
    """
    return score(docs, fit(docs, labels, id_col, text_col), text_col=text_col).select(id_col, "p_text", "p_meta", "p_quality", "kept")
