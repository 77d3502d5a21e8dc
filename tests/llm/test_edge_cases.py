"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import corpus_pipeline
import pytest
import public_tokenizers
from pyspark.sql import Row
from pyspark.sql import functions as F

from foliant.llm import bpe, mixing, quality
from foliant.llm.embed_dedup import embedding_dedup
from foliant.llm.exact_dedup import exact_dedup, keep_exact
from foliant.llm.html_extract import extract_main_text
from foliant.llm.line_dedup import dedup_lines
from foliant.llm.minhash import keep_near, near_dedup
from foliant.llm.pii import find_personal_data
from foliant.llm.sharding import shard

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = "lorem ipsum dolor sit amet " * 8000
NAMES = "id key text2 a b u v n node band bucket source2 kept shard slot sig ids decoded spans f w p_text size law".split()


def nasty(spark, empty=False):
    rows = [
        (1, "Same text here with a few words more", "en", "s0", 3), (2, "same TEXT here with a few words more", "en", "s0", 3),
        (2, "same TEXT here with a few words more", "en", "s0", 3), (3, None, None, None, None), (None, "no id", "en", None, 5), (4, "", "de", "s1", 0),
        (5, "   \n\n\t ", "de", "s1", 6), (6, LONG, "en", "s2", len(LONG)), (7, LONG + "end", "en", "s2", len(LONG)), (8, "é ü 😀 ́\nx", "fr", "s3", 9),
        (9, "mail a.b@c.de now +49 30 1234567 or 10.0.0.1", "en", "s4", 40),
    ]
    d = spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({n: F.lit(1) for n in NAMES})


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "pii": lambda s, d: find_personal_data(d),
    "lines": lambda s, d: dedup_lines(d),
    "bpe": lambda s, d: bpe.decode(bpe.encode(d, PATH, public_tokenizers.PATTERN), PATH),
    "shard": lambda s, d: shard(d),
    "quality": lambda s, d: quality.classify(d, labels(s, [(1, 1, 0), (4, 0, 0), (None, 1, 0), (6, None, 0), (2, 1, 0), (5, 0, 0)])),
    "near": lambda s, d: near_dedup(d),
    "mix": lambda s, d: mixing.mix(d),
    "exact": lambda s, d: exact_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_nasty_rows(spark, name):
    got = OPERATORS[name](spark, nasty(spark)).collect()
    assert len(got) == 11


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, nasty(spark, True)).collect() == []


def test_exact_fate(spark):
    got = {(r.doc_id, r.kept, r.group_size, r.keep_id) for r in exact_dedup(nasty(spark)).collect()}
    assert (1, False, 3, 2) in got and (2, True, 3, 2) in got and (4, True, 2, 4) in got and (3, False, 2, 4) in got and (None, True, 1, None) in got
    kept = keep_exact(nasty(spark))
    assert kept.columns == nasty(spark).columns and kept.count() == 9  # both rows of id 2 share its fate
    rows = spark.createDataFrame([(1, "a"), (2, "A"), (1, "b"), (None, "c"), (None, "c")], "doc_id long, text string")
    assert sorted(keep_exact(rows).collect(), key=str) == sorted([(2, "A"), (1, "b"), (None, "c"), (None, "c")], key=lambda r: str(Row(doc_id=r[0], text=r[1])))


@pytest.mark.parametrize("empty", [False, True])
def test_stages_keep_whole_rows(spark, empty):
    """Nulls, repeats, clashing names and empty tables through every filtering stage; the last one gives a row each."""
    docs = nasty(spark, empty).withColumns({c: F.lit("x") for c in ("stay", "gone", "score", "digest")})
    seen = set(map(str, docs.collect()))
    for keep in (keep_exact, keep_near, mixing.keep_mixed, lambda d: quality.keep_good(d, labels(spark, [(1, 1, 0), (4, 0, 0)]))):
        got = keep(docs)
        assert got.columns == docs.columns and set(map(str, got.collect())) <= seen
    assert corpus_pipeline.token_stage(spark, docs, "").count() == docs.count()


def test_near_fate(spark):
    got = {r.doc_id: r for r in near_dedup(nasty(spark)).collect()}
    assert got[None].kept and got[None].class_id is None and got[7].class_id == 6 and not got[7].kept and got[2].class_id == 1 and got[3].kept and got[4].kept and got[5].kept


def test_shard_slots(spark):
    rows = shard(nasty(spark), 3).collect()
    for s in range(3):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r.size for r in rows if r.doc_id in (3, 4)} == {1}


def test_quality_without_classes(spark):
    got = quality.classify(nasty(spark), labels(spark, [(1, 1, 0)])).collect()
    assert all(r.kept and r.p_quality is None for r in got)


def test_mixing_hits_its_targets(spark):
    """Expected shares of tokens are the targets, by default and as given, for every source, language and topic."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wanted = {"source": {f"src{k}": 1.0 + k % 3 for k in range(20)}, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}}
    for targets in (None, wanted):
        rows = mixing.mix(docs, targets=targets, strict=True).toPandas()
        rows["given"] = rows.n_tokens * rows.probability
        assert rows.probability.max() <= 1
        for name, power in mixing.TEMPER.items():
            have = rows.groupby(name)[["n_tokens", "given"]].sum()
            goal = (targets or {}).get(name) or (have.n_tokens.astype(float) ** power).to_dict()
            for value, x in (have.given / have.given.sum()).items():
                assert abs(x / (goal[value] / sum(goal.values())) - 1) < 0.01
    with pytest.raises(ValueError, match="no lang"):
        mixing.mix(docs, targets={"lang": {"xx": 1.0}})


def test_mixing_says_what_it_misses(spark):
    rows = [(k, "w " * 50, "ab"[k % 2], "xy"[k % 2]) for k in range(10)]  # sources and languages coincide, so they cannot have unlike targets
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.7, "y": 0.3}}
    with pytest.raises(ValueError, match="from its target"):
        mixing.mix(docs, targets=targets, strict=True)
    with pytest.warns(UserWarning, match="from its target"):
        assert mixing.mix(docs, targets=targets).count() == 10


def test_mixing_is_repeatable(spark):
    a, b = (sorted(map(str, mixing.mix(nasty(spark)).collect())) for _ in range(2))
    assert a == b


def test_pages(spark):
    d = spark.createDataFrame([(1, "u", None), (1, "u", None), (2, None, ""), (None, "u", "<p>x"), (3, "u", "<nav>only</nav>")], "page_id long, url string, html string")
    got = extract_main_text(d.withColumn("text", F.lit("clash"))).collect()
    assert sorted(r.text for r in got) == ["", "", "", "", "x"] and all(r.n_chars == len(r.text) for r in got)
    assert extract_main_text(d.limit(0)).collect() == []


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, []), (None, [0.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(0)).withColumn("block", F.lit(1))
    got = embedding_dedup(d).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert by[1].n_links == 2 and by[1].kept and by[2].component_id == 1 and not by[2].kept
    assert all(by[k].n_links == 0 and by[k].kept for k in (3, 4, 5, 6, 7, 8, 9, None))
    assert embedding_dedup(d.limit(0)).collect() == []


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "mixing", "byte_bpe"]
