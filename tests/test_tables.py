"""Tables of few files dealt over the cores; cases and papers around given texts."""

from foliant.operators import fixes, questions
from foliant.plans import fixtures
from foliant.sources.tables import evenly

COLUMNS = "doc_id long, text string"


def stored(spark, path, rows, files):
    spark.createDataFrame(rows, COLUMNS).repartition(files).write.parquet(path)
    return spark.read.parquet(path)


def test_one_file_is_dealt_and_keeps_its_rows(spark, tmp_path):
    rows = [(k % 7, None if k % 5 == 0 else "x" * k) for k in range(40)]
    one = stored(spark, f"{tmp_path}/one", rows, 1)
    got = evenly(one)
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(map(str, got.collect())) == sorted(map(str, one.collect()))


def test_many_files_stay(spark, tmp_path):
    n = spark.sparkContext.defaultParallelism
    many = stored(spark, f"{tmp_path}/many", [(k, "x") for k in range(20 * n)], n)
    assert evenly(many) is many


def test_empty_table(spark, tmp_path):
    assert evenly(stored(spark, f"{tmp_path}/none", [], 1)).count() == 0


def test_cases_below_null_empty_and_long_texts(spark):
    passages = spark.createDataFrame([(1, None), (2, ""), (3, "a  b\n" * 500), (3, "a  b\n" * 500)], "item_id long, text string")
    got = {r.fix_name: (r.total_tests % 4, r.verdict) for r in fixes.reports(fixes.results(fixtures.golden_with(passages), fixtures.LEXICON)).collect()}
    assert set(got.values()) == {(0, "ACCEPT")} and set(got) == set(fixes.FIXES)


def test_paper_of_a_conversation(spark):
    talks = spark.createDataFrame([(9, 1, "two  words"), (9, 0, None), (9, 1, "two  words")], "conv_id long, turn long, text string")
    got = questions.parse(fixtures.papers_of(talks)).orderBy("q_ord").collect()
    assert [(r.q_num, r.question_text, r.choice_a, r.choice_b, r.choice_d) for r in got] == [
        (1, "؟", "الخيار (أ)", "الخيار (ب)", "الخيار (د)"), (2, "two words؟", "two", "words", "الخيار (د)"), (2, "two words؟", "two", "words", "الخيار (د)"),
    ]
