import datetime as dt
import random

from pyspark.sql import functions as F

from foliant.operators import corpus, fixes, layout, lexicon, memory, metrics, questions
from foliant.plans import fixtures, qa
from foliant.sources import documents as sources


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_run_limit_keeps_two(spark):
    got = layout.limit_runs(docs(spark, "a\na\na\na\n\n\n\nb")).orderBy("line_no").collect()
    assert [r.text for r in got] == ["a", "a", "", "", "", "b"]


def sequential_pairs(lines):
    out, i = [], 0
    special = lambda s: s.startswith(("#", "---", "[", "(", ">", "**", "- ", "س"))
    while i < len(lines):
        s = lines[i]
        nxt = lines[i + 1] if i + 1 < len(lines) else ""
        if s and not special(s) and len(s) < 80 and s[-1] not in ".؟!:؛\"»" and nxt and not nxt.startswith(("#", "---", "[", "(", ">")):
            out.append(f"{s} {nxt}")
            i += 2
        else:
            out.append(s)
            i += 1
    return out


def sequential_paragraphs(lines):
    out, cur = [], ""
    for s in lines:
        if not s or s.startswith(("#", "---", "(")):
            if cur:
                out.append(cur)
            out.append(s)
            cur = ""
        elif cur and cur[-1] not in ".؟!:؛\"»":
            cur += " " + s
        else:
            if cur:
                out.append(cur)
            cur = s
    return out + ([cur] if cur else [])


def test_line_windows_match_a_loop(spark):
    rng = random.Random(5)
    texts = ["\n".join(rng.choice(["a", "b.", "", "# h", "(x", "c" * 90, "d"]) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    d = docs(spark, *texts)
    merged = {r.doc_id: r.text for r in layout.joined(layout.merge_pairs(d)).collect()}
    joined = {r.doc_id: r.text for r in layout.joined(layout.paragraphs(d), "par_no").collect()}
    for k, t in enumerate(texts):
        assert merged[k] == "\n".join(sequential_pairs(t.split("\n")))
        assert joined[k] == "\n".join(sequential_paragraphs(t.split("\n")))


def test_repeated_lines_and_tables(spark):
    long = "a line of more than twenty letters"
    got = layout.drop_repeated_lines(docs(spark, f"{long}\nx\nx\n{long}")).orderBy("line_no").collect()
    assert [r.line_no for r in got] == [0, 1, 2]
    t = layout.tables(docs(spark, "h\na | b\nc | d | e\nend | only")).collect()
    assert len(t) == 1 and t[0].n_rows == 3
    assert t[0].markdown.split("\n")[:3] == ["| a | b |  |", "| --- | --- | --- |", "| c | d | e |"]


def test_questions_keep_equal_numbers(spark):
    got = layout.questions_in_order(docs(spark, "intro\n2 - b\n1 - a\n2 - c")).orderBy("q_ord").collect()
    assert [(r.q_num, r.text) for r in got] == [(None, "intro"), (1, "1 - a"), (2, "2 - b"), (2, "2 - c")]


def test_error_rates(spark):
    rows = [("", ""), ("a", ""), ("", "a"), ("abc", "abd"), ("the cat sat", "the dog sat down")]
    got = spark.createDataFrame(rows, "o string, r string").select(metrics.character_error(F.col("o"), F.col("r")), metrics.word_error(F.col("o"), F.col("r"))).collect()
    assert [round(r[0], 4) for r in got[:4]] == [0, 1, 1, 0.3333]
    assert [round(r[1], 4) for r in got] == [0, 1, 1, 1, 0.5]


def test_weighted_distance():
    like = lexicon.confusion_table()
    assert lexicon.weighted_distance("بيت", "بيت", like) == 0
    assert abs(lexicon.weighted_distance("بيت", "بيث", like) - 0.3) < 1e-9
    assert abs(lexicon.weighted_distance("بيت", "بيتك", like) - 0.8) < 1e-9
    assert like[("ا", "ل")] == lexicon.MEDIUM and like[("ب", "ت")] == like[("ت", "ب")] == lexicon.HIGH


def test_lexicon(spark):
    terms = spark.createDataFrame([("قلم", "g"), ("Energy", "g"), ("كتاب", "g")], "term string, subject string")
    words = spark.createDataFrame([("قَلم",), ("القلم",), ("energy",), ("كتاب",), ("زز",)], "word string")
    got = {r.word: (r.term, r.step) for r in lexicon.spell_check(words, terms).collect()}
    assert got == {"قَلم": ("قلم", 2), "القلم": ("قلم", 3), "energy": ("Energy", 4), "كتاب": ("كتاب", 1), "زز": (None, None)}
    fixed = docs(spark, "الطاقه، الطاقه ثم قوه دفع").select(lexicon.apply_term_fixes(F.col("text"), {"الطاقه": "الطاقة", "قوه دفع": "قوة دفع"})).first()[0]
    assert fixed == "الطاقه، الطاقة ثم قوة دفع"
    near = lexicon.candidates(spark.createDataFrame([("كتاث",)], "word string"), terms).first()
    assert near.term == "كتاب" and near.rank == 1
    votes = spark.createDataFrame([(1, 0, "a b c"), (1, 1, "a x c"), (1, 2, "a x d")], "doc_id bigint, variant int, text string")
    assert lexicon.vote(votes).first().text == "a x c"


def test_memory(spark):
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame(
        [(1, t, "p", "x", 1, "aa", "bb", "auto"), (2, t, "p", "x", 2, "aa", "cc", "human"), (3, t, "p", "x", 2, "aa", "dd", "auto"), (4, t, "p", "x", 1, "zz", "zz", "auto")],
        "event_id bigint, ts timestamp, subject string, book_title string, page int, original string, edited string, source string",
    )
    m = memory.corrections(log)
    r = m.collect()
    assert len(r) == 1 and (r[0].corrected, r[0].frequency, r[0].source, r[0].pages) == ("cc", 3, "human", [1, 2])
    assert memory.merge(m, m).first().frequency == 6
    d = spark.createDataFrame([(1, "p", "aa  __aa__\nq aa")], "doc_id bigint, subject string, text string")
    assert memory.correct(d, m).first().text == "cc  __aa__\nq cc"
    edits = memory.human_edits(docs(spark, "a b c"), docs(spark, "a x c d")).collect()
    assert [(r.pos, r.original, r.edited) for r in edits] == [(1, "b", "x")]
    assert docs(spark, "قوة طاقة", "grammar", "").select(memory.subject_of(F.col("text"))).collect()[0][0] == "physics"


def test_memory_stream(spark, tmp_path):
    from foliant.streaming.memory import update

    schema = "event_id bigint, ts timestamp, subject string, book_title string, page int, original string, edited string, source string"
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, t, "p", "x", 1, "aa", "bb", "auto")], schema).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        update(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        spark.createDataFrame([(2, t, "p", "x", 1, "aa", "bb", "auto")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert spark.read.parquet(str(tmp_path / "out/v=1")).first().frequency == 2


def test_question_parse(spark):
    got = questions.parse(fixtures.papers(spark)).orderBy("q_ord").collect()
    first = next(r for r in got if r.q_num == 1 and "عاصمة" in r.question_text)
    assert (first.choice_a, first.choice_b, first.choice_c, first.choice_d) == ("القاهرة", "طنطا", "أسوان", "الأقصر")
    second = next(r for r in got if r.q_num == 2)
    assert second.choice_a == "فاعل" and "كتاب." in second.question_text and second.correct_choice is None


def test_golden_verdicts(spark):
    got = {r.fix_name: r.verdict for r in fixes.reports(fixes.results(fixtures.golden(spark), fixtures.LEXICON)).collect()}
    assert set(got.values()) == {"ACCEPT"}, got


def test_sources(spark):
    words = spark.createDataFrame([(1, 1, 1, 1, 1, 2, "b", 90), (1, 1, 1, 1, 1, 1, "a", 90), (1, 1, 1, 1, 2, 1, "c", -1), (1, 1, 2, 1, 1, 1, "كتاب", 10)], sources_schema())
    r = sources.scanned_pages(words).first()
    assert r.text == "a b\nكتاب" and r.doubtful == ["كتاب"]
    from foliant.schema import LAYOUT_BLOCKS

    blocks = spark.createDataFrame([(1, 1, 0, 10.0, 100.0, 50.0, 110.0, "left", 200.0, 800.0, 0, 0), (1, 1, 1, 120.0, 100.0, 190.0, 110.0, "right\ntwo", 200.0, 800.0, 0, 0), (1, 1, 2, 10.0, 780.0, 50.0, 790.0, "foot", 200.0, 800.0, 0, 0)], LAYOUT_BLOCKS)
    assert sources.digital_pages(blocks).first().text == "right two\nleft"


def sources_schema():
    from foliant.schema import OCR_WORDS

    return OCR_WORDS


def test_qa_runs_and_scores(spark):
    out = qa.run(docs(spark, "ab.\nab.\nab.\nend", None)).orderBy("doc_id").collect()
    assert out[0].duplicates_removed == 1 and 0 <= out[0].quality_score <= 100 and out[1].text == ""
    assert "quality_score" in qa.report(qa.run(docs(spark, "x"))).first().report


def test_tokens_and_neighbours(spark):
    t = metrics.neighbours(corpus.tokens(docs(spark, "a b c d e"))).orderBy("pos").collect()
    assert t[0].context == ["b", "c", "d"] and t[4].context == ["b", "c", "d"]


def test_text_folder_and_distinct_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"good \xff bytes")
    assert sources.text_folder(spark, str(tmp_path)).first().text == "good \ufffd bytes"
    pages = spark.createDataFrame([(2, 1, ""), (1, 2, ""), (1, 3, "x"), (3, 1, "x"), (3, 2, "y")], "doc_id long, page_no int, text string")
    assert sorted((r.doc_id, r.page_no) for r in sources.distinct_pages(pages).collect()) == [(1, 2), (1, 3), (3, 2)]
    again = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (2, 1, "a"), (3, 1, None), (4, 1, None), (4, 2, "b")], "doc_id long, page_no int, text string")
    assert sorted(map(str, map(tuple, sources.distinct_pages(again).collect()))) == ["(1, 1, 'a')", "(3, 1, None)", "(4, 2, 'b')"]
