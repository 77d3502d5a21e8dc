"""Error rates, word confidence, document scores."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.unicode import AR, BEFORE, TASHKEEL, blanks, count

#: A word of this confidence or more is left alone.
SURE = 0.9
#: What a reader should check carries this mark.
VERIFY = "[تحقق]"
# Words near which a term is likely.
CONTEXT = ["القوة", "الطاقة", "الكتلة", "السرعة", "التسارع", "التفاعل", "المعادلة", "الدالة", "الخلية", "الجهاز", "النظام", "المادة", "العنصر"]

_SPEAKS, _OTHER = re.compile("|".join(CONTEXT)), re.compile(f"[^{AR}A-Za-z]")

# A word that begins so is not held unknown.
PREFIXES = ("ال", "بال", "فال")

# What starts a question, what marks a choice, and what ends a page.
QUESTIONS = rf"س\d+|{BEFORE}\d+\s*[.\-)]\s*(?:ما|اذكر|عدد|علل|فسر)"
CHOICES = r"\([أبجدهوز]\)"
PAGE_MARK = r"صفحة\s*\d+"


def rate(distance: Column, n_read: Column, n_true: Column) -> Column:
    """Errors by true length; nothing true is an error of 1 unless nothing is read either."""
    return F.when((n_true == 0) & (n_read == 0), 0.0).when((n_true == 0) | (n_read == 0), 1.0).otherwise(distance / n_true)


def character_error(read: Column, true: Column) -> Column:
    return rate(F.levenshtein(read, true), F.length(read), F.length(true))


def word_error(read: Column, true: Column) -> Column:
    """Edit distance of word sequences, each distinct word of the pair standing as one private character."""
    a, b = blanks(read), blanks(true)
    both = F.array_distinct(F.concat(a, b))
    # planes 15 and 16 hold over 131,000 private code points
    sign = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(both, w) + 983039), 8, "0")), "UTF-32")
    coded = lambda ws: F.array_join(F.transform(ws, sign), "")
    return rate(F.levenshtein(coded(a), coded(b)), F.size(a), F.size(b))


def page_metrics(pairs: DataFrame) -> DataFrame:
    """``doc_id, page, cer, car, wer, war, q_preserved, q_total, c_preserved, c_total, chars_ocr, chars_ref``."""
    o, r = F.coalesce("ocr_text", F.lit("")), F.coalesce("reference_text", F.lit(""))
    cer, wer = character_error(o, r), word_error(o, r)
    kept = lambda p: F.size(F.array_intersect(F.regexp_extract_all(o, F.lit(p), F.lit(0)), F.regexp_extract_all(r, F.lit(p), F.lit(0))))
    total = lambda p: F.greatest(F.lit(1), F.size(F.array_distinct(F.regexp_extract_all(r, F.lit(p), F.lit(0)))))
    q, c = QUESTIONS, CHOICES
    return pairs.select(
        "doc_id", "page", F.bround(cer, 4).alias("cer"), F.bround(1 - cer, 4).alias("car"), F.bround(wer, 4).alias("wer"), F.bround(1 - wer, 4).alias("war"),
        kept(q).alias("q_preserved"), total(q).alias("q_total"), kept(c).alias("c_preserved"), total(c).alias("c_total"),
        F.length(o).alias("chars_ocr"), F.length(r).alias("chars_ref"),
    )


def document_metrics(pages: DataFrame) -> DataFrame:
    """Errors of the pages, truncated to whole characters, over all their characters."""
    errors = F.sum(F.floor(F.col("cer") * F.col("chars_ref")))
    chars = F.greatest(F.sum("chars_ref"), F.lit(1))
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.bround(errors / chars, 4).alias("cer"), F.bround(1 - errors / chars, 4).alias("car"),
        F.bround(F.avg("wer"), 4).alias("wer"), F.bround(F.sum("q_preserved") / F.sum("q_total"), 4).alias("q_rate"),
        F.bround(F.sum("c_preserved") / F.sum("c_total"), 4).alias("c_rate"),
    )


def split_pages(docs: DataFrame, mark: str = PAGE_MARK) -> DataFrame:
    """``doc_id, page, text``: the text between page marks, pages from 1; what precedes the first mark is page 1. A null text is one empty page."""
    parts = F.split(F.coalesce("text", F.lit("")), mark, -1)
    return docs.select("doc_id", F.posexplode(parts).alias("page", "text")).select("doc_id", (F.col("page") + 1).alias("page"), "text")


def aligned_pages(read: DataFrame, true: DataFrame, mark: str = PAGE_MARK) -> DataFrame:
    """``doc_id, page, ocr_text, reference_text``: pages of the same number side by side; null where one side lacks it.

    Both sides hold each document once.  They meet as whole documents, and the
    pages are paired inside the row.
    """
    side = lambda d, name: d.select("doc_id", F.split(F.coalesce("text", F.lit("")), mark, -1).alias(name))
    both = side(read, "o").join(side(true, "r"), "doc_id", "full")
    pages = F.arrays_zip(F.coalesce("o", F.array().cast("array<string>")).alias("o"), F.coalesce("r", F.array().cast("array<string>")).alias("r"))
    return both.select("doc_id", F.posexplode(pages).alias("page", "p")).select("doc_id", (F.col("page") + 1).alias("page"), F.col("p.o").alias("ocr_text"), F.col("p.r").alias("reference_text"))


def page_counts(pairs: DataFrame) -> DataFrame:
    """Pages of :func:`aligned_pages` that both sides have, with their errors in whole characters and words.

    ``doc_id, page`` and the columns of :func:`page_metrics`, then ``words_ref,
    error_chars, error_words``.  A page that is read but not in the reference
    has no characters to be wrong.
    """
    o, r = F.col("ocr_text"), F.col("reference_text")
    both = pairs.where(o.isNotNull() & r.isNotNull())
    metrics = [c for c in page_metrics(both).columns if c not in ("doc_id", "page")]
    n_r, n_o, w_r, w_o = F.length(r), F.length(o), F.size(blanks(r)), F.size(blanks(o))
    wrong = lambda rate_, n, read: F.when(n == 0, 0).when(read == 0, n).otherwise(F.round(rate_ * n)).cast("long")
    raw = both.select("*", character_error(o, r).alias("_cer"), word_error(o, r).alias("_wer"))
    counted = raw.select("doc_id", "page", "ocr_text", "reference_text", w_r.alias("words_ref"), wrong(F.col("_cer"), n_r, n_o).alias("error_chars"), wrong(F.col("_wer"), w_r, w_o).alias("error_words"))
    return _with_metrics(counted, metrics)


def _with_metrics(pages: DataFrame, names: list[str]) -> DataFrame:
    own = page_metrics(pages.withColumn("page", F.struct("page", "words_ref", "error_chars", "error_words")))
    return own.select("doc_id", "page.page", *names, "page.words_ref", "page.error_chars", "page.error_words")


def measured_documents(read: DataFrame, true: DataFrame, mark: str = PAGE_MARK) -> DataFrame:
    """A row for each document of either side: totals over the pages that both have, and the pages that one lacks.

    ``doc_id, pages, missing_pages, total_chars, total_words, cer, car, wer, war,
    q_preserved, q_total, q_pct, c_preserved, c_total, c_pct, overall``; totals
    begin anew with each document, and a document without a page in common has
    none, with error rates of 0.
    """
    pairs = aligned_pages(read, true, mark)
    lacking = pairs.groupBy("doc_id").agg(F.count_if(F.col("ocr_text").isNull() | F.col("reference_text").isNull()).alias("missing_pages"))
    total = page_counts(pairs).groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.sum("chars_ref").alias("total_chars"), F.sum("words_ref").alias("total_words"), F.sum("error_chars").alias("ec"), F.sum("error_words").alias("ew"),
        *[F.sum(c).alias(c) for c in ("q_preserved", "q_total", "c_preserved", "c_total")],
    )
    rows = lacking.join(total, "doc_id", "left").fillna(0)
    cer, wer = (F.col(e) / F.greatest(n, F.lit(1)) for e, n in (("ec", "total_chars"), ("ew", "total_words")))
    pct = lambda c: F.bround(F.col(f"{c}_preserved") / F.greatest(f"{c}_total", F.lit(1)) * 100, 1).alias(f"{c}_pct")
    return rows.select(
        "doc_id", "pages", "missing_pages", "total_chars", "total_words", F.bround(cer, 4).alias("cer"), F.bround(1 - cer, 4).alias("car"), F.bround(wer, 4).alias("wer"), F.bround(1 - wer, 4).alias("war"),
        "q_preserved", "q_total", pct("q"), "c_preserved", "c_total", pct("c"), F.bround((1 - cer) * 100, 1).alias("overall"),
    )


def quality_report(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, report``: totals of :func:`measured_documents` and the pages of :func:`page_counts` as Markdown tables."""
    cell = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |"))
    names = ["car", "war", "cer", "wer", "total_chars", "total_words", "pages", "missing_pages", "overall"]
    rows = [cell(F.lit(c), F.col(c).cast("string")) for c in names]
    rows += [cell(F.lit(name), F.format_string("%d/%d (%s%%)", f"{k}_preserved", f"{k}_total", F.col(f"{k}_pct").cast("string"))) for name, k in (("questions", "q"), ("choices", "c"))]
    kept = lambda k: F.format_string("%d/%d", f"{k}_preserved", f"{k}_total")
    line = cell(F.col("page").cast("string"), F.col("car").cast("string"), F.col("war").cast("string"), kept("q"), kept("c"))
    each = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", line.alias("t")))).alias("_pages"))
    head = [F.lit("| metric | value |"), F.lit("| --- | --- |")]
    tail = [F.lit(""), F.lit("| page | car | war | questions | choices |"), F.lit("|" + " --- |" * 5), F.transform("_pages", lambda x: x["t"])]
    return documents.join(each, "doc_id", "left").select("doc_id", F.concat_ws("\n", *head, *rows, *tail).alias("report"))


def most_alike(word: Column) -> Column:
    """How often the most frequent character of a word stands in it."""
    return F.array_max(F.transform(F.array_distinct(F.split(word, "")), lambda c: F.length(word) - F.length(F.replace(word, c, F.lit("")))))


def word_confidence(word: Column, in_lexicon: Column, bare_in_lexicon: Column, stem_in_lexicon: Column, near_term: Column) -> Column:
    """Confidence that a recognised word is right, from its length, scripts, repeats, the lexicon and its context."""
    n = F.length(word)
    arabic, latin = count(word, f"[{AR}]"), count(word, "[A-Za-z]")
    most = F.coalesce(most_alike(word), F.lit(0))
    share = arabic / (arabic + latin)
    score = (
        F.lit(1.0) - F.when(n <= 1, 0.5).when(n == 2, 0.2).otherwise(0.0)
        - F.when((arabic > 0) & (latin > 0), F.when((share > 0.3) & (share < 0.7), 0.3).otherwise(0.1)).otherwise(0.0)
        - F.when(most > n * 0.6, 0.3).otherwise(0.0) - F.when(most > n * 0.8, 0.3).otherwise(0.0)
        + F.when(in_lexicon, 0.15).otherwise(0.0) + F.when(bare_in_lexicon, 0.1).otherwise(0.0) + F.when(stem_in_lexicon, 0.05).otherwise(0.0)
        + F.when(near_term, 0.05).otherwise(0.0)
    )
    return F.when(n == 0, 0.0).when(arabic + latin == 0, 0.3).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(1.0), score)))


def rated_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``word, confidence`` for distinct words, with one lexicon lookup of three spellings; by ``near`` too if ``words`` says whether a term is."""
    keys = [c for c in ("word", "near") if c in words.columns]
    own = words.select(*keys).distinct()
    bare = F.regexp_replace("word", TASHKEEL, "")
    stem = F.when(bare.startswith("ال") & (F.length(bare) > 3), F.substring(bare, 3, 1 << 20))
    spelled = own.select("word").distinct().select("word", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("word").alias("term")), F.struct(F.lit(1).alias("k"), bare.alias("term")), F.struct(F.lit(2).alias("k"), stem.alias("term")))).alias("x"))
    hits = spelled.select("word", "x.k", "x.term").join(lexicon.select("term").distinct(), "term", "left_semi").groupBy("word").agg(F.collect_set("k").alias("hit"))
    has = lambda k: F.coalesce(F.array_contains("hit", k), F.lit(False))
    near = F.col("near") if "near" in keys else F.lit(False)
    return own.join(hits, "word", "left").select(*keys, F.bround(word_confidence(F.col("word"), has(0), has(1), has(2), near), 4).alias("confidence"))


def corrected_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``word, corrected, confidence, kind``: the decision for each distinct word (and ``near``); only doubtful ones meet the lexicon.

    A doubtful word of fair confidence takes the term most like it; one that
    finds none so, or of low confidence, a term that is half like it, with a mark.
    """
    from foliant.durable import written
    from foliant.operators.lexicon import candidate_pairs, spell_check

    keys = [c for c in ("word", "near") if c in words.columns]
    # four branches read what the lexicon says of each word, so it is written once
    rated = written(rated_words(words, lexicon).join(spell_check(words, lexicon).withColumnRenamed("term", "known"), "word", "left"))
    doubtful = rated.where((F.col("confidence") < SURE) & F.col("known").isNull() & (F.length("word") >= 2))
    tried = candidate_pairs(doubtful, lexicon, 2)
    like = tried.groupBy("word").agg(
        F.min(F.when((F.col("apart") <= 1) & (F.col("similarity") >= 0.7), F.struct((-F.col("similarity")).alias("s"), "term"))).alias("c"),
        F.min(F.when(F.col("similarity") >= 0.5, F.struct((-F.col("similarity")).alias("s"), "term"))).alias("f"),
    )
    like = like.select("word", F.col("c.term").alias("close"), (-F.col("c.s")).alias("close_s"), F.col("f.term").alias("far"), (-F.col("f.s")).alias("far_s"))
    w, known, fair = F.col("word"), F.col("known"), F.col("confidence") >= 0.7
    all_ = rated.join(like, "word", "left")
    kind = (
        F.when(F.length(w) < 2, "low").when(F.col("confidence") >= SURE, "exact").when(known == w, "lexicon").when(known.isNotNull(), "dictionary")
        .when(fair & F.col("close").isNotNull(), "confusion").otherwise("low_confidence")
    )
    text = F.when(kind == "dictionary", known).when(kind == "confusion", F.col("close")).when(F.col("far").isNotNull() & (kind == "low_confidence"), F.concat("far", F.lit(VERIFY))).otherwise(w)
    sure = F.when(kind == "low", 0.5).when(kind == "lexicon", 0.95).when(kind == "dictionary", 0.9).when(kind == "confusion", F.col("close_s")).otherwise(F.coalesce("far_s", "confidence"))
    return all_.select(*keys, text.alias("corrected"), F.when(kind == "exact", F.col("confidence")).otherwise(sure).alias("confidence"), kind.alias("kind"))


def _signs(words: list[str], text: str) -> list[bool] | None:
    """Whether a word that speaks for a term stands within three words of each; None if there is no such word."""
    if text.isascii() or not (told := [k for k, w in enumerate(words) if _SPEAKS.search(w)]):
        return None
    close = {k + d for k in told for d in range(-3, 4) if d}
    return [k in close and min(k, 3) + min(len(words) - 1 - k, 3) > 1 for k in range(len(words))]


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The letters of the words that may be decided, and whether a term is near; each once while a task remembers it."""
    from foliant.operators import wordwise

    seen: set[tuple[str, bool]] = set()
    for batch in batches:
        fresh: set[tuple[str, bool]] = set()
        for text in batch.column(0).to_pylist():
            if text is not None:
                words = wordwise.only_words(text)
                near = _signs(words, text)
                fresh.update(zip(words, near or repeat(False), strict=False))
        fresh -= seen
        if len(seen) >= wordwise.KNOWN:
            seen = set()
        seen |= fresh
        told = {(t, near) for w, near in fresh if len(w) > 1 and (t := _OTHER.sub("", w))}
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in told], pa.string()), pa.array([n for _, n in told], pa.bool_())], names=["word", "near"])


def _by_confidence(answers: dict[str, tuple[str, str, str]]) -> Callable:
    """A text with its doubtful words corrected, and the two counts, by what is decided for each word and sign."""
    from foliant.operators import wordwise

    def decide(key: tuple[str, bool]) -> tuple[str, int, int] | None:
        word, near = key
        letters = _OTHER.sub("", word) if len(word) > 1 else ""
        answer = answers.get(("+" if near else "-") + letters) if letters else None
        if answer is None:
            return None
        fixed, mark, kind = answer
        at = word.find(letters)
        new = word if at < 0 else word[:at] + fixed + word[at + len(letters) :]
        return new + mark, int(kind in ("confusion", "low", "low_confidence")), int(kind in ("low", "low_confidence"))

    far, close = (wordwise.Decided(lambda w, near=near: decide((w, near))) for near in (False, True))

    def change(text: str) -> tuple[str, int, int]:
        words = wordwise.only_words(text)
        near = _signs(words, text)
        found = [far[w] for w in words] if near is None else [(close if n else far)[w] for w, n in zip(words, near, strict=True)]
        doubtful = [x for x in found if x is not None]
        applied, low = sum(x[1] for x in doubtful), sum(x[2] for x in doubtful)
        if all(x is None or x[0] == w for w, x in zip(words, found, strict=True)):
            return text, applied, low
        parts = wordwise.words_of(text)
        first = 0 if parts[0] else 2
        for k, x in enumerate(found):
            if x is not None:
                parts[2 * k + first] = x[0]
        return "".join(parts), applied, low

    return change


def correct_by_confidence(docs: DataFrame, lexicon: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with doubtful words corrected where they stand, and ``corrections_applied, low_confidence_seen``.

    What becomes of a word depends on its letters and on whether a word that
    speaks for a term stands within three words, so each distinct pair of these
    is decided once.  Line ends and all other white space stay.  The two counts
    hold doubtful words that stay as they are too.  A null text stays null.
    """
    from foliant.durable import written
    from foliant.operators import wordwise

    pieces = wordwise.blank_pieces(F.col(text_col))
    letters = lambda p: F.regexp_replace(p, f"[^{AR}A-Za-z]", "")

    def asked(x: Column) -> Column:
        parts, told = x["p"], x["t"]
        steps = [k for k in range(-6, 7, 2) if k]  # words and white space take turns
        there = lambda i: sum((F.get(parts, i + k).isNotNull().cast("int") for k in steps), F.lit(0))
        near = lambda i: F.greatest(*[F.coalesce(F.get(told, i + k), F.lit(False)) for k in steps]) & (there(i) > 1)
        ask = lambda sign: F.transform(parts, lambda p, i: F.struct(i.alias("pos"), F.lit(1).alias("n"), F.when(F.length(p) > 1, F.concat(sign(i), letters(p))).alias("term")))
        # most texts have no word that speaks for a term, so its neighbours are looked for in the others alone
        each = F.when(F.exists(told, lambda t: t), ask(lambda i: F.when(near(i), "+").otherwise("-"))).otherwise(ask(lambda i: F.lit("-")))
        return F.filter(each, lambda q: F.length(q["term"]) > 1)

    questions = wordwise.bound(F.struct(pieces.alias("p"), F.transform(pieces, lambda p: p.rlike("|".join(CONTEXT))).alias("t")), asked)
    words = docs.select(F.col(text_col).alias("text")).mapInArrow(_distinct_words, "word string, near boolean").distinct()
    words = written(words)  # several branches read the distinct words, and each would split all texts again
    decided = corrected_words(words, lexicon).where("kind not in ('exact', 'lexicon')")
    mark = F.col("corrected").endswith(VERIFY)
    table = decided.select(
        F.concat(F.when(F.col("near"), "+").otherwise("-"), F.col("word")).alias("term"), F.when(mark, F.replace("corrected", F.lit(VERIFY))).otherwise(F.col("corrected")).alias("fixed"),
        F.when(mark, VERIFY).otherwise("").alias("mark"), F.col("kind"),
    )

    def change(p: Column, a: Column) -> Column:
        at = F.instr(p, letters(p))
        fixed = F.when(at > 0, F.concat(p.substr(F.lit(1), at - 1), a["fixed"], p.substr(at + F.length(letters(p)), F.length(p)))).otherwise(p)
        return F.concat(fixed, a["mark"])

    table = written(table)
    if (rows := wordwise.held(table)) is not None:
        answers = {r.term: (r.fixed, r.mark, r.kind) for r in rows}
        return wordwise.rewritten(docs, lambda: _by_confidence(answers), ["corrections_applied", "low_confidence_seen"], text_col)
    done = wordwise.answered(docs, questions, table, [text_col], "_decided")
    text = wordwise.put_back(F.col(text_col), pieces, F.col("_decided"), change)
    count = lambda kinds: F.coalesce(F.size(F.filter("_decided", lambda a: a["kind"].isin(*kinds))), F.lit(0))
    return done.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        count(("confusion", "low", "low_confidence")).alias("corrections_applied"), count(("low", "low_confidence")).alias("low_confidence_seen"),
    )


def confidence_summary(tokens: DataFrame, decided: DataFrame) -> DataFrame:
    """Tokens by kind of decision, with mean confidence."""
    return tokens.select(F.col("token").alias("word")).join(decided, "word").groupBy("kind").agg(F.count("*").alias("n"), F.bround(F.avg("confidence"), 4).alias("avg_confidence"))


def neighbours(tokens: DataFrame, reach: int = 3) -> DataFrame:
    """``doc_id, pos, token, context``: up to ``reach`` tokens on either side."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    left = F.collect_list("token").over(w.rowsBetween(-reach, -1))
    right = F.collect_list("token").over(w.rowsBetween(1, reach))
    return tokens.withColumn("context", F.concat(left, right))


def word_issues(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``doc_id, pos, token, issues`` of tokens that have any."""
    t, n = F.col("token"), F.length("token")
    most = most_alike(t)
    known = tokens.join(lexicon.select(F.col("term").alias("token")).distinct().withColumn("known", F.lit(True)), "token", "left")
    issues = F.array_compact(F.array(
        F.when(t.rlike(f"[{AR}]") & t.rlike("[A-Za-z]"), "mixed_script"), F.when(most > n * 0.5, "repeated_char"),
        F.when((n >= 3) & F.col("known").isNull() & ~t.rlike(f"^(?:{'|'.join(PREFIXES)})"), "unknown_word"),
    ))
    return known.where(n >= 2).select("doc_id", "pos", "token", issues.alias("issues")).where(F.size("issues") > 0)


def _issue_counter(terms: list[str]) -> Callable:
    """How many words of a text have two characters or more, how many of these repeat one too often, how many are unknown."""
    from foliant.operators import wordwise

    known = set(terms)

    def issues(word: str) -> int:
        n = len(word)
        if n < 2:
            return 0
        return 1 + (max(map(word.count, set(word))) > n * 0.5) + 2 * (n >= 3 and word not in known and not word.startswith(PREFIXES))

    decided = wordwise.Decided(issues)

    def count(text: str) -> tuple[int, int, int]:
        found = [decided[w] for w in wordwise.only_words(text)]
        both = found.count(4)
        return len(found) - found.count(0), found.count(2) + both, found.count(3) + both

    return count


def issue_counts(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``doc_id, repeated_char, unknown_word``: how many words of :func:`word_issues` have each, for documents with a word of two characters.

    A small lexicon goes to the texts, and rows that repeat an id are added up; for a large one the words are shuffled.
    """
    from foliant.operators import wordwise
    from foliant.operators.corpus import tokens

    names = ["repeated_char", "unknown_word"]
    if (rows := wordwise.held(lexicon.select("term").where("term is not null").distinct())) is not None:
        terms = [r.term for r in rows]
        each = wordwise.counted(docs.select("doc_id", "text"), lambda: _issue_counter(terms), ["_n", *names])
        return each.groupBy("doc_id").agg(F.sum("_n").alias("_n"), *[F.sum(c).alias(c) for c in names]).where("_n > 0").select("doc_id", *names)
    t = tokens(docs).where(F.length("token") >= 2)
    found = word_issues(t, lexicon).groupBy("doc_id").agg(*[F.count_if(F.array_contains("issues", x)).alias(x) for x in names])
    return t.select("doc_id").distinct().join(found, "doc_id", "left").fillna(0)


def improvement(before: DataFrame, after: DataFrame) -> DataFrame:
    """Issues of documents before and after a change, from two outputs of :func:`word_issues`."""
    b = before.groupBy("doc_id").agg(F.count("*").alias("before"))
    a = after.groupBy("doc_id").agg(F.count("*").alias("after"))
    both = b.join(a, "doc_id", "full").fillna(0)
    return both.withColumn("improvement", F.bround((F.col("before") - F.col("after")) / F.greatest("before", F.lit(1)), 4))


def quality_score(broken: Column, duplicates: Column, low: Column, spaces: Column) -> Column:
    """100 less bounded penalties, one decimal."""
    lost = F.least(broken * 0.5, F.lit(15.0)) + F.least(duplicates * 0.3, F.lit(10.0)) + F.least(low * 1.0, F.lit(20.0)) + F.least(spaces * 0.1, F.lit(5.0))
    return F.greatest(F.lit(0.0), F.bround(100.0 - lost, 1))
