"""Words looked up and put back, against naive loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.operators import memory, wordwise

TERMS = ["كتاب", "الطاقة", "طاقة", "Energy", "DNA", "pH"]
MARKS = "[ً-ْ]"


def spelled(word):
    """One word, step by step."""
    if len(word) < 2 or word in TERMS:
        return word
    bare = re.sub(MARKS, "", word)
    if bare in TERMS or (bare.startswith("ال") and len(bare) > 3 and bare[2:] in TERMS):
        return bare
    if re.fullmatch("[A-Za-z]+", word):
        return min([t for t in TERMS if t.lower() == word.lower()], default=word)
    return word


def some_texts(words, n, seed):
    rng = random.Random(seed)
    gaps = [" ", " ", " ", "  ", "\n", "\t", " ", ". ", "-", "1"]
    return ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("small", [50_000, 0])  # 0: the table is joined by shuffling
def test_spelling_of_texts(spark, monkeypatch, small):
    monkeypatch.setattr(wordwise, "SMALL", small)
    texts = [*some_texts(["كِتَاب", "كتاب", "الكتاب", "الكِتاب", "ENERGY", "energy", "dna", "Dna", "x", "ph", "ثقة", "a1b"], 60, 1), None, "", "energy energy", "energy energy"]
    rows = [(k % 50, t) for k, t in enumerate(texts)]
    lexicon = spark.createDataFrame([(t, "s") for t in TERMS + ["DNA"]], "term string, subject string")
    got = wordwise.spell_check_text(spark.createDataFrame(rows, "doc_id long, text string"), lexicon, count_col="n").collect()
    token = "[؀-ۿa-zA-Z]+"
    want = []
    for i, t in rows:
        fixed = None if t is None else re.sub(token, lambda m: spelled(m.group()), t)
        want.append((i, fixed, sum(spelled(w) != w for w in re.findall(token, t or ""))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert wordwise.spell_check_text(spark.createDataFrame([], "doc_id long, text string"), lexicon).collect() == []


def corrected(text, fixes, phrases):
    """Leftmost-longest phrases first, then words."""
    if text is None:
        return None
    pieces = [p for p in re.split(r"([\s ]+)", text) if p]
    out, i = [], 0
    while i < len(pieces):
        blank = re.match(r"[\s ]", pieces[i])
        n = 1 if blank else max([k for k in (7, 5, 3) if i + k <= len(pieces) and "".join(pieces[i : i + k]) in phrases], default=1)
        out.append("".join(pieces[i : i + n]) if n > 1 or blank else fixes.get(pieces[i], pieces[i]))
        i += n
    return "".join(out)


@pytest.mark.parametrize("small", [50_000, 0])
def test_phrases_are_protected(spark, monkeypatch, small):
    monkeypatch.setattr(wordwise, "SMALL", small)
    words = ["aa", "bb", "cc", "dd", "__x__", "ee"]
    fixes = {"s": {"aa": "AA", "cc": "C C", "__x__": "y", "ee": "zz"}, "t": {"bb": "BB"}}
    phrases = {"s": {"aa bb": 2, "bb cc": 3, "bb cc dd": 2, "cc dd aa bb": 5, "dd ee": 1, "aa aa": 2}, "t": {"bb aa": 9}}
    texts = [*some_texts(words, 120, 2), None, "", "aa bb cc dd", "aa bb cc dd"]
    rows = [(k % 90, ["s", "t", None][k % 5 % 3], t) for k, t in enumerate(texts)]
    store = spark.createDataFrame([(s, a, b, 2, "auto") for s, x in fixes.items() for a, b in x.items()] + [("s", "dd", "no", 1, "auto"), ("s", "bb", "b!", 1, "human")], "subject string, original string, corrected string, frequency long, source string")
    fixes["s"]["bb"] = "b!"
    known = spark.createDataFrame([(s, p, n) for s, x in phrases.items() for p, n in x.items()], "subject string, phrase string, frequency long")
    docs = spark.createDataFrame(rows, "doc_id long, subject string, text string").withColumn("term", F.lit(1))
    got = memory.correct(docs, store, known).collect()
    trusted = {s: {p for p, n in x.items() if n > 1} for s, x in phrases.items()}
    want = [(i, corrected(t, fixes.get(s, {}), trusted.get(s, ()))) for i, s, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    plain = memory.correct(docs, store).collect()
    assert sorted(map(str, map(tuple, plain))) == sorted(str((i, corrected(t, fixes.get(s, {}), ()))) for i, s, t in rows)
