"""The line rules and all fourteen passes against sequential loops."""

import random
import re

from pyspark.sql import functions as F

from foliant.functions import rewrite
from foliant.operators import layout, lexicon, metrics
from foliant.operators.lexicon import apply_term_fixes
from foliant.plans import qa
from test_wordwise import corrected

SPACE = "[\\s  -     　]"
ENDS = tuple(".؟!:؛\"»")
LIKE = lexicon.confusion_table()
TERMS = ["كتاب", "الطاقة", "القوة", "Energy", "سرعة", "طالب", "مدرسة"]


def strip(s):
    return re.sub(f"^{SPACE}+|{SPACE}+$", "", s)


def merged(text):
    rows, out, i = [strip(x) for x in text.split("\n")], [], 0
    while i < len(rows):
        s = rows[i]
        special = s.startswith(("#", "---", "[", "(", ">", "**", "- ", "س")) or re.match(r"\d+[.\-)]", s)
        after = rows[i + 1] if i + 1 < len(rows) else ""
        if s and not special and len(s) < 80 and not s.endswith(ENDS) and after and not after.startswith(("#", "---", "[", "(", ">")):
            out.append(f"{s} {after}")
            i += 2
        else:
            out.append(s)
            i += 1
    return "\n".join(out)


def limited(text):
    out = []
    for x in text.split("\n"):
        s = strip(x)
        if s and not s.startswith(("#", "---", "[", "**", ">", "- ")) and [strip(y) for y in out[-2:]] == [s, s]:
            continue
        out.append(x)
    return "\n".join(out)


def tabled(text):
    out, held = [], []

    def flush():
        if len(held) > 1:
            width = max(map(len, held))
            full = [r + [""] * (width - len(r)) for r in held]
            out.extend("| " + " | ".join(r) + " |" for r in [full[0], ["---"] * width, *full[1:]])
            out.append("")
        elif held:
            out.append("\t".join(held[0]))
        held.clear()

    for x in text.split("\n"):
        if "|" in x or x.count("\t") >= 2 or len(re.findall(r"[ \t\n\x0b\f\r]{3,}", x)) >= 2:
            parts = x.split("|") if "|" in x else x.split("\t") if "\t" in x else re.split(r"[ \t\n\x0b\f\r]{3,}", x)
            held.append([c for p in parts if (c := strip(p))])
        else:
            flush()
            out.append(x)
    flush()
    return "\n".join(out)


LINES = ["", "", "ab", "ab", "ab", "tail.", "# head", "- item", "1) first", "س3 ?", "a | b", "c|d|e", "x\ty\tz", "p   q   r", " ab ", "---", "(أ) نعم", "> note", "one   two", "ab ", "long " * 20, "|", "end:"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["\n".join(rng.choice(LINES[: rng.choice([5, 9, 23])]) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_line_rules_are_the_loops(spark):
    own = texts(400, 1)
    rows = spark.createDataFrame([(t,) for t in own], "text string").select("text", layout.merged_pairs(F.col("text")).alias("m"), layout.limited_runs(F.col("text")).alias("l"), layout.tables_in(F.col("text")).alias("t")).collect()
    for r in rows:
        assert (r.m, r.l, r.t) == (merged(r.text), limited(r.text), tabled(r.text)), r.text


def test_many_lines_and_long_words(spark):
    big = "\n".join(["a | b"] * 30_000 + ["same"] * 30_000) + "\n" + "x" * 300_000
    r = spark.createDataFrame([(big,)], "text string").select(layout.tables_in(F.col("text")).alias("t"), layout.limited_runs(F.col("text")).alias("l")).first()
    assert r.t == tabled(big) and r.l == limited(big)
    lex = spark.createDataFrame([("Energy",)], "term string")
    assert metrics.correct_by_confidence(spark.createDataFrame([(1, big)], "doc_id long, text string"), lex).first().text.count("\n") == big.count("\n")


def bare(w):
    return re.sub("[ً-ْ]", "", w)


def spelled(w):
    if len(w) < 2 or w in TERMS:
        return w
    b = bare(w)
    if b in TERMS or (b.startswith("ال") and len(b) > 3 and b[2:] in TERMS):
        return b
    return min([t for t in TERMS if t.lower() == w.lower()], default=w) if re.fullmatch("[A-Za-z]+", w) else w


def close(w, reach, least):
    if len(w) < 3:
        return None
    found = [(-(1 - lexicon.weighted_distance(w, t, LIKE) / max(len(w), len(t))), t) for t in TERMS if abs(len(w) - len(t)) <= reach]
    found = sorted((s, t) for s, t in found if -s >= least)
    return (found[0][1], -found[0][0]) if found else None


def confident(text):
    """Word by word, with three words of context on either side."""
    pieces = [p for p in re.split(f"({SPACE}+)", text) if p]
    at = [i for i, p in enumerate(pieces) if not re.match(SPACE, p)]
    seen = low = 0
    out = list(pieces)
    for k, i in enumerate(at):
        w = pieces[i]
        x = re.sub("[^؀-ۿa-zA-Z]", "", w)
        if len(w) < 2 or not x:
            continue
        around = [pieces[j] for j in at[max(0, k - 3) : k] + at[k + 1 : k + 4]]
        ar, la, most = len(re.findall("[؀-ۿ]", x)), len(re.findall("[a-zA-Z]", x)), max(map(x.count, x))
        sure = 1 - (0.5 if len(x) <= 1 else 0.2 if len(x) == 2 else 0) - (0 if not (ar and la) else 0.3 if 0.3 < ar / (ar + la) < 0.7 else 0.1)
        sure -= 0.3 * (most > len(x) * 0.6) + 0.3 * (most > len(x) * 0.8)
        b = bare(x)
        sure += 0.15 * (x in TERMS) + 0.1 * (b in TERMS) + 0.05 * (b.startswith("ال") and len(b) > 3 and b[2:] in TERMS)
        sure += 0.05 * (len(around) > 1 and any(c in a for a in around for c in metrics.CONTEXT))
        sure = round(max(0.05, min(1.0, sure)), 4)
        if sure >= 0.9 and len(x) > 1 or x in TERMS:
            continue
        fixed, mark = x, ""
        known = spelled(x)
        if len(x) > 1 and (known != x or (b := bare(x)) in TERMS or (b.startswith("ال") and len(b) > 3 and b[2:] in TERMS)):
            if known == x:
                continue
            fixed = known
        else:
            seen += 1
            near = close(x, 1, 0.7) if sure >= 0.7 and len(x) > 1 else None
            if near:
                fixed = near[0]
            else:
                low += 1
                far = close(x, 2, 0.3) if len(x) > 1 else None
                if far and far[1] >= 0.5:
                    fixed, mark = far[0], metrics.VERIFY
        out[i] = w.replace(x, fixed, 1) + mark
    return "".join(out), seen, low


WORDS = ["كتاب", "كِتاب", "كناب", "الطاقة", "energy", "Energy", "en", "بب", "ببب", "ggg", "القوة،", "ظلاب", "طا!", "x", "ab12", "مدرسه", "aك", "aaكتا", "س1"]


def test_confidence_is_the_loop(spark):
    rng = random.Random(4)
    own = ["".join(rng.choice(WORDS) + rng.choice([" ", " ", "\n", "  ", "\n\n"]) for _ in range(rng.randint(0, 14))) for _ in range(150)]
    lex = spark.createDataFrame([(t,) for t in TERMS], "term string")
    docs = spark.createDataFrame([(k // 2, t) for k, t in enumerate([*own, own[0], "", None])], "doc_id long, text string")
    got = metrics.correct_by_confidence(docs, lex).collect()
    want = [(k // 2, *(confident(t) if t is not None else (None, 0, 0))) for k, t in enumerate([*own, own[0], "", None])]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_fourteen_passes_are_the_loop(spark):
    rng = random.Random(9)
    extra = ["الكلمة الكلمة", "---[صفحة 3]---", "الفصل الأول: مقدمة", "س2: احسب (أ) نعم (ب) لا", "H 2 + O 2", "3 x 5 = 15", "سنة 1O5", "energy كِتاب", "كناب القوة،", "نعم ؟", "a | b", "c | d"]
    own = ["\n".join(rng.choice(LINES[:12] + extra * 2) for _ in range(rng.randint(0, 10))) for _ in range(80)] + ["", None]
    own.append(own[0])
    fixes = {"مقدمة": "تمهيد", "نعم": "أجل"}
    memo, safe = {"ab": "AB", "احسب": "أحسب", "note": "Note"}, {"ab tail.", "# head"}
    lex = spark.createDataFrame([(t,) for t in TERMS], "term string")
    store = spark.createDataFrame([("general", a, b, 5, "auto") for a, b in memo.items()], "subject string, original string, corrected string, frequency long, source string")
    known = spark.createDataFrame([("general", p, 2) for p in safe], "subject string, phrase string, frequency long")
    docs = spark.createDataFrame([(k % 70, t) for k, t in enumerate(own)], "doc_id long, text string")
    got = qa.run(docs, fixes, True, lex, store, known).collect()

    def narrow(rule, now):
        out = spark.createDataFrame([(k, t) for k, t in enumerate(now)], "k int, t string").select("k", rule(F.col("t")).alias("t")).collect()
        return [r.t for r in sorted(out, key=lambda r: r.k)]

    now = [t or "" for t in own]
    count = [dict.fromkeys(qa.COUNTERS, 0) for _ in own]

    def note(name, new, n=None):
        for k, t in enumerate(new):
            count[k][name] += (t != now[k]) if n is None else n[k]
        return new

    now = note("unicode_fixes", narrow(rewrite.inspect_characters, now))
    now = note("broken_words_fixed", [re.sub("[؀-ۿa-zA-Z]+", lambda m: spelled(m.group()), t) for t in now])
    sentences = narrow(lambda t: rewrite.apply(t, rewrite.SENTENCES), now)
    now = note("spaces_fixed", narrow(lambda t: rewrite.apply(t, rewrite.SENTENCE_ENDS), [merged(t) for t in sentences]))
    now = narrow(rewrite.restore_layout, now)
    now = note("mcq_choices_separated", narrow(rewrite.validate_choices, now))
    now = note("tables_reconstructed", [tabled(t) for t in now])
    now = note("equations_validated", narrow(rewrite.validate_equations, now))
    now = note("numbers_checked", narrow(rewrite.validate_numbers, now))
    now = note("broken_words_fixed", narrow(lambda t: apply_term_fixes(t, fixes), now))
    now = note("punctuation_fixed", narrow(rewrite.cleanup_format, now))
    cut = [limited(t) for t in now]
    note("duplicates_removed", cut, [a.count("\n") - b.count("\n") for a, b in zip(now, cut)])
    now = narrow(lambda t: rewrite.apply(t, [rewrite.SAID_TWICE]), cut)
    done = [confident(t) for t in now]
    note("broken_words_fixed", now, [d[1] for d in done])
    note("low_confidence_marks", now, [d[2] for d in done])
    now = [d[0] for d in done]
    now = note("broken_words_fixed", [corrected(t, memo, safe) for t in now])
    want = [(k % 70, t, *c.values(), ["no text"] if own[k] is None else []) for k, (t, c) in enumerate(zip(now, count))]
    shown = [(r.doc_id, r.text, *[r[c] for c in qa.COUNTERS], r.errors) for r in got]
    assert sorted(map(str, shown)) == sorted(map(str, want))
    assert got[0].passes_applied == ["characters", "spelling", "sentences", "layout", "choices", "tables", "equations", "numbers", "terms", "format", "repeats", "verification", "confidence", "memory"]
