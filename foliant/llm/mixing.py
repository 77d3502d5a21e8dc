"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm._common import cut, drop_cut

#: Rounds of raking at most; raking ends when no factor moves by more than SETTLED of itself.
ROUNDS, SETTLED = 24, 1e-9
#: Default targets are the shares of the data to this power, made to sum to 1 again: 1 keeps the mix, 0 makes it even.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 1.0}
#: Share of all tokens to be sampled, in expectation, if the targets allow it.
RATE = 0.7
#: No source, language or topic is asked for more than this share of its own tokens.
SLACK = 0.9
#: A marginal further from its target than this is reported.
TOLERANCE = 0.01
#: Languages, and topics, of which the driver holds the sums; more are an error.
FEW = 2_000
#: Stands for a null source, language or topic.
NONE = "(none)"
#: Without a column of topics, a topic is the first of these whose mark occurs in the text in lower case, or else OTHER.
TOPICS, OTHER = (("legal", "license"), ("contact", "@"), ("secret", "token ="), ("table", " | ")), "prose"

Targets = dict[str, dict[str, float]]


def topic_of(text: Column) -> Column:
    """Topic of a text by marks in it."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), None
    for name, mark in TOPICS:
        out = F.when(F.contains(low, F.lit(mark)), name) if out is None else out.when(F.contains(low, F.lit(mark)), name)
    return out.otherwise(OTHER)


def _goals(name: str, sums: dict[str, float], targets: Targets | None) -> dict[str, float]:
    """Target shares of the languages or topics that have tokens."""
    wanted = (targets or {}).get(name)
    raw = {k: v ** TEMPER[name] for k, v in sums.items()} if wanted is None else {k: wanted.get(k, 0.0) for k in sums}
    total = sum(raw.values())
    if total <= 0:
        raise ValueError(f"no {name} of the data has a target")
    return {k: v / total for k, v in raw.items()}


def _looked_up(key: Column, values: dict[str, float]) -> Column:
    """The value of a language or topic as an expression over a literal map."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv]), key)


def rake(cells: DataFrame, rate: float = RATE, targets: Targets | None = None, strict: bool = False) -> DataFrame:
    """``cells`` (source, lang, topic, w) with the probability ``p`` of each.

    The sums of ``w * p`` by source, by language and by topic are the target
    shares of one total.  A round scales by source, then language, then topic;
    since probabilities end at 1, the sums that it scales by are those of
    ``w * min(1, factors)``, so what a full cell cannot give, others of its source,
    language or topic do.  The total is ``rate`` of all tokens or, if some value has
    too few for its target, as much as leaves it ``SLACK`` of its own.

    ``targets`` may give shares by ``source``, ``lang`` or ``topic``; values that are
    not named get nothing, and named ones without tokens leave their share to the
    others.  By default targets are tempered shares of the data.  Sources are
    rows of a table throughout; of languages and topics there are ``FEW`` at most.
    If a marginal stays over ``TOLERANCE`` from its target, as where too few cells
    hold any tokens, there is a warning, or an error if ``strict``.
    """
    by = {}
    for name in ("lang", "topic"):
        sums = cells.groupBy(name).agg(F.sum("w").alias("w")).limit(FEW + 1).collect()
        if len(sums) > FEW:
            raise ValueError(f"more than {FEW} values of {name}; mix by coarser ones")
        by[name] = {r[0]: r[1] for r in sums}
    goal = {name: _goals(name, sums, targets) for name, sums in by.items()}
    wanted = (targets or {}).get("source")
    if wanted is None:
        raw = F.pow("own", F.lit(TEMPER["source"]))
    else:
        raw = F.coalesce(_looked_up(F.col("source"), wanted), F.lit(0.0)) if wanted else F.lit(0.0)
    # a row for each source with its cells, so that scaling by source takes no shuffle
    own = cells.groupBy("source").agg(F.sum("w").alias("own"), F.sort_array(F.collect_list(F.struct("lang", "topic", "w"))).alias("cells"))
    state = cut(own.withColumns({"raw": raw, "fs": F.lit(1.0)}))
    total, norm, least = state.agg(F.sum("own"), F.sum("raw"), F.min(F.when(F.col("raw") > 0, F.col("own") / F.col("raw")))).first()
    if not norm:
        raise ValueError("no source of the data has a target")
    bound = min([least * norm / total, *(by[k][v] / total / g for k, goals in goal.items() for v, g in goals.items() if g > 0)])
    amount = total * min(rate, SLACK * bound)
    share = {name: dict.fromkeys(goals, 1.0) for name, goals in goal.items()}
    share["lang"] = dict.fromkeys(goal["lang"], amount / total)

    def given(lang: Column, topic: Column) -> Column:
        return F.least(F.lit(1.0), F.col("fs") * _looked_up(lang, share["lang"]) * _looked_up(topic, share["topic"]))

    for _ in range(ROUNDS):
        have = F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["w"] * given(c["lang"], c["topic"]))
        ratio = F.when(F.col("have") > 0, F.col("raw") / norm * amount / F.col("have")).otherwise(0.0)
        new = cut(state.withColumn("have", have).withColumn("ratio", ratio).withColumn("fs", F.col("fs") * F.col("ratio")).drop("have"))
        drop_cut(state)
        moved, state = 0.0, new.drop("ratio")
        each = new.select("fs", F.when(F.col("raw") > 0, F.abs(F.col("ratio") - 1)).alias("moved"), F.inline("cells"))
        for name in ("lang", "topic"):
            sums = each.groupBy(name).agg(F.sum(F.col("w") * given(F.col("lang"), F.col("topic"))), F.max("moved")).collect()
            have = {r[0]: r[1] for r in sums}
            scale = {v: goal[name][v] * amount / x if x > 0 else 0.0 for v, x in have.items()}
            moved = max([moved, *(r[2] or 0.0 for r in sums), *(abs(x - 1) for v, x in scale.items() if goal[name][v] > 0)])
            share[name] = {v: f * scale.get(v, 1.0) for v, f in share[name].items()}
        if moved <= SETTLED:
            break
    if moved > TOLERANCE:
        said = f"after {ROUNDS} rounds some source, language or topic is {moved:.1%} from its target: too few cells hold tokens for all targets at once"
        if strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    return state.select("source", "fs", F.inline("cells")).select("source", "lang", "topic", "w", given(F.col("lang"), F.col("topic")).alias("p"))


def mix(
    docs: DataFrame,
    rate: float = RATE,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 17,
    targets: Targets | None = None,
    topic_col: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """``id_col, source, lang, topic, n_tokens, probability, sampled``, one row per input row.

    Token weights of the cells (source, language, topic) are raked to the
    targets, see :func:`rake`.  A document is sampled with the probability of its
    cell; a hash of the id decides, so a repeated run samples the same documents.

    Tokens are runs of characters other than blanks.  A null source, language or
    topic is a value of its own; a null text is empty, has no tokens and takes its
    cell's probability, a cell without tokens the probability ``rate``.  Rows
    that repeat an id share its hash; a null id has one too.  An empty table
    gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    unit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"), none("source").alias("source"), none("lang").alias("lang"), (none(topic_col) if topic_col else topic_of(F.col(text_col))).alias("topic"),
            F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")).cast("long").alias("n_tokens"), unit.alias("u"),
        )
    )
    cells = cut(rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").cast("double").alias("w")).where("w > 0"))
    if cells.isEmpty():
        probability = rows.withColumn("probability", F.lit(float(rate)))
    else:
        known = cut(rake(cells, rate, targets, strict).select("source", "lang", "topic", F.round("p", 6).alias("p")))
        probability = rows.join(known, ["source", "lang", "topic"], "left").withColumn("probability", F.coalesce("p", F.lit(float(rate))))
    return probability.select(
        F.col("id").alias(id_col), "source", "lang", "topic", "n_tokens", "probability", (F.col("u") < F.col("probability")).alias("sampled")
    )


def keep_mixed(docs: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", targets: Targets | None = None) -> DataFrame:
    """The sampled rows of ``docs`` with their columns unchanged; rows that repeat an id stay or go by their cells."""
    cell = ["source", "lang", "topic"]
    names = {c: f"{c}_{uuid.uuid4().hex}" for c in [id_col, *cell]}  # names that no column of the input has
    stay = mix(docs, rate, id_col, text_col, targets=targets).where("sampled").select(*[F.col(c).alias(n) for c, n in names.items()]).distinct()
    own = {"source": F.coalesce(docs["source"].cast("string"), F.lit(NONE)), "lang": F.coalesce(docs["lang"].cast("string"), F.lit(NONE)), "topic": topic_of(docs[text_col])}
    same = docs[id_col].eqNullSafe(F.col(names[id_col]))
    for c in cell:
        same = same & (own[c] == F.col(names[c]))
    return docs.join(stay, same, "left_semi")


def oracle(rate: float = RATE, seed: int = 17) -> str:
    """The same in DuckDB's SQL over the table ``documents``, its rounds written out."""
    cases = " ".join(f"WHEN contains(lower(coalesce(text, '')), '{mark}') THEN '{name}'" for name, mark in TOPICS)
    sql = [
        f"""WITH r AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
        CASE {cases} ELSE '{OTHER}' END AS topic,
        len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+')) AS n_tokens,
        ('0x' || substr(md5('{seed}:' || doc_id::VARCHAR), 1, 12))::BIGINT / 281474976710656.0 AS u FROM documents)""",
        "w AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS w FROM r GROUP BY ALL HAVING w > 0)",
    ]
    for k, power in TEMPER.items():
        sql.append(f"g_{k} AS MATERIALIZED (SELECT {k}, x, pow(x, {power}) / sum(pow(x, {power})) OVER () AS g FROM (SELECT {k}, sum(w) AS x FROM w GROUP BY {k}))")
    bounds = " UNION ALL ".join(f"SELECT x / (SELECT sum(w) FROM w) / g AS b FROM g_{k}" for k in TEMPER)
    sql.append(f"n AS MATERIALIZED (SELECT (SELECT sum(w) FROM w) * least({rate}, {SLACK} * min(b)) AS amount FROM ({bounds}))")
    for k in TEMPER:
        sql.append(f"t_{k} AS MATERIALIZED (SELECT {k}, g * amount AS t FROM g_{k}, n)")
    sql.append("x0 AS MATERIALIZED (SELECT source, lang, topic, w, amount / (SELECT sum(w) FROM w) AS f FROM w, n)")
    n = 0
    for _ in range(ROUNDS):
        for k in TEMPER:
            sql.append(
                f"x{n + 1} AS MATERIALIZED (SELECT x.source, x.lang, x.topic, w, f * t / sum(w * least(1.0, f)) OVER (PARTITION BY x.{k}) AS f FROM x{n} x JOIN t_{k} USING ({k}))"
            )
            n += 1
    sql.append(f"p AS (SELECT source, lang, topic, round(least(1.0, f), 6) AS p FROM x{n})")
    return ",\n".join(sql) + (
        f"\nSELECT doc_id, r.source, r.lang, r.topic, n_tokens, coalesce(p, {rate}) AS probability, u < coalesce(p, {rate}) AS sampled "
        "FROM r LEFT JOIN p ON r.source = p.source AND r.lang = p.lang AND r.topic = p.topic"
    )
