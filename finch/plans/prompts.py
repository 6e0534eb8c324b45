"""Context, prompt, profile, evaluation and generation queries.

Fixtures: profiles from ``customer`` (location from ``nation``, other fields
by key arithmetic); each customer asks the benchmark question whose position
is its key modulo the number of questions; evaluation triples are embeddings
3i, 3i+1, 3i+2 (true, RAG, non-RAG) and, for text, a user turn's reply (true)
against the next reply (RAG) and the next user turn (non-RAG).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.constants import (EMPLOYMENT_VALUES, HORIZON_VALUES, MISSING_FIELD, PROMPT_LOCAL_NOTEBOOK,
                                   PROMPT_NO_HITS, PROMPT_NON_RAG, PROMPT_NON_RAG_NOTEBOOK, PROMPT_RAG,
                                   PROMPT_RAG_NOTEBOOK, RISK_VALUES)
from ..operators import evaluate as ev
from ..operators import prompts as pr
from ..operators.ordering import broadcast_if_small, dense_index
from .common import load, sql_chunks, sql_sparse, sql_topk_buckets
from .retrieval import rag_hits

PROFILE_COLS = ["age", "location", "income", "employment", "debt", "assets", "credit_score",
                "financial_goals", "risk_tolerance", "time_horizon"]


def _pick(values, idx):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def profiles(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    n = load(spark, d, "nation", ["n_nationkey", "n_name"])
    k = F.col("c_custkey")
    j = c.join(broadcast_if_small(n), c.c_nationkey == n.n_nationkey, "left")
    return j.select(
        k.alias("profile_id"),
        (F.pmod(k * 7, F.lit(60)) + 18).cast("int").alias("age"),
        F.col("n_name").alias("location"),
        (F.pmod(k * 7919, F.lit(100)) * 1000 + 20000).cast("int").alias("income"),
        _pick(EMPLOYMENT_VALUES, F.pmod(k, F.lit(3))).alias("employment"),
        (F.pmod(k * 31, F.lit(50)) * 1000).cast("int").alias("debt"),
        (F.floor(F.abs("c_acctbal")) * 10).cast("int").alias("assets"),
        (F.pmod(k * 13, F.lit(551)) + 300).cast("int").alias("credit_score"),
        F.concat(F.lit("Grow savings for "), F.lower("c_mktsegment")).alias("financial_goals"),
        _pick(RISK_VALUES, F.pmod(k * 5 + 1, F.lit(3))).alias("risk_tolerance"),
        _pick(HORIZON_VALUES, F.pmod(k * 7 + 2, F.lit(3))).alias("time_horizon"))


def asks(spark: SparkSession, d: str) -> DataFrame:
    """(profile fields..., item_id, question): one question per profile."""
    bench = load(spark, d, "benchmark", ["item_id", "text"])
    nq = bench.count()
    qs = dense_index(bench, ["item_id"], "q_idx").select("q_idx", "item_id", F.col("text").alias("question"))
    p = profiles(spark, d).withColumn("q_idx", F.pmod(F.col("profile_id"), F.lit(nq)))
    return p.join(broadcast_if_small(qs), "q_idx").drop("q_idx")


def contexts(spark, d):
    return pr.build_context(rag_hits(spark, d), "item_id")


def context_build(spark, d):
    return contexts(spark, d).select("item_id", "context", F.char_length("context").alias("n_chars"))


def prompt_rag(spark, d):
    """Every profile's question with its retrieved context (RAG frame;
    an empty context when nothing was found)."""
    a = asks(spark, d).join(contexts(spark, d), "item_id", "left") \
                      .withColumn("context", F.coalesce("context", F.lit("")))
    return a.select("profile_id", "item_id", pr.render(PROMPT_RAG).alias("prompt"))


def prompt_fallback(spark, d):
    """The answer frame that falls back to the no-context template."""
    a = asks(spark, d).join(contexts(spark, d), "item_id", "left")
    prompt = F.when(F.col("context").isNull(), pr.render(PROMPT_NO_HITS)).otherwise(pr.render(PROMPT_RAG))
    return a.select("profile_id", "item_id", prompt.alias("prompt"))


def _with_context(spark, d):
    return asks(spark, d).join(contexts(spark, d), "item_id", "left").withColumn("context", F.coalesce("context", F.lit("")))


def prompt_notebook(spark, d):
    """The notebook's retrieval frame (no location; life event absent -> N/A)."""
    a = _with_context(spark, d)
    return a.select("profile_id", "item_id", pr.render(PROMPT_RAG_NOTEBOOK, columns=a.columns).alias("prompt"))


def prompt_notebook_non_rag(spark, d):
    """The notebook's frame without retrieval (three examples)."""
    a = asks(spark, d)
    return a.select("profile_id", "item_id", pr.render(PROMPT_NON_RAG_NOTEBOOK, columns=a.columns).alias("prompt"))


def prompt_notebook_local(spark, d):
    """The notebook's frame for a local model (no life events)."""
    return _with_context(spark, d).select("profile_id", "item_id", pr.render(PROMPT_LOCAL_NOTEBOOK).alias("prompt"))


def answer_lines(spark, d):
    """A local model's answers, split into lines."""
    answers = pr.generate(prompt_notebook_local(spark, d), ["profile_id", "item_id"], "prompt", pr.StubGenerator)
    return answers.select("profile_id", F.posexplode(F.split("response", "\n")).alias("line_no", "line"))


def prompt_non_rag(spark, d):
    return asks(spark, d).select("profile_id", "item_id", pr.render(PROMPT_NON_RAG).alias("prompt"))


def raw_profiles(spark, d):
    """Profiles as typed-in text, with bad values injected by key."""
    p = profiles(spark, d)
    k = F.col("profile_id")

    def bad(col, mod, value):
        return F.when(F.pmod(k, F.lit(mod)) == 0, F.lit(value)).otherwise(F.col(col).cast("string")).alias(col)
    return p.select("profile_id", bad("age", 17, "unknown"), "location", bad("income", 19, "12.5k"),
                    bad("employment", 23, "Retired"), F.col("debt").cast("string").alias("debt"),
                    F.col("assets").cast("string").alias("assets"),
                    F.col("credit_score").cast("string").alias("credit_score"), "financial_goals",
                    bad("risk_tolerance", 29, "Extreme"), bad("time_horizon", 31, "Forever"))


def profile_validate(spark, d):
    return pr.validate_profiles(raw_profiles(spark, d)).select("profile_id", "age", "income", "valid", "reason")


def eval_scores(spark, d):
    """P8 on stored vectors: triples (3i, 3i+1, 3i+2) = (true, RAG, non-RAG). Every
    case stays; one that lacks a vector has no score with it."""
    e = load(spark, d, "embeddings", ["vec_id", "embedding"])
    role = F.pmod("vec_id", F.lit(3))
    g = (e.groupBy(F.floor(F.col("vec_id") / 3).alias("case_id"))
          .agg(*[F.first(F.when(role == r, F.col("embedding")), ignorenulls=True).alias(n)
                 for r, n in ((0, "t"), (1, "r"), (2, "n"))]))
    s = ev.score_vectors(g, "t", "r", "n")
    return s.select("case_id", F.round("rag_score", 6).alias("rag_score"), F.round("non_rag_score", 6).alias("non_rag_score"))


def eval_text_scores(spark, d):
    """P8 on answer texts with the hashed embedder, as sparse equi-joins. Every
    case stays; a missing or empty answer has no score."""
    conv = load(spark, d, "conversations", ["conv_id", "turn", "role", "text"])
    cases = conv.where(F.col("role") == "user").select("conv_id", F.col("turn").alias("q_turn"))
    sv = ev.sparse_vectors(conv, ["conv_id", "turn"], "text")

    def side(offset):
        return (cases.join(sv, (cases.conv_id == sv.conv_id) & (sv.turn == cases.q_turn + offset))
                     .select(cases.conv_id, "q_turn", "b", "c"))
    keys = ["conv_id", "q_turn"]
    t, r, n = side(1), side(3), side(2)
    rag = ev.sparse_cosine(t, r, keys).withColumnRenamed("sim", "rag_score")
    non = ev.sparse_cosine(t, n, keys).withColumnRenamed("sim", "non_rag_score")
    return cases.join(rag, keys, "left").join(non, keys, "left").select(
        *keys, F.round("rag_score", 6).alias("rag_score"), F.round("non_rag_score", 6).alias("non_rag_score"))


def generate_answers(spark, d):
    """The generator plug-in over every RAG prompt (stub model)."""
    return pr.generate(prompt_rag(spark, d), ["profile_id", "item_id"], "prompt", pr.StubGenerator)


QUERIES = {
    "context_build": context_build,
    "prompt_rag": prompt_rag,
    "prompt_fallback": prompt_fallback,
    "prompt_notebook": prompt_notebook,
    "prompt_notebook_non_rag": prompt_notebook_non_rag,
    "prompt_notebook_local": prompt_notebook_local,
    "answer_lines": answer_lines,
    "prompt_non_rag": prompt_non_rag,
    "profile_validate": profile_validate,
    "eval_scores": eval_scores,
    "eval_text_scores": eval_text_scores,
    "generate_answers": generate_answers,
}

# ---------------------------------------------------------------------------
# DuckDB oracle SQL
# ---------------------------------------------------------------------------


def _lit(s):
    return "'" + s.replace("'", "''") + "'"


def _list(xs):
    return "[" + ", ".join(_lit(x) for x in xs) + "]"


def _render(template, persona=None, absent=()):
    parts = []
    for kind, v in (pr.template_pieces(template, persona) if persona else pr.template_pieces(template)):
        if kind == "lit":
            parts.append(_lit(v))
        elif v in absent:
            parts.append(f"'{MISSING_FIELD}'")
        else:
            parts.append(f"coalesce(CAST({v} AS VARCHAR), '{MISSING_FIELD}')")
    return " || ".join(parts)


_PROFILES = f"""
profiles AS (
  SELECT c_custkey AS profile_id,
    CAST((c_custkey * 7) % 60 + 18 AS INTEGER) AS age, n_name AS location,
    CAST((c_custkey * 7919) % 100 * 1000 + 20000 AS INTEGER) AS income,
    {_list(EMPLOYMENT_VALUES)}[c_custkey % 3 + 1] AS employment,
    CAST((c_custkey * 31) % 50 * 1000 AS INTEGER) AS debt,
    CAST(floor(abs(c_acctbal)) * 10 AS INTEGER) AS assets,
    CAST((c_custkey * 13) % 551 + 300 AS INTEGER) AS credit_score,
    'Grow savings for ' || lower(c_mktsegment) AS financial_goals,
    {_list(RISK_VALUES)}[(c_custkey * 5 + 1) % 3 + 1] AS risk_tolerance,
    {_list(HORIZON_VALUES)}[(c_custkey * 7 + 2) % 3 + 1] AS time_horizon
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
qs AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS q_idx, item_id, text AS question FROM benchmark),
asks AS (SELECT p.*, qs.item_id, qs.question FROM profiles p
         JOIN qs ON qs.q_idx = p.profile_id % (SELECT count(*) FROM benchmark)),
chunks AS ({sql_chunks()}),
cv AS ({sql_sparse('chunks', 'chunk_id', 'text')}),
qv AS ({sql_sparse('benchmark', 'item_id', 'text')}),
hits AS (SELECT h.qid AS item_id, h.rank, c.text FROM ({sql_topk_buckets('cv', 'qv', 5)}) h JOIN chunks c ON c.chunk_id = h.cid),
ctx AS (SELECT item_id, substring(string_agg(text, ' ' ORDER BY rank), 1, 20000) AS context FROM hits GROUP BY item_id)"""

_RAW = f"""
raw AS (
  SELECT profile_id,
    CASE WHEN profile_id % 17 = 0 THEN 'unknown' ELSE CAST(age AS VARCHAR) END AS age,
    CASE WHEN profile_id % 19 = 0 THEN '12.5k' ELSE CAST(income AS VARCHAR) END AS income,
    CASE WHEN profile_id % 23 = 0 THEN 'Retired' ELSE employment END AS employment,
    CAST(debt AS VARCHAR) AS debt, CAST(assets AS VARCHAR) AS assets, CAST(credit_score AS VARCHAR) AS credit_score,
    CASE WHEN profile_id % 29 = 0 THEN 'Extreme' ELSE risk_tolerance END AS risk_tolerance,
    CASE WHEN profile_id % 31 = 0 THEN 'Forever' ELSE time_horizon END AS time_horizon
  FROM profiles)"""


def _reason():
    checks = [f"CASE WHEN TRY_CAST({c} AS INTEGER) IS NULL THEN '{c}' END"
              for c in ("age", "income", "debt", "assets", "credit_score")]
    for c, vals in (("employment", EMPLOYMENT_VALUES), ("risk_tolerance", RISK_VALUES), ("time_horizon", HORIZON_VALUES)):
        checks.append(f"CASE WHEN NOT coalesce({c} IN ({', '.join(_lit(v) for v in vals)}), false) THEN '{c}' END")
    return "array_to_string(list_filter([" + ", ".join(checks) + "], lambda x: x IS NOT NULL), ',')"


_SPARSE_CONV = f"""
sv AS ({sql_sparse('conversations', "{'conv_id': conv_id, 'turn': turn}", 'text')}),
svx AS (SELECT id.conv_id AS conv_id, id.turn AS turn, b, c FROM sv),
cases AS (SELECT conv_id, turn AS q_turn FROM conversations WHERE role = 'user'),
side_t AS (SELECT k.conv_id, k.q_turn, s.b, s.c FROM cases k JOIN svx s ON s.conv_id = k.conv_id AND s.turn = k.q_turn + 1),
side_r AS (SELECT k.conv_id, k.q_turn, s.b, s.c FROM cases k JOIN svx s ON s.conv_id = k.conv_id AND s.turn = k.q_turn + 3),
side_n AS (SELECT k.conv_id, k.q_turn, s.b, s.c FROM cases k JOIN svx s ON s.conv_id = k.conv_id AND s.turn = k.q_turn + 2)"""


def _sparse_cos(x, y):
    return f"""(SELECT nx.conv_id, nx.q_turn, coalesce(d.dot, 0) / sqrt(nx.n2 * ny.n2) AS sim
  FROM (SELECT conv_id, q_turn, sum(c * c) AS n2 FROM {x} GROUP BY ALL) nx
  JOIN (SELECT conv_id, q_turn, sum(c * c) AS n2 FROM {y} GROUP BY ALL) ny USING (conv_id, q_turn)
  LEFT JOIN (SELECT a.conv_id, a.q_turn, sum(a.c * b.c) AS dot FROM {x} a JOIN {y} b
             ON a.conv_id = b.conv_id AND a.q_turn = b.q_turn AND a.b = b.b GROUP BY ALL) d USING (conv_id, q_turn))"""


_ASKED = "(SELECT a.*, coalesce(ctx.context, '') AS context FROM asks a LEFT JOIN ctx USING (item_id))"


def _answer(prompt):
    """What the stub model says: the first line that asks, and the prompt's length."""
    line = r"trim(regexp_extract(prompt, '(?m)^[ \t]*(Your Question:[^\n]*)', 1))"
    said = f"'Here is some advice.' || chr(10) || chr(10) || {line} || chr(10) || chr(10) || 'Answer length ' || length(prompt) || '.'"
    return said.replace("prompt", f"({prompt})")


ORACLE = {
    "context_build": f"WITH {_PROFILES} SELECT item_id, context, CAST(length(context) AS INTEGER) AS n_chars FROM ctx",
    "prompt_rag": (f"WITH {_PROFILES} SELECT profile_id, item_id, {_render(PROMPT_RAG)} AS prompt FROM "
                   f"(SELECT a.*, coalesce(ctx.context, '') AS context FROM asks a LEFT JOIN ctx USING (item_id))"),
    "prompt_fallback": (f"WITH {_PROFILES} SELECT profile_id, item_id, CASE WHEN context IS NULL THEN "
                        f"{_render(PROMPT_NO_HITS)} ELSE {_render(PROMPT_RAG)} END AS prompt FROM "
                        f"(SELECT a.*, ctx.context FROM asks a LEFT JOIN ctx USING (item_id))"),
    "prompt_notebook": (f"WITH {_PROFILES} SELECT profile_id, item_id, {_render(PROMPT_RAG_NOTEBOOK, absent=('life_event',))} AS prompt FROM {_ASKED}"),
    "prompt_notebook_non_rag": (f"WITH {_PROFILES} SELECT profile_id, item_id, "
                                f"{_render(PROMPT_NON_RAG_NOTEBOOK, absent=('life_event',))} AS prompt FROM asks"),
    "prompt_notebook_local": f"WITH {_PROFILES} SELECT profile_id, item_id, {_render(PROMPT_LOCAL_NOTEBOOK)} AS prompt FROM {_ASKED}",
    "answer_lines": (f"WITH {_PROFILES}, a AS (SELECT profile_id, {_answer(_render(PROMPT_LOCAL_NOTEBOOK))} AS response FROM {_ASKED}) "
                     f"SELECT profile_id, CAST(n - 1 AS INTEGER) AS line_no, line FROM (SELECT profile_id, unnest(l) AS line, "
                     f"generate_subscripts(l, 1) AS n FROM (SELECT profile_id, string_split(response, chr(10)) AS l FROM a))"),
    "generate_answers": (f"WITH {_PROFILES} SELECT profile_id, item_id, CAST(1 AS INTEGER) AS attempt, {_answer(_render(PROMPT_RAG))} AS response FROM {_ASKED}"),
    "prompt_non_rag": f"WITH {_PROFILES} SELECT profile_id, item_id, {_render(PROMPT_NON_RAG)} AS prompt FROM asks",
    "profile_validate": (f"WITH {_PROFILES}, {_RAW} SELECT profile_id, TRY_CAST(age AS INTEGER) AS age, "
                         f"TRY_CAST(income AS INTEGER) AS income, {_reason()} = '' AS valid, {_reason()} AS reason FROM raw"),
    "eval_scores": """
WITH t AS (SELECT vec_id // 3 AS case_id, vec_id % 3 AS role, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT case_id, any_value(e) FILTER (WHERE role = 0) AS t, any_value(e) FILTER (WHERE role = 1) AS r,
             any_value(e) FILTER (WHERE role = 2) AS n FROM t GROUP BY case_id)
SELECT case_id,
  round(list_inner_product(t, r) / sqrt(list_inner_product(t, t) * list_inner_product(r, r)), 6) AS rag_score,
  round(list_inner_product(t, n) / sqrt(list_inner_product(t, t) * list_inner_product(n, n)), 6) AS non_rag_score
FROM g""",
    "eval_text_scores": (f"WITH {_SPARSE_CONV} SELECT cases.conv_id, cases.q_turn, round(r.sim, 6) AS rag_score, "
                         f"round(n.sim, 6) AS non_rag_score FROM cases LEFT JOIN {_sparse_cos('side_t', 'side_r')} r USING (conv_id, q_turn) "
                         f"LEFT JOIN {_sparse_cos('side_t', 'side_n')} n USING (conv_id, q_turn)"),
}
