"""Context building, prompt rendering, profile validation and the text
generator plug-in."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.constants import (EMPLOYMENT_VALUES, HORIZON_VALUES, MAX_CONTEXT_CHARS, MISSING_FIELD, PERSONA,
                                   RISK_VALUES)

_FIELD = re.compile(r"\{(\w+)\}")


def build_context(hits: DataFrame, key: str, text_col: str = "text", rank_col: str = "rank",
                  max_chars: int = MAX_CONTEXT_CHARS) -> DataFrame:
    """Hit texts joined by a space in rank order, cut to ``max_chars``
    characters. One group is one question's top-k hits."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank_col).alias("r"), F.col(text_col).alias("t"))))
    ctx = F.array_join(F.transform(ordered, lambda x: x["t"]), " ")
    return hits.groupBy(key).agg(F.substring(ctx, 1, max_chars).alias("context"))


def template_pieces(template: str, persona: str = PERSONA) -> list[tuple[str, str]]:
    """Split a template into ("lit", text) and ("col", name) pieces."""
    template = template.replace("{persona}", persona)
    out, last = [], 0
    for m in _FIELD.finditer(template):
        out.append(("lit", template[last:m.start()]))
        out.append(("col", m.group(1)))
        last = m.end()
    out.append(("lit", template[last:]))
    return [p for p in out if p != ("lit", "")]


def render(template: str, persona: str = PERSONA, missing: str = MISSING_FIELD,
           columns: list[str] | None = None) -> Column:
    """Prompt text from a template whose ``{name}`` slots name columns; a
    missing value prints as ``missing``, and so does a slot whose column is
    absent when ``columns`` (the frame's columns) is given."""
    parts = []
    for kind, v in template_pieces(template, persona):
        if kind == "lit":
            parts.append(F.lit(v))
        elif columns is not None and v not in columns:
            parts.append(F.lit(missing))
        else:
            parts.append(F.coalesce(F.col(v).cast("string"), F.lit(missing)))
    return F.concat(*parts)


def validate_profiles(raw: DataFrame, int_cols=("age", "income", "debt", "assets", "credit_score"),
                      enums=(("employment", EMPLOYMENT_VALUES), ("risk_tolerance", RISK_VALUES),
                             ("time_horizon", HORIZON_VALUES))) -> DataFrame:
    """Type the integer fields (bad text -> reject) and check the enum fields.
    Adds ``valid`` and ``reason`` (comma-separated failing fields)."""
    checks = [F.when(F.col(c).try_cast("int").isNull(), F.lit(c)) for c in int_cols]
    checks += [F.when(~F.coalesce(F.col(c).isin(*vals), F.lit(False)), F.lit(c)) for c, vals in enums]
    reason = F.array_join(F.filter(F.array(*checks), lambda x: x.isNotNull()), ",")
    return raw.withColumn("reason", reason).select(
        *[F.col(c).try_cast("int").alias(c) if c in int_cols else F.col(c) for c in raw.columns],
        (F.col("reason") == "").alias("valid"), "reason")


def generate(df: DataFrame, key_cols: list[str], prompt_col: str,
             factory: Callable[[], Callable[[list[str]], list[str]]], attempt: int = 1) -> DataFrame:
    """Run a text generator over prompts in Arrow batches -> (keys..., attempt,
    response). ``factory()`` builds the generator (its client, its model) once per task, inside
    the worker; only the factory travels with the plan. Tests pass a deterministic stub."""
    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in key_cols) + ", attempt int, response string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = factory()
        for pdf in batches:
            out = pdf[key_cols].copy()
            out["attempt"] = attempt
            out["response"] = generator(pdf[prompt_col].tolist())
            yield out
    return df.select(*key_cols, prompt_col).mapInPandas(run, schema)


class StubGenerator:
    """Deterministic stand-in for a model: echoes the question line."""

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            q = next((ln.strip() for ln in p.splitlines() if ln.strip().startswith("Your Question:")), "")
            out.append(f"Here is some advice.\n\n{q}\n\nAnswer length {len(p)}.")
        return out
