"""Shared helpers for query plans: pruned table loads and SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def load(spark: SparkSession, sf_dir: str, name: str, cols: list[str] | None = None) -> DataFrame:
    """Read one parquet table; selecting ``cols`` here keeps the scan's
    ReadSchema to those columns. Tasks follow the files' splits."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def r6(col: str) -> F.Column:
    """Doubles are compared after rounding to 6 decimals."""
    return F.round(F.col(col), 6).alias(col)


# --------------------------------------------------------------------------
# SQL fragments (DuckDB dialect) mirroring the Spark column functions
# --------------------------------------------------------------------------

def sql_sentences(text: str) -> str:
    """List of sentences of ``text`` (same rule as functions.text.sentence_split)."""
    return (f"list_filter(list_transform(string_split(regexp_replace({text}, "
            r"""'([.!?]["'')\]]*)[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)), """
            r"""lambda x: regexp_replace(x, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')), lambda x: x <> '')""")


def sql_bucket(tok: str, dim: int = 256) -> str:
    return f"(('0x' || substr(md5({tok}), 1, 8))::BIGINT % {dim})"


def sql_tokens(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"


def sql_chunks(source: str = "documents", id_col: str = "doc_id", text_col: str = "text",
               clean: bool = False) -> str:
    """SELECT producing (doc_id, pos, chunk_id, text) sentence chunks."""
    text = sql_clean_pdf(text_col) if clean else text_col
    return (f"SELECT {id_col} AS doc_id, CAST(pos - 1 AS INTEGER) AS pos, "
            f"CAST({id_col} AS BIGINT) * 16777216 + (pos - 1) AS chunk_id, text FROM ("
            f"SELECT {id_col}, unnest(s) AS text, generate_subscripts(s, 1) AS pos FROM ("
            f"SELECT {id_col}, {sql_sentences(text)} AS s FROM {source}))")


def sql_clean_pdf(text: str, lowercase: bool = True) -> str:
    out = f"""trim(regexp_replace({text}, '[^A-Za-z0-9.,;:!?()''"]+', ' ', 'g'))"""
    return f"lower({out})" if lowercase else out


def sql_sparse(source: str, id_expr: str, text_col: str, dim: int = 256) -> str:
    """SELECT producing the sparse hashed bag of words (id, b, c)."""
    return (f"SELECT id, {sql_bucket('t', dim)} AS b, count(*) AS c FROM ("
            f"SELECT {id_expr} AS id, unnest({sql_tokens(text_col)}) AS t FROM {source}) GROUP BY ALL")


def sql_topk_buckets(cands: str, queries: str, k: int = 5, distinct: bool = False) -> str:
    """Given CTE names of sparse vectors (id, b, c) for candidates and queries,
    a SELECT of (qid, cid, sim, rank) - the exact cosine top-k."""
    sims = (f"SELECT q.id AS qid, c.id AS cid, sum(q.c * c.c) / sqrt(qn.n2 * cn.n2) AS sim "
            f"FROM {queries} q JOIN {cands} c ON q.b = c.b "
            f"JOIN (SELECT id, sum(c * c) AS n2 FROM {queries} GROUP BY id) qn ON qn.id = q.id "
            f"JOIN (SELECT id, sum(c * c) AS n2 FROM {cands} GROUP BY id) cn ON cn.id = c.id "
            f"GROUP BY q.id, c.id, qn.n2, cn.n2")
    if distinct:
        sims = f"SELECT qid, min(cid) AS cid, sim FROM ({sims}) GROUP BY qid, sim"
    return (f"SELECT qid, cid, sim, rank FROM (SELECT *, CAST(row_number() OVER "
            f"(PARTITION BY qid ORDER BY sim DESC, cid) AS INTEGER) AS rank FROM ({sims})) WHERE rank <= {k}")
