"""Retrieval queries: exact cosine top-k, de-duplicated top-k, reports,
cosine projections and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.vectors import HASH_DIM, cosine, dense_to_sparse_string, sparse_string
from ..operators.ann import ann_topk as search_lists, build_index
from ..operators.chunks import chunk_sentences
from ..operators.ordering import broadcast_if_small
from ..operators.trained import bucket_weights, embed_trained as with_trained, signed_buckets, train_embedder, weighted_pairs
from ..operators.retrieval import HashingEmbedder, embed_buckets, embed_new, embed_with, knn_topk, search_report
from ..session import scratch_path
from ..sinks.keyed import embed_upsert as upsert_embeddings, read_keyed
from .common import load, r6, sql_chunks, sql_sparse, sql_tokens, sql_topk_buckets

EMBEDDING_DIM = 64              # width of the stored vectors


# ---------------------------------------------------------------------------
# shared Spark building blocks
# ---------------------------------------------------------------------------

def doc_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a text file: sentence chunks of the raw text."""
    return chunk_sentences(load(spark, d, "documents", ["doc_id", "text"]), "doc_id", "text")


def stored(df: DataFrame, name: str) -> DataFrame:
    """A small table, written to the shared folder and read back, so that its
    several uses do not compute it again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def label_centroids(emb: DataFrame) -> DataFrame:
    """Mean vector per label -> (label, centroid array<double>): one average per
    dimension in one map-side aggregate, so a hot label costs no more than a cold one."""
    means = [F.avg(F.col("embedding")[i].cast("double")) for i in range(EMBEDDING_DIM)]
    return stored(emb.groupBy("label").agg(F.array(*means).alias("centroid")), "centroids")


def rag_hits(spark: SparkSession, d: str, distinct: bool = False) -> DataFrame:
    """Top-5 chunks per benchmark question with the hashed embedder. Hits are
    stored; only the documents they name are split again for their texts."""
    qs = load(spark, d, "benchmark", ["item_id", "text"])
    hits = stored(knn_topk(embed_buckets(doc_chunks(spark, d), "text"), embed_buckets(qs, "text"),
                           cand_id="doc_id", cand_pos="pos", cand_vec="buckets", query_id="item_id", query_vec="buckets",
                           kind="buckets", dim=HASH_DIM, distinct_scores=distinct), "hits")
    hits = hits.select(F.col("qid").alias("item_id"), F.col("cid").alias("doc_id"), F.col("cpos").alias("pos"), "rank", "sim")
    docs = load(spark, d, "documents", ["doc_id", "text"]).join(broadcast_if_small(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    return hits.join(chunk_sentences(docs, "doc_id", "text"), ["doc_id", "pos"]).select("item_id", "doc_id", "pos", "rank", "sim", "text")


# ---------------------------------------------------------------------------
# queries
# ---------------------------------------------------------------------------

def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    """V2-V4: each label's centroid is a question over every stored vector."""
    emb = load(spark, d, "embeddings", ["vec_id", "embedding", "label"])
    hits = knn_topk(emb, label_centroids(emb), cand_id="vec_id", cand_vec="embedding",
                    query_id="label", query_vec="centroid", kind="dense", dim=EMBEDDING_DIM)
    return hits.select(F.col("qid").alias("label"), F.col("cid").alias("vec_id"), "rank", r6("sim"))


def rag_topk(spark: SparkSession, d: str) -> DataFrame:
    return rag_hits(spark, d).withColumn("sim", F.round("sim", 6))


def semantic_topk_dedup(spark: SparkSession, d: str) -> DataFrame:
    """V5: repeated texts and repeated scores are skipped."""
    return rag_hits(spark, d, distinct=True).withColumn("sim", F.round("sim", 6))


def topk_report(spark: SparkSession, d: str) -> DataFrame:
    """V6: printable result lines."""
    return search_report(rag_hits(spark, d)).select("item_id", "rank", "line")


def vector_cosine(spark: SparkSession, d: str) -> DataFrame:
    """V2 as a projection: every vector against its label's centroid (an
    equi-join on label with the small centroid table)."""
    emb = load(spark, d, "embeddings", ["vec_id", "embedding", "label"])
    cent = label_centroids(emb)
    return (emb.join(broadcast_if_small(cent), "label")
               .select("vec_id", "label", F.round(cosine("embedding", "centroid"), 6).alias("sim")))


def embed_text(spark: SparkSession, d: str) -> DataFrame:
    """V1, JVM-side default embedder; the vector is shown in sparse form."""
    ch = embed_buckets(doc_chunks(spark, d), "text")
    return ch.select("doc_id", "pos", F.size("buckets").alias("n_tokens"), sparse_string("buckets").alias("vec"))


def embed_text_udf(spark: SparkSession, d: str) -> DataFrame:
    """V1 through the plug-in path: the Python embedder in an Arrow pandas UDF."""
    ch = embed_with(doc_chunks(spark, d), "text", HashingEmbedder)
    return ch.select("doc_id", "pos", dense_to_sparse_string("embedding").alias("vec"))


def embed_incremental(spark: SparkSession, d: str) -> DataFrame:
    """K6: embed only chunks that are not stored yet and append them; the second
    run finds every chunk stored and adds nothing."""
    path = scratch_path(spark, "embedded")
    for _ in range(2):
        embed_new(doc_chunks(spark, d), path, ["doc_id", "pos"], lambda c: embed_buckets(c, "text").select("doc_id", "pos", "buckets"))
    return spark.read.parquet(path).select("doc_id", "pos", sparse_string("buckets").alias("vec"))


def plugin_topk_dedup(spark: SparkSession, d: str) -> DataFrame:
    """V1-V5 end to end with a plug-in: turns are embedded by the model, stored,
    searched as dense vectors, and repeated texts and scores are skipped."""
    path = scratch_path(spark, "plugin-vectors")
    conv = load(spark, d, "conversations", ["conv_id", "turn", "text"])
    embed_new(conv, path, ["conv_id", "turn"], lambda c: embed_with(c, "text", HashingEmbedder).select("conv_id", "turn", "embedding"))
    qs = embed_with(load(spark, d, "benchmark", ["item_id", "text"]), "text", HashingEmbedder)
    hits = knn_topk(spark.read.parquet(path), qs, cand_id="conv_id", cand_pos="turn", cand_vec="embedding", query_id="item_id",
                    query_vec="embedding", kind="dense", dim=HASH_DIM, distinct_scores=True)
    return hits.select(F.col("qid").alias("item_id"), F.col("cid").alias("conv_id"), F.col("cpos").cast("long").alias("turn"), "rank", F.round("sim", 6).alias("sim"))


LISTS = 16


def ann_topk(spark: SparkSession, d: str) -> DataFrame:
    """V7: the inverted file over every stored vector, asked with every 20th. All
    lists are probed here, so that the answer is the exact one."""
    emb = load(spark, d, "embeddings", ["vec_id", "embedding"])
    path = scratch_path(spark, "inverted-file")
    build_index(emb, path, id_col="vec_id", vec_col="embedding", dim=EMBEDDING_DIM, lists=LISTS)
    hits = search_lists(spark, path, emb.where(F.col("vec_id") % 20 == 0), query_id="vec_id", query_vec="embedding", dim=EMBEDDING_DIM, probes=LISTS)
    return hits.select(F.col("qid").alias("question"), F.col("cid").alias("vec_id"), "rank", r6("sim"))


def embed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """K6 as an update: the chunks of an earlier state of the documents are stored (some texts
    in draft, some documents not there yet, some that are gone by now), then brought up to date."""
    path = scratch_path(spark, "embedded-keyed")
    now = doc_chunks(spark, d)
    k = F.pmod("doc_id", F.lit(5))
    earlier = now.where(k != 1).withColumn("text", F.when(k == 2, F.concat(F.lit("Draft: "), "text")).otherwise(F.col("text")))
    gone = now.where(k == 3).withColumn("doc_id", -1 - F.col("doc_id"))
    for rows in (earlier.unionByName(gone), now):
        upsert_embeddings(rows, path, ["doc_id", "pos"], "text", lambda c: embed_buckets(c, "text"), buckets=8)
    return read_keyed(spark, path).select("doc_id", "pos", "text", sparse_string("buckets").alias("vec"))


WEIGHTED_WIDE = 256


def embed_weighted(spark: SparkSession, d: str) -> DataFrame:
    """V1 trained on the corpus, before its reduction: signed hashed words of every
    document, weighted by how few documents hold them."""
    docs = load(spark, d, "documents", ["doc_id", "text"]).select("doc_id", signed_buckets("text", WEIGHTED_WIDE).alias("ids"))
    weights = bucket_weights(docs.select("ids"), WEIGHTED_WIDE)
    pairs = F.transform(weighted_pairs(F.col("ids"), weights), lambda p: F.concat(p["b"].cast("string"), F.lit(":"), F.round(p["x"] * 1000).cast("long").cast("string")))
    return docs.select("doc_id", F.array_join(pairs, ",").alias("vec"))


def embed_trained(spark: SparkSession, d: str) -> DataFrame:
    """V1 to V4 with the trained embedder: the five documents nearest to each benchmark question."""
    docs = load(spark, d, "documents", ["doc_id", "text"])
    model = train_embedder(docs, "text")
    dim = model.basis.shape[1]
    asked = with_trained(load(spark, d, "benchmark", ["item_id", "text"]), "text", model, "v")
    hits = knn_topk(with_trained(docs, "text", model, "v"), asked, cand_id="doc_id", cand_vec="v", query_id="item_id", query_vec="v", dim=dim)
    return hits.select(F.col("qid").alias("item_id"), F.col("cid").alias("doc_id"), "rank", r6("sim"))


QUERIES = {
    "embed_weighted": embed_weighted,
    "embed_trained": embed_trained,
    "ann_topk": ann_topk,
    "embed_upsert": embed_upsert,
    "embed_incremental": embed_incremental,
    "semantic_topk": semantic_topk,
    "rag_topk": rag_topk,
    "semantic_topk_dedup": semantic_topk_dedup,
    "topk_report": topk_report,
    "vector_cosine": vector_cosine,
    "embed_text": embed_text,
    "embed_text_udf": embed_text_udf,
    "plugin_topk_dedup": plugin_topk_dedup,
}

# ---------------------------------------------------------------------------
# DuckDB oracle SQL
# ---------------------------------------------------------------------------

_CENTROIDS = """
ex AS (SELECT vec_id, CAST(label AS BIGINT) AS label, generate_subscripts(embedding, 1) AS i,
              CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
cent AS (SELECT label, i, avg(x) AS m FROM ex GROUP BY label, i),
vn AS (SELECT vec_id, sum(x * x) AS n2 FROM ex GROUP BY vec_id),
cn AS (SELECT label, sum(m * m) AS n2 FROM cent GROUP BY label)"""

_SQL_SEMANTIC = f"""
WITH {_CENTROIDS},
dots AS (SELECT c.label, ex.vec_id, sum(ex.x * c.m) AS dot FROM ex JOIN cent c ON ex.i = c.i GROUP BY c.label, ex.vec_id),
sims AS (SELECT dots.label, dots.vec_id, dot / (sqrt(vn.n2) * sqrt(cn.n2)) AS sim
         FROM dots JOIN vn USING (vec_id) JOIN cn ON cn.label = dots.label)
SELECT label, vec_id, rank, round(sim, 6) AS sim FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS INTEGER) AS rank FROM sims)
WHERE rank <= 5"""

_SQL_VCOS = f"""
WITH {_CENTROIDS},
dots AS (SELECT ex.vec_id, ex.label, sum(ex.x * c.m) AS dot FROM ex JOIN cent c ON ex.i = c.i AND ex.label = c.label
         GROUP BY ex.vec_id, ex.label)
SELECT vec_id, CAST(dots.label AS INTEGER) AS label, round(dot / sqrt(vn.n2 * cn.n2), 6) AS sim
FROM dots JOIN vn USING (vec_id) JOIN cn ON cn.label = dots.label"""


def _sql_rag(distinct: bool) -> str:
    return f"""
WITH chunks AS ({sql_chunks()}),
cv AS ({sql_sparse('chunks', 'chunk_id', 'text')}),
qv AS ({sql_sparse('benchmark', 'item_id', 'text')}),
hits AS ({sql_topk_buckets('cv', 'qv', 5, distinct)})
SELECT hits.qid AS item_id, chunks.doc_id, chunks.pos, hits.rank, hits.sim, chunks.text
FROM hits JOIN chunks ON chunks.chunk_id = hits.cid"""


def _round_sim(sql: str) -> str:
    return f"SELECT item_id, doc_id, pos, rank, round(sim, 6) AS sim, text FROM ({sql})"


_SQL_REPORT = f"""
SELECT item_id, rank, printf('Result %d (Score: %.3f): %s...', rank, sim, text) AS line
FROM ({_sql_rag(False)})"""

_SQL_EMBED = f"""
WITH chunks AS ({sql_chunks()}),
toks AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS t FROM chunks),
cnt AS (SELECT doc_id, pos, (('0x' || substr(md5(t), 1, 8))::BIGINT % 256) AS b, count(*) AS c FROM toks GROUP BY ALL)
SELECT ch.doc_id, ch.pos, CAST(coalesce(sum(cnt.c), 0) AS INTEGER) AS n_tokens,
       coalesce(string_agg(CAST(cnt.b AS VARCHAR) || ':' || CAST(cnt.c AS VARCHAR), ',' ORDER BY cnt.b), '') AS vec
FROM chunks ch LEFT JOIN cnt ON cnt.doc_id = ch.doc_id AND cnt.pos = ch.pos
GROUP BY ch.doc_id, ch.pos"""

ORACLE = {
    "embed_weighted": f"""
WITH toks AS (SELECT doc_id, unnest({sql_tokens('text')}) AS t FROM documents),
hashed AS (SELECT doc_id, (('0x' || substr(md5(t), 1, 8))::BIGINT % {2 * WEIGHTED_WIDE}) AS h FROM toks),
df AS (SELECT h % {WEIGHTED_WIDE} AS b, count(DISTINCT doc_id) AS df FROM hashed GROUP BY 1),
cells AS (SELECT doc_id, h % {WEIGHTED_WIDE} AS b, sum(CASE WHEN h < {WEIGHTED_WIDE} THEN 1 ELSE -1 END) AS n FROM hashed GROUP BY ALL HAVING n <> 0),
pairs AS (SELECT doc_id, b, n * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS x FROM cells JOIN df USING (b))
SELECT d.doc_id, coalesce(string_agg(b || ':' || round(x * 1000)::BIGINT, ',' ORDER BY b), '') AS vec
FROM documents d LEFT JOIN pairs p ON p.doc_id = d.doc_id GROUP BY d.doc_id""",
    "ann_topk": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sims AS (SELECT q.vec_id AS question, v.vec_id, list_inner_product(q.e, v.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(v.e, v.e)) AS sim
         FROM v q JOIN v ON q.vec_id % 20 = 0)
SELECT question, vec_id, rank, round(sim, 6) AS sim FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY sim DESC, vec_id) AS INTEGER) AS rank FROM sims) WHERE rank <= 5""",
    "embed_upsert": f"SELECT doc_id, pos, text, vec FROM ({_SQL_EMBED}) JOIN ({sql_chunks()}) USING (doc_id, pos)",
    "semantic_topk": _SQL_SEMANTIC,
    "rag_topk": _round_sim(_sql_rag(False)),
    "semantic_topk_dedup": _round_sim(_sql_rag(True)),
    "topk_report": _SQL_REPORT,
    "vector_cosine": _SQL_VCOS,
    "embed_text": _SQL_EMBED,
    "embed_text_udf": f"SELECT doc_id, pos, vec FROM ({_SQL_EMBED})",
    "embed_incremental": f"SELECT doc_id, pos, vec FROM ({_SQL_EMBED})",
    "plugin_topk_dedup": f"""
WITH turns AS (SELECT conv_id * 1000000 + turn AS key, text FROM conversations),
cv AS ({sql_sparse('turns', 'key', 'text')}),
qv AS ({sql_sparse('benchmark', 'item_id', 'text')}),
hits AS ({sql_topk_buckets('cv', 'qv', 5, True)})
SELECT qid AS item_id, cid // 1000000 AS conv_id, cid % 1000000 AS turn, rank, round(sim, 6) AS sim FROM hits""",
}
