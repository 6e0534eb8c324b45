"""The README's usage example, on the smallest data set."""

from pyspark.sql import functions as F

from helpers import SMALL
from finch.functions.constants import PROMPT_RAG
from finch.functions.vectors import HASH_DIM
from finch.operators import transactions as tr
from finch.operators.chunks import chunk_sentences
from finch.operators.prompts import build_context, render
from finch.operators.retrieval import embed_buckets, knn_topk


def test_readme_example(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    questions = spark.read.parquet(f"{SMALL}/benchmark.parquet").select(
        F.col("item_id").alias("qid"), F.col("text").alias("question"))
    chunks = embed_buckets(chunk_sentences(docs, "doc_id", "text"), "text")
    hits = knn_topk(chunks, embed_buckets(questions, "question"), cand_id="doc_id", cand_pos="pos", cand_vec="buckets",
                    query_id="qid", query_vec="buckets", kind="buckets", dim=HASH_DIM, k=5)
    texts = chunks.select(F.col("doc_id").alias("cid"), F.col("pos").alias("cpos"), "text")
    ctx = build_context(hits.join(texts, ["cid", "cpos"]), "qid")
    asked = questions.join(ctx, "qid", "left")
    prompts = asked.select("qid", render(PROMPT_RAG, columns=asked.columns).alias("prompt"))
    assert prompts.count() == questions.count()
    assert "Age: N/A" in prompts.first().prompt

    txn = spark.createDataFrame([("01/02/2023", "SQ *COFFEE CA 12", "4.50"), ("01/03/2023", "Grocer NY", "20.00")],
                                "Date string, Description string, Amount string")
    rows = tr.key_strings(tr.clean_descriptions(txn))
    prompt = tr.batch_prompts(tr.assign_batches(rows, ["Date", "Description", "Amount"])).first().prompt
    assert prompt.endswith("01/02/2023 - sq coffee - 4.50,01/03/2023 - grocer - 20.00")
