"""Corpus queries: cleaning, pages, sentence chunks, ids, counts, text I/O."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators.boundaries import chunk_sentences_learnt as _learnt_chunks
from ..operators.chunks import chunk_counts as _chunk_counts, chunk_pages, chunk_sentences, clean_pages, \
    concat_pages, dense_chunk_ids, split_pages
from ..session import scratch_path
from ..sinks.files import append_rows, write_docs_as_text, write_many_files
from ..sources.files import read_page_files, read_text_dir
from .common import load, sql_chunks, sql_clean_pdf
from .retrieval import doc_chunks

PAGE_CHARS = 2000


def _docs(spark, d):
    return load(spark, d, "documents", ["doc_id", "text"])


def doc_clean(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", tx.clean_pdf_text("text").alias("text"))


def doc_clean_cased(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", tx.clean_pdf_text("text", lowercase=False).alias("text"))


def scan_doc_pages(spark: SparkSession, d: str) -> DataFrame:
    """The page table a PDF reader yields (fixed-size pages of documents)."""
    return split_pages(_docs(spark, d), "doc_id", "text", PAGE_CHARS)


def pages_concat(spark: SparkSession, d: str) -> DataFrame:
    """C1+C2: clean every page, then join a document's pages without separator."""
    return concat_pages(clean_pages(scan_doc_pages(spark, d)), "doc_id")


def pdf_chunks(spark: SparkSession, d: str) -> DataFrame:
    """C2-C4 PDF path: pages are cleaned, fused and chunked page by page (text
    files are not cleaned)."""
    return chunk_pages(scan_doc_pages(spark, d), "doc_id")


def chunk_sentences_q(spark: SparkSession, d: str) -> DataFrame:
    return doc_chunks(spark, d).select("doc_id", "pos", "text")


def chunk_sentences_learnt(spark: SparkSession, d: str) -> DataFrame:
    """C3 with boundaries learnt from all documents: abbreviations, collocations, starters."""
    return _learnt_chunks(_docs(spark, d), "doc_id", "text")


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """Sequential ids from 0 across all documents."""
    return dense_chunk_ids(_docs(spark, d), "doc_id", "text")


def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return _chunk_counts(doc_chunks(spark, d), "doc_id")


def phrase_removal(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", tx.remove_phrases("text").alias("text"))


def drop_header_lines(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", tx.drop_header_lines("text", 4).alias("text"))


def quote_block(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", tx.quote_block("text").alias("text"))


def peek_one(spark: SparkSession, d: str) -> DataFrame:
    """The first stored chunk (a limit is the feature here)."""
    return doc_chunks(spark, d).orderBy("doc_id", "pos").limit(1).select("doc_id", "pos", "text")


def scan_text_dir(spark: SparkSession, d: str) -> DataFrame:
    """S3: documents written as one text file each (its id, then its text) in folders
    per language, read back recursively with a ``*.txt`` filter."""
    path = scratch_path(spark, "textdir")
    docs = load(spark, d, "documents", ["lang", "doc_id", "text"])
    lines = docs.select("lang", F.concat_ws("\n", F.col("doc_id").cast("string"), "text").alias("value"))
    write_many_files(lines, path, ["lang"], "value")
    files = read_text_dir(spark, path)
    body = F.expr("substring(text, instr(text, '\n') + 1)")
    return files.select(F.substring_index("text", "\n", 1).cast("long").alias("doc_id"),
                        F.substring(body, F.lit(1), F.length(body) - 1).alias("text"))


def scan_page_files(spark: SparkSession, d: str) -> DataFrame:
    """S5 from files: a paginated book per language, its pages in document order. A book is
    written by many tasks, each a volume of it, and numbered from the first page to the last."""
    path = scratch_path(spark, "pages")
    pages = split_pages(load(spark, d, "documents", ["doc_id", "lang", "text"]).withColumn("key", F.struct("lang", "doc_id")), "key", "text", PAGE_CHARS)
    lines = pages.select("key.lang", "key.doc_id", "page_no", F.concat_ws("|", "key.doc_id", "page_no", F.replace("text", F.lit("\f"), F.lit(" "))).alias("value"))
    order = ["lang", "doc_id", "page_no"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("lang", "value").write.partitionBy("lang").option("lineSep", "\f").text(path)
    found = read_page_files(spark, path, by_folder=True)
    parts = F.split("text", r"\|", 3)
    return found.select(F.regexp_extract("path", "lang=([^/]+)", 1).alias("lang"), "page_no", parts[0].cast("long").alias("doc_id"),
                        parts[1].cast("int").alias("doc_page"), parts[2].alias("text"))


def chunks_append(spark: SparkSession, d: str) -> DataFrame:
    """K4: the chunk table written twice; the keyed append skips stored chunks."""
    path = scratch_path(spark, "chunks")
    chunks = doc_chunks(spark, d)
    append_rows(chunks, path, ["doc_id", "pos"])
    append_rows(chunks, path, ["doc_id", "pos"])
    return spark.read.parquet(path).select("doc_id", "pos", "text")


def chunks_append_plain(spark: SparkSession, d: str) -> DataFrame:
    """K4 without a key: the second write adds every chunk again, as the original."""
    path = scratch_path(spark, "chunks-plain")
    for _ in range(2):
        append_rows(doc_chunks(spark, d), path)
    return spark.read.parquet(path).select("doc_id", "pos", "text")


def scan_text_dir_flat(spark: SparkSession, d: str) -> DataFrame:
    """One folder of text files, not searched below."""
    path = scratch_path(spark, "textdir-flat")
    docs = load(spark, d, "documents", ["lang", "doc_id", "text"]).withColumn("text", F.regexp_replace("text", "\\R", " "))
    docs.select(F.concat_ws("|", "doc_id", "text").alias("value")).write.text(path)
    files = read_text_dir(spark, path, recursive=False)
    lines = files.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.select(F.substring_index("line", "|", 1).cast("long").alias("doc_id"), F.expr("substring(line, instr(line, '|') + 1)").alias("text"))


QUERIES = {
    "doc_clean": doc_clean,
    "doc_clean_cased": doc_clean_cased,
    "scan_doc_pages": scan_doc_pages,
    "pages_concat": pages_concat,
    "pdf_chunks": pdf_chunks,
    "chunk_sentences": chunk_sentences_q,
    "chunk_sentences_learnt": chunk_sentences_learnt,
    "chunk_ids": chunk_ids,
    "chunk_counts": chunk_counts,
    "phrase_removal": phrase_removal,
    "drop_header_lines": drop_header_lines,
    "quote_block": quote_block,
    "peek_one": peek_one,
    "scan_text_dir": scan_text_dir,
    "scan_page_files": scan_page_files,
    "chunks_append": chunks_append,
    "chunks_append_plain": chunks_append_plain,
    "scan_text_dir_flat": scan_text_dir_flat,
}

# ---------------------------------------------------------------------------
# DuckDB oracle SQL
# ---------------------------------------------------------------------------

_PAGES = (f"SELECT doc_id, CAST(i AS INTEGER) AS page_no, substring(text, CAST(i * {PAGE_CHARS} + 1 AS BIGINT), {PAGE_CHARS}) AS text "
          f"FROM (SELECT doc_id, text, unnest(range(CAST(greatest(ceil(length(text) / {PAGE_CHARS}.0), 1) AS BIGINT))) AS i "
          f"FROM documents)")
_CONCAT = (f"SELECT doc_id, string_agg({sql_clean_pdf('text')}, '' ORDER BY page_no) AS text "
           f"FROM ({_PAGES}) GROUP BY doc_id")
_PY_WS = r"[\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LINES = r"string_split_regex(text, '\r\n|[\n\v\f\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]')"

_WORD = r"""lower(rtrim(ltrim({0}, '"''([{{'), '"'')]}},;:!?'))"""
_GAP = r"[ \t\n\r\f\v]+"


def _word(token: str) -> str:
    return _WORD.format(token)


def _bare(word: str) -> str:
    return f"regexp_replace({word}, '[.]$', '')"


def _xlog(x: str, p: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 0 ELSE ({x}) * ln({p}) END)"


def _assoc(a: str, b: str, ab: str, n: str) -> str:
    rest, p, p1, p2 = f"({n} - {a} - {b} + {ab})", f"({b} / {n})", f"({ab} / {a})", f"(({b} - {ab}) / ({n} - {a}))"
    return (f"-2 * ({_xlog(ab, p)} + {_xlog(f'({a} - {ab})', f'(1 - {p})')} + {_xlog(f'({b} - {ab})', p)} + {_xlog(rest, f'(1 - {p})')}"
            f" - {_xlog(ab, p1)} - {_xlog(f'({a} - {ab})', f'(1 - {p1})')} - {_xlog(f'({b} - {ab})', p2)} - {_xlog(rest, f'(1 - {p2})')})")


_LEARNT = rf"""
WITH toks AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_GAP}'), lambda x: x <> '') AS t FROM documents),
one AS (SELECT {_word('token')} AS w FROM (SELECT unnest(t) AS token FROM toks)),
counts AS (SELECT {_bare('w')} AS word, count(*) FILTER (ends_with(w, '.')) AS w, count(*) FILTER (NOT ends_with(w, '.')) AS o FROM one
           GROUP BY 1 HAVING regexp_matches(word, '[\p{{L}}\p{{N}}]')),
total AS (SELECT sum(w + o)::DOUBLE AS n, sum(w)::DOUBLE / sum(w + o) AS p FROM counts),
abbr AS (SELECT word FROM (SELECT *, length(word) - length(replace(word, '.', '')) AS inner_n FROM counts), total WHERE w > 0 AND regexp_matches(word, '\p{{L}}')
         AND 2 * (w * (ln(0.99) - ln(p)) + o * (ln(1 - 0.99) - ln(1 - p))) * exp(-(length(word) - inner_n)) * (inner_n + 1) * pow((length(word) - inner_n)::DOUBLE, -o) >= 0.3),
after AS (SELECT {_word('x.a')} AS a, {_bare(_word('x.b'))} AS next FROM (
            SELECT unnest(list_transform(list_filter(range(1, len(t)), lambda i: regexp_matches(t[i], '[.!?]["'')\]]*$')), lambda i: {{'a': t[i], 'b': t[i + 1]}})) AS x
            FROM toks WHERE len(t) > 1)),
pairs AS (SELECT ends_with(a, '.') AS period, {_bare('a')} AS word, next, count(*)::DOUBLE AS m FROM after WHERE regexp_matches(next, '[\p{{L}}\p{{N}}]') GROUP BY ALL),
size AS (SELECT word, (w + o)::DOUBLE AS c FROM counts),
coll AS (SELECT pairs.word, pairs.next FROM pairs JOIN size a ON a.word = pairs.word JOIN size b ON b.word = pairs.next, total
         WHERE period AND m >= 2 AND regexp_matches(pairs.word, '^(\p{{L}}|[0-9][0-9.,-]*)$') AND m * n > a.c * b.c AND {_assoc('a.c', 'b.c', 'm', 'n')} >= 7.88),
starts AS (SELECT next, sum(m) AS m FROM pairs WHERE NOT period OR word NOT IN (SELECT word FROM abbr) GROUP BY next),
breaks AS (SELECT sum(m) AS k FROM starts),
starter AS (SELECT next AS word FROM starts JOIN size b ON b.word = next, total, breaks WHERE m * n > k * b.c AND {_assoc('k', 'b.c', 'm', 'n')} >= 30),
pieces AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (
             SELECT doc_id, string_split(regexp_replace(text, '([.!?]["'')\]]*)([ \t\n\r\f]+)', '\1\2' || chr(1), 'g'), chr(1)) AS p FROM documents)),
ends AS (SELECT doc_id, i, piece, {_word(f"list_last(regexp_split_to_array(rtrim(piece, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '{_GAP}'))")} AS last,
                {_bare(_word(f"regexp_split_to_array(ltrim(piece, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '{_GAP}')[1]"))} AS first FROM pieces),
placed AS (SELECT doc_id, i, piece, first, lag(last) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM ends),
judged AS (SELECT doc_id, i, piece, coalesce(ends_with(before, '.') AND first NOT IN (SELECT word FROM starter)
             AND ({_bare('before')} IN (SELECT word FROM abbr) OR ({_bare('before')}, first) IN (SELECT (word, next) FROM coll)), false) AS held FROM placed),
merged AS (SELECT doc_id, s, trim(string_agg(piece, '' ORDER BY i), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS text FROM (
             SELECT *, sum(CASE WHEN held THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM judged) GROUP BY doc_id, s)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS pos, text FROM merged WHERE text <> ''"""

ORACLE = {
    "chunk_sentences_learnt": _LEARNT,
    "doc_clean": f"SELECT doc_id, {sql_clean_pdf('text')} AS text FROM documents",
    "doc_clean_cased": f"SELECT doc_id, {sql_clean_pdf('text', False)} AS text FROM documents",
    "scan_doc_pages": _PAGES,
    "pages_concat": _CONCAT,
    "pdf_chunks": f"SELECT doc_id, pos, text FROM ({sql_chunks(f'({_CONCAT})')})",
    "chunk_sentences": f"SELECT doc_id, pos, text FROM ({sql_chunks()})",
    "chunk_ids": f"SELECT doc_id, pos, row_number() OVER (ORDER BY doc_id, pos) - 1 AS seq_id FROM ({sql_chunks()})",
    "chunk_counts": f"SELECT doc_id, count(*) AS n_chunks FROM ({sql_chunks()}) GROUP BY doc_id",
    "phrase_removal": ("SELECT doc_id, replace(replace(replace(lower(text), 'key takeaways from this chapter', ''), "
                       "'we recommend reading this chapter on varsity to learn more and understand the concepts in-depth.', ''), "
                       "'varsity', '') AS text FROM documents"),
    "drop_header_lines": (
        f"SELECT doc_id, lower(regexp_replace(array_to_string(list_slice(l, 5, greatest(len(l), 1)), chr(10)), "
        f"'^{_PY_WS}+|{_PY_WS}+$', '', 'g')) AS text FROM ("
        f"SELECT doc_id, CASE WHEN s[len(s)] = '' THEN list_slice(s, 1, len(s) - 1) ELSE s END AS l FROM ("
        f"SELECT doc_id, {_LINES} AS s FROM documents))"),
    "quote_block": "SELECT doc_id, regexp_replace(replace(text, '•', '  *'), '(?m)^', '> ', 'g') AS text FROM documents",
    "peek_one": f"SELECT doc_id, pos, text FROM ({sql_chunks()}) ORDER BY chunk_id LIMIT 1",
    "scan_text_dir": "SELECT doc_id, text FROM documents",
    "scan_page_files": (f"SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id, page_no) - 1 AS INTEGER) AS page_no, doc_id, "
                        f"page_no AS doc_page, replace(p.text, chr(12), ' ') AS text FROM ({_PAGES}) p JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)"),
    "chunks_append": f"SELECT doc_id, pos, text FROM ({sql_chunks()})",
    "chunks_append_plain": f"SELECT doc_id, pos, text FROM ({sql_chunks()}), range(2)",
    "scan_text_dir_flat": r"SELECT doc_id, regexp_replace(text, '\r\n|[\n\v\f\r\x{85}\x{2028}\x{2029}]', ' ', 'g') AS text FROM documents",
}


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Documents land as text files, named by their ids in a folder per language; the streaming
    ingest chunks them into a parquet table (available-now trigger); the table is read back."""
    from ..streaming.ingest import ingest_text_stream
    src = scratch_path(spark, "stream-src")
    folders = write_docs_as_text(load(spark, d, "documents", ["lang", "doc_id", "text"]), src, ["lang"], name_col="doc_id")
    sink = scratch_path(spark, "stream-sink")
    ingest_text_stream(spark, folders, sink, doc_id_pattern="doc_id=(\\d+)",
                       checkpoint=scratch_path(spark, "stream-ckpt"), compression="zstd")
    return spark.read.parquet(sink).select(F.col("doc").alias("doc_id"), "pos", "text")


QUERIES["stream_ingest"] = stream_ingest
ORACLE["stream_ingest"] = f"SELECT doc_id, pos, text FROM ({sql_chunks()})"
