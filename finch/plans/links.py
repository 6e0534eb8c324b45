"""Link-graph, sitemap and URL queries.

Fixtures: a wiki built from ``documents.doc_id`` (page d links to pages
3d+1, 7d+2 and 11d+5 modulo the document count, plus two external links;
page 0 is "index"), and a sitemap XML written from ``pages.url`` in page
order (every 7th URL gets a "%", some entries lack changefreq/priority).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import remove_phrases
from ..functions.urls import url_authority, url_file_name
from ..operators import links as lk
from ..operators import pages as pg
from ..operators.ordering import dense_index
from ..session import scratch_path
from ..sinks.files import write_ordered, write_text_by_file
from ..sources.files import read_sitemap
from .common import load
from .pages import PY_WS, sql_line_trim, sql_page_text

WIKI = "https://www.reddit.com/r/personalfinance/wiki/"
OTHER_WIKI = "https://www.reddit.com/r/investing/wiki/p"
EXTERNAL = "https://example.com/ref/"
SITEMAP_HEADER = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
URLS_PER_SITEMAP = 50000


# ---------------------------------------------------------------------------
# fixtures
# ---------------------------------------------------------------------------

def wiki_pages(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents", ["doc_id"])
    n = F.lit(docs.count())

    def name(x):
        return F.when(x == 0, F.lit("index")).otherwise(F.concat(F.lit("p"), x.cast("string")))

    i = F.col("doc_id")
    md = F.concat(
        F.lit("# Page "), i.cast("string"), F.lit("\nSee [first]("), F.lit(WIKI), name(F.pmod(i * 3 + 1, n)),
        F.lit(") and [second]("), F.lit(WIKI), name(F.pmod(i * 7 + 2, n)),
        F.lit(").\nAlso [third]("), F.lit(WIKI), name(F.pmod(i * 11 + 5, n)),
        F.lit(") or [ext]("), F.lit(EXTERNAL), i.cast("string"),
        F.lit(") and [other]("), F.lit(OTHER_WIKI), i.cast("string"), F.lit(")"))
    return docs.select(name(i).alias("title"), md.alias("content_md"))


def wiki_edges(spark, d):
    return lk.internal_links(lk.page_links(wiki_pages(spark, d)))


def _xml_escape(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def write_sitemap(spark: SparkSession, d: str) -> str:
    """Sitemap files (at most 50,000 URLs each, as the protocol allows)."""
    p = load(spark, d, "pages", ["page_id", "url"])
    i = F.col("page_id")
    loc = F.concat(F.col("url"), F.when(F.pmod(i, F.lit(7)) == 0, F.lit("%")).otherwise(F.lit("")))
    block = F.concat(
        F.lit("<url><loc>"), _xml_escape(loc), F.lit("</loc>"),
        F.when(F.pmod(i, F.lit(3)) != 0, F.lit("<changefreq>weekly</changefreq>")).otherwise(F.lit("")),
        F.when(F.pmod(i, F.lit(4)) != 0, F.concat(F.lit("<priority>0."), F.pmod(i, F.lit(10)).cast("string"),
                                                   F.lit("</priority>"))).otherwise(F.lit("")),
        F.lit("</url>"))
    files = (p.select(F.floor(i / URLS_PER_SITEMAP).alias("file_no"), i, block.alias("b"))
              .groupBy("file_no")
              .agg(F.concat(F.lit(SITEMAP_HEADER + "\n"),
                            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "b"))),
                                                     lambda s: s["b"]), "\n"),
                            F.lit("\n</urlset>\n")).alias("xml")))
    path = scratch_path(spark, "sitemap")
    files.write.mode("overwrite").partitionBy("file_no").text(path)
    return path


def sitemap(spark, d):
    sm = read_sitemap(spark, write_sitemap(spark, d))
    # position over all files, in (file, place in the file) order
    fno = F.regexp_extract("file", "file_no=(\\d+)", 1).cast("long")
    return dense_index(sm.withColumn("file", fno), ["file", "pos"], "n").withColumn("pos", F.col("n")).drop("file", "n")


def survivors(spark, d):
    """U7 then U8: no "%" URLs, and the first remaining URL skipped."""
    return lk.skip_first(lk.drop_percent_urls(sitemap(spark, d)), ["pos"])


def closure(spark, d):
    return lk.crawl(wiki_edges(spark, d))


# ---------------------------------------------------------------------------
# queries
# ---------------------------------------------------------------------------

def wiki_links(spark, d):
    return wiki_edges(spark, d).select("src", "pos", "url", "target")


def wiki_links_one_hop(spark, d):
    return lk.crawl(wiki_edges(spark, d), max_rounds=1).select("target", "url")


def wiki_closure(spark, d):
    return closure(spark, d).select("target", "url")


def url_domain(spark, d):
    return load(spark, d, "pages", ["page_id", "url"]).withColumn("domain", url_authority("url"))


def scan_sitemap_xml(spark, d):
    return sitemap(spark, d).select("pos", "loc", "changefreq", "priority", "domain", "sitemap_name")


def url_filter(spark, d):
    return survivors(spark, d).select("pos", "loc")


def url_topic(spark, d):
    return lk.with_topic(survivors(spark, d)).select("pos", "loc", "topic")


def topic_filter(spark, d):
    return lk.keep_topics(lk.with_topic(survivors(spark, d))).select("pos", "loc", "topic")


def url_file_name_q(spark, d):
    return lk.with_file_name(load(spark, d, "pages", ["page_id", "url"])).select("page_id", "url", "file")


def file_name_dedup(spark, d):
    return lk.file_name_dedup(lk.with_file_name(load(spark, d, "pages", ["url"])))


def url_union_distinct(spark, d):
    wiki = closure(spark, d).select(F.col("url"))
    sm = lk.drop_percent_urls(sitemap(spark, d)).select(F.col("loc").alias("url"))
    return wiki.unionByName(sm).distinct().agg(F.count(F.lit(1)).alias("n_urls"))


def url_counts(spark, d):
    """Distinct crawled links, and sitemap URLs without "%" (not distinct)."""
    ns = lk.drop_percent_urls(sitemap(spark, d)).select(F.count(F.lit(1))).scalar()
    return closure(spark, d).agg(F.countDistinct("url").alias("n_wiki_links"), ns.alias("n_sitemap_urls"))


def corpus_records(spark, d):
    """K3: one record per kept sitemap URL, in sitemap order: topic, then the
    lower-cased page text without the fixed phrases, then "###". A kept URL
    without a stored page has an empty text. Records are written in order, one
    Parquet file after another, and read back."""
    kept = lk.keep_topics(lk.with_topic(survivors(spark, d)))
    text = pg.trim_lines(pg.page_text_exact(load(spark, d, "pages", ["url", "html"]), "url"))
    j = kept.join(text, kept.loc == text.url, "left")
    rec = F.concat(F.col("topic"), F.lit("\n"), remove_phrases(F.coalesce("text", F.lit(""))), F.lit("\n###\n"))
    path = scratch_path(spark, "corpus")
    write_ordered(j.select("pos", rec.alias("record")), path, "pos")
    return spark.read.parquet(path)


def sink_text_by_file(spark, d):
    """K2+K5: trimmed page texts saved under their file names (one per name)."""
    p = lk.with_file_name(load(spark, d, "pages", ["url"]))
    keep = lk.file_name_dedup(p)
    html = load(spark, d, "pages", ["url", "html"]).join(keep, "url", "left_semi")
    texts = pg.trim_lines(pg.page_text_exact(html, "url").join(keep, "url"))
    path = scratch_path(spark, "by-file")
    write_text_by_file(texts, path)
    return spark.read.parquet(path).select("file", "text")


QUERIES = {
    "wiki_links": wiki_links,
    "wiki_links_one_hop": wiki_links_one_hop,
    "wiki_closure": wiki_closure,
    "url_domain": url_domain,
    "scan_sitemap_xml": scan_sitemap_xml,
    "url_filter": url_filter,
    "url_topic": url_topic,
    "topic_filter": topic_filter,
    "url_file_name": url_file_name_q,
    "file_name_dedup": file_name_dedup,
    "url_union_distinct": url_union_distinct,
    "url_counts": url_counts,
    "corpus_records": corpus_records,
    "sink_text_by_file": sink_text_by_file,
}

# ---------------------------------------------------------------------------
# DuckDB oracle SQL
# ---------------------------------------------------------------------------


def _name(x):
    return f"CASE WHEN {x} = 0 THEN 'index' ELSE 'p' || CAST({x} AS VARCHAR) END"


_N = "(SELECT count(*) FROM documents)"
_EDGES = f"""
wiki AS (
  SELECT {_name('doc_id')} AS title,
    '# Page ' || CAST(doc_id AS VARCHAR) || chr(10) || 'See [first](' || '{WIKI}' || {_name(f'((doc_id * 3 + 1) % {_N})')}
    || ') and [second](' || '{WIKI}' || {_name(f'((doc_id * 7 + 2) % {_N})')}
    || ').' || chr(10) || 'Also [third](' || '{WIKI}' || {_name(f'((doc_id * 11 + 5) % {_N})')}
    || ') or [ext](' || '{EXTERNAL}' || CAST(doc_id AS VARCHAR)
    || ') and [other](' || '{OTHER_WIKI}' || CAST(doc_id AS VARCHAR) || ')' AS content_md
  FROM documents),
links AS (
  SELECT title AS src, CAST(pos - 1 AS INTEGER) AS pos, url FROM (
    SELECT title, unnest(l) AS url, generate_subscripts(l, 1) AS pos FROM (
      SELECT title, regexp_extract_all(content_md, '\\[.*?\\]\\((.*?)\\)', 1) AS l FROM wiki))),
edges AS (SELECT src, pos, url, string_split(url, '/wiki/')[-1] AS target FROM links
          WHERE contains(url, 'reddit.com/r/personalfinance/wiki/'))"""

_CLOSURE = f"""{_EDGES},
reach AS (SELECT DISTINCT target FROM edges WHERE src = 'index'),
closure0(target) AS (SELECT target FROM reach UNION SELECT e.target FROM closure0 c JOIN edges e ON e.src = c.target),
closure AS (SELECT c.target, min(e.url) AS url FROM closure0 c JOIN edges e ON e.target = c.target GROUP BY c.target)"""

_SITEMAP = r"""
sm AS (
  SELECT CAST(row_number() OVER (ORDER BY page_id) - 1 AS BIGINT) AS pos,
    url || CASE WHEN page_id % 7 = 0 THEN '%' ELSE '' END AS loc,
    CASE WHEN page_id % 3 <> 0 THEN 'weekly' ELSE '' END AS changefreq,
    CASE WHEN page_id % 4 <> 0 THEN '0.' || CAST(page_id % 10 AS VARCHAR) ELSE '' END AS priority
  FROM pages),
sitemap AS (SELECT pos, loc, changefreq, priority,
                   regexp_extract(loc, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS domain, '' AS sitemap_name FROM sm),
nopct AS (SELECT * FROM sitemap WHERE NOT contains(loc, '%')),
surv AS (SELECT * FROM nopct WHERE pos > (SELECT min(pos) FROM nopct)),
topics AS (SELECT pos, loc, CASE WHEN len(string_split(loc, '/')) >= 2 THEN string_split(loc, '/')[-2] END AS topic FROM surv),
kept AS (SELECT * FROM topics WHERE NOT contains(topic, 'hindi')
         AND topic NOT IN ('the-vegetable-list', 'bonus-share-vs-stock-split', 'getting-started-2'))"""

_FILE = f"string_split(url, '/')[-1]"
_FILE_NAME = f"regexp_replace({_FILE}, '[^\\p{{L}}\\p{{N}}_]+', '', 'g') || '.txt'"
_PHRASES = ("replace(replace(replace(lower({t}), 'key takeaways from this chapter', ''), "
            "'we recommend reading this chapter on varsity to learn more and understand the concepts in-depth.', ''), "
            "'varsity', '')")

ORACLE = {
    "wiki_links": f"WITH {_EDGES} SELECT src, pos, url, target FROM edges",
    "wiki_links_one_hop": f"WITH {_EDGES} SELECT target, min(url) AS url FROM edges WHERE src = 'index' GROUP BY target",
    "wiki_closure": f"WITH RECURSIVE {_CLOSURE} SELECT target, url FROM closure",
    "url_domain": "SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS domain FROM pages",
    "scan_sitemap_xml": f"WITH {_SITEMAP} SELECT * FROM sitemap",
    "url_filter": f"WITH {_SITEMAP} SELECT pos, loc FROM surv",
    "url_topic": f"WITH {_SITEMAP} SELECT pos, loc, topic FROM topics",
    "topic_filter": f"WITH {_SITEMAP} SELECT pos, loc, topic FROM kept",
    "url_file_name": f"SELECT page_id, url, {_FILE_NAME} AS file FROM pages",
    "file_name_dedup": f"SELECT {_FILE_NAME} AS file, max(url) AS url FROM pages GROUP BY 1",
    "url_union_distinct": (f"WITH RECURSIVE {_CLOSURE}, {_SITEMAP} SELECT count(*) AS n_urls FROM "
                           f"(SELECT url FROM closure UNION SELECT loc FROM nopct)"),
    "url_counts": (f"WITH RECURSIVE {_CLOSURE}, {_SITEMAP} SELECT (SELECT count(DISTINCT url) FROM closure) AS n_wiki_links, "
                   f"(SELECT count(*) FROM nopct) AS n_sitemap_urls"),
    "corpus_records": (f"WITH {_SITEMAP}, pt AS (SELECT url, {sql_line_trim('text')} AS text FROM (SELECT url, {sql_page_text()} AS text FROM pages)) "
                       f"SELECT k.pos, k.topic || chr(10) || {_PHRASES.format(t="coalesce(pt.text, '')")} || chr(10) || '###' || chr(10) AS record "
                       f"FROM kept k LEFT JOIN pt ON k.loc = pt.url"),
    "sink_text_by_file": (f"WITH k AS (SELECT {_FILE_NAME} AS file, max(url) AS url FROM pages GROUP BY 1), "
                          f"t AS (SELECT k.file, {sql_page_text('pages.html')} AS text FROM k JOIN pages ON pages.url = k.url) "
                          f"SELECT file, {sql_line_trim('text')} AS text FROM t"),
}
