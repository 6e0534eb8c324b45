"""Link graph and URL-list operators: markdown links, internal wiki links,
the transitive crawl, sitemap filters, file names and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.constants import WIKI_START_PAGE, WIKI_SUBREDDIT
from ..functions.urls import is_internal_wiki, markdown_links, topic_allowed, url_file_name, url_topic, wiki_target
from ..session import scratch_path


def page_links(pages: DataFrame, title_col: str = "title", md_col: str = "content_md") -> DataFrame:
    """Every markdown link of every page -> (src, pos, url)."""
    return pages.select(F.col(title_col).alias("src"), F.posexplode(markdown_links(md_col)).alias("pos", "url"))


def internal_links(links: DataFrame, subreddit: str = WIKI_SUBREDDIT) -> DataFrame:
    """Links into the same wiki, with the target page name."""
    return links.where(is_internal_wiki("url", subreddit)).withColumn("target", wiki_target("url"))


def _bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """``df`` written in buckets of ``key``, sorted within: later joins on it need no exchange of it."""
    df.repartition(buckets, key).write.mode("append").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    spark = df.sparkSession
    spark.catalog.refreshTable(name)
    return spark.table(name)


def next_pages(frontier: DataFrame, edges: DataFrame, visited: DataFrame) -> DataFrame:
    """(target, url): pages that the frontier links to and that are not visited yet,
    with the smallest URL. ``edges`` lie in buckets of src and ``visited`` in buckets of target, so only
    the frontier and what it reaches are exchanged."""
    reached = frontier.select(F.col("target").alias("src")).join(edges, "src").groupBy("target").agg(F.min("url").alias("url"))
    return reached.join(visited.select("target"), "target", "left_anti")


def crawl(edges: DataFrame, start: str = WIKI_START_PAGE, max_rounds: int | None = None) -> DataFrame:
    """Pages reachable from ``start`` over (src, target, url) edges ->
    (target, url, depth), one row per target with the smallest URL that
    reached it first.

    Breadth-first: each round joins the frontier to the edges and anti-joins
    the visited set, so each page is expanded once and cycles end the loop. Edges and visited pages
    are resident: Parquet tables below the shared checkpoint folder, bucketed by the key they are joined
    on, to which a round only adds its own pages; so a round costs what its frontier reaches, and a lost
    executor costs a new read. The loop ends when a round finds nothing new; ``max_rounds=1`` is the
    one-hop variant.
    """
    spark = edges.sparkSession
    path = scratch_path(spark, "crawl")
    name = "finch_" + path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "target string, url string, depth int"
    try:
        stored = _bucketed(edges.select("src", "target", "url").distinct(), f"{name}_edges", f"{path}/edges", "src", buckets)
        frontier = stored.where(F.col("src") == start).groupBy("target").agg(F.min("url").alias("url"))
        rounds = 0
        while True:
            rounds += 1
            found = f"{path}/found-{rounds}"
            frontier.select("target", "url").withColumn("depth", F.lit(rounds)).write.parquet(found)
            fresh = spark.read.schema(schema).parquet(found)
            if fresh.isEmpty() and rounds > 1:
                break
            visited = _bucketed(fresh, f"{name}_visited", f"{path}/visited", "target", buckets)
            if fresh.isEmpty() or rounds == max_rounds:
                break
            frontier = next_pages(fresh, stored, visited)
        return spark.read.schema(schema).parquet(f"{path}/visited")
    finally:                                                # the files stay, the names go
        for table in ("edges", "visited"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{table}")


def drop_percent_urls(sitemap: DataFrame, col: str = "loc") -> DataFrame:
    return sitemap.where(~F.col(col).contains("%"))


def skip_first(df: DataFrame, order_cols: list[str]) -> DataFrame:
    """Drop the first row in ``order_cols`` order (the original's ``[1:]``).
    The first row is found with one aggregate, not a global row_number."""
    first = df.select(F.min(F.struct(*order_cols)).alias("_f")).scalar()
    return df.where(F.struct(*order_cols) != first)


def with_topic(df: DataFrame, col: str = "loc") -> DataFrame:
    return df.withColumn("topic", url_topic(col))


def keep_topics(df: DataFrame, col: str = "topic") -> DataFrame:
    return df.where(topic_allowed(col))


def with_file_name(df: DataFrame, url_col: str = "url", out_col: str = "file") -> DataFrame:
    return df.withColumn(out_col, url_file_name(url_col))


def file_name_dedup(df: DataFrame, file_col: str = "file", url_col: str = "url") -> DataFrame:
    """When several URLs map to one file name only one write survives; the
    survivor is the largest URL (fixed tie-break). Partial aggregation keeps a
    hot file name cheap."""
    return df.groupBy(file_col).agg(F.max(url_col).alias(url_col))
