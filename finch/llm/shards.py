"""Balanced sharding by label propagation, with DataFrame operations only.

Documents that share a group (equal texts, or any other link key) pull each
other into one shard. Every round counts each group's members by shard and sends
members towards the shard that holds most of the group. Quotas keep sizes: between
two shards as many may move one way as the other, and beyond that a shard admits
what it has room for. Documents without links have no wish; they fill the room that
is left. A last pass cuts the order (shard, group) into equal runs, so counts are
at most one apart whatever the groups look like.

Groups of any size: members are counted by partial aggregates, and a group's one
row of counts is joined back with its hot keys split off. A group larger than a
quarter of a shard (there are at most 4 x shards of them) cannot follow a majority
without filling it; such groups are laid side by side over as few shards as hold
them, before the others are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..operators.ordering import dense_index
from .common import hash_pair, hot_split_join, written

BUCKETS = 4096   # priority classes of the moves from one shard to another


def _targets(linked: DataFrame, shards: int) -> DataFrame:
    """(g1, g2, target, n): the shard that holds most of a group; ties go to the
    shard that the group's hash prefers."""
    held = linked.groupBy("g1", "g2", "shard").agg(F.count(F.lit(1)).alias("n"))
    turn = F.pmod(F.col("shard") + F.pmod("g1", F.lit(shards)), F.lit(shards))
    return held.groupBy("g1", "g2").agg(F.max_by("shard", F.struct("n", turn)).alias("target"), F.sum("n").alias("n"))


def _quotas(demand: dict[tuple[int, int], int], sizes: dict[int, int], cap: int) -> dict[tuple[int, int], int]:
    """Moves allowed from shard to shard: equal numbers both ways, and what fits."""
    quota = {(a, b): min(n, demand.get((b, a), 0)) for (a, b), n in demand.items()}
    for a, b in sorted(demand):
        more = max(0, min(demand[a, b] - quota[a, b], cap - sizes.get(b, 0)))
        quota[a, b] += more
        sizes = sizes | {b: sizes.get(b, 0) + more, a: sizes.get(a, 0) - more}
    return quota


def _by_room(u: Column, room: list[int]) -> Column:
    """A shard for u in [0, 1), in proportion to the room of each."""
    room = room if sum(room) else [1] * len(room)
    out = F.lit(len(room) - 1)
    for s in reversed(range(len(room))):
        out = F.when(u < sum(room[: s + 1]) / sum(room), s).otherwise(out)
    return out.cast("int")


def _unit(*cols) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def _sizes(rows: DataFrame) -> dict[int, int]:
    return {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}


def propagate(nodes: DataFrame, shards: int, total: int, slack: float = 0.02, rounds: int = 8) -> DataFrame:
    """``nodes`` (key, g1, g2, ...) with ``shard`` and ``linked`` (its group has others)."""
    share = max(total / shards, 1)
    cap = int(share * (1 + slack)) + 1
    groups = nodes.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    marked = written(hot_split_join(nodes, groups, ["g1", "g2"], "left"), "shard-nodes")
    kind = F.when(F.col("members").isNull(), 0).when(F.col("members") > share / 4, 2).otherwise(1)
    alone, linked, giant = (marked.where(kind == k).drop("members") for k in (0, 1, 2))

    at, laid = 0, []
    for g in groups.where(F.col("members") > share / 4).orderBy("g1", "g2").collect():      # at most 4 x shards
        laid.append((g["g1"], g["g2"], at, g["members"]))
        at += g["members"]
    laid = F.broadcast(nodes.sparkSession.createDataFrame(laid, "g1 long, g2 long, at long, members long"))
    place = F.floor((F.col("at") + _unit("key", "g1") * F.col("members")) / F.lit(share))
    giant = giant.join(laid, ["g1", "g2"]).withColumn("shard", F.least(place, F.lit(shards - 1)).cast("int")).drop("at", "members")
    giant = written(giant, "shard-giants")
    held = _sizes(giant)
    linked = linked.withColumn("shard", _by_room(_unit("g1", "key"), [max(0, int(share) - held.get(s, 0)) for s in range(shards)]))
    linked = written(linked, "shard-round")
    for _ in range(rounds):
        wish = (hot_split_join(linked, _targets(linked, shards), ["g1", "g2"])
                .withColumn("bucket", F.pmod(F.col("g2"), F.lit(BUCKETS))))
        classes = written(wish.where("shard <> target").groupBy("shard", "target", "bucket").agg(F.count(F.lit(1)).alias("m")), "shard-wishes")
        demand = {(r["shard"], r["target"]): r["m"] for r in classes.groupBy("shard", "target").agg(F.sum("m").alias("m")).collect()}
        if not demand:
            break
        sizes = _sizes(linked.select("shard").unionByName(giant.select("shard")))
        quota = F.create_map(*[F.lit(x) for (a, b), q in _quotas(demand, sizes, cap).items() for x in (a * shards + b, q)])
        upto = F.sum("m").over(Window.partitionBy("shard", "target").orderBy("bucket"))     # shards^2 x BUCKETS rows at most
        fits = F.col("upto") <= F.element_at(quota, F.col("shard") * shards + F.col("target"))
        ok = classes.withColumn("upto", upto).where(fits).select("shard", "target", "bucket", F.lit(True).alias("ok"))
        moved = wish.join(F.broadcast(ok), ["shard", "target", "bucket"], "left")
        moved = moved.withColumn("shard", F.when(F.col("ok"), F.col("target")).otherwise(F.col("shard")))
        linked = written(moved.select(*linked.columns), "shard-round")
    held = _sizes(linked.select("shard").unionByName(giant.select("shard")))
    alone = alone.withColumn("shard", _by_room(_unit("key", "g1"), [max(0, int(share) - held.get(s, 0)) for s in range(shards)]))
    together = linked.unionByName(giant).withColumn("linked", F.lit(True))
    return alone.withColumn("linked", F.lit(False)).unionByName(together)


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, group, shard, slot): law ``rows``.

    Size is the UTF-8 length of the text plus one; a null text counts as empty
    and belongs to the group of empty texts. A null id is a key like any other;
    repeated rows are rows of their own in one group. An empty table gives an
    empty result. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    g1, g2 = hash_pair(text)
    nodes = docs.select(F.col(id_col).alias("key"), g1.alias("g1"), g2.alias("g2"),
                        (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("crc"))
    nodes = written(nodes, "shard-input")
    total = nodes.count()
    placed = propagate(nodes, shards, total)
    # rows without links stand at both ends of a shard's run, so that the even cut falls among them
    side = F.when(F.col("linked"), 1).when(F.xxhash64(F.lit(1), "key") < 0, 0).otherwise(2)
    order = dense_index(placed.withColumn("side", side), ["shard", "side", "g1", "g2", "key"], "idx")
    n = F.lit(max(total, 1)).cast("long")
    cut = order.withColumn("new", F.floor(F.col("idx") * shards / n))
    start = F.floor((F.col("new") * n + F.lit(shards - 1)) / F.lit(shards))
    return cut.select(F.col("key").alias(id_col), "size", F.col("crc").alias("text_crc32"),
                      F.format_string("%016x%016x", "g1", "g2").alias("text_group"),
                      F.col("shard").alias("label"), F.col("new").cast("int").alias("shard"),
                      (F.col("idx") - start).cast("long").alias("slot"))
