"""Changes to tables: upserts, merges, soft deletes, lifetimes, lifecycles. Each returns the table as it is after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import dropped, small, stored

#: Ids of a round are broadcast up to so many; rows of a partition of nodes or edges, about.
FEW, ROWS = 200_000, 500_000


def unique(rows: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """One row of each key: the one with the largest `newest`, ties and rows without it by a hash of all columns, so that any order of rows gives the same."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    by = F.xxhash64(*rest) if newest is None else F.struct(F.col(newest), F.xxhash64(*rest))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], merge_nulls: bool = False) -> DataFrame:
    """New rows replace old ones of their key whole; with merge_nulls, null columns keep the old value. One shuffle on the key.

    Of new rows of one key unique() chooses."""
    new = unique(new, keys)
    if not merge_nulls:
        return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
    rest = [c for c in old.columns if c not in keys]
    both = old.alias("o").join(new.alias("n"), keys, "full")
    return both.select(*keys, *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in rest))


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edge weights add up; a missing weight counts one."""
    both = old.select("src_id", "dst_id", "rel_type", "weight").unionByName(new.select("src_id", "dst_id", "rel_type", "weight"))
    return both.groupBy("src_id", "dst_id", "rel_type").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"))


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist: two semi-joins."""
    ids = nodes.select("id")
    return edges.join(ids, edges.src_id == ids.id, "left_semi").join(ids, edges.dst_id == ids.id, "left_semi")


def decay_edges(edges: DataFrame, factor: float, least: float, relations: list[str] | None = None) -> DataFrame:
    hit = F.col("weight") > least
    if relations:
        hit = hit & F.col("rel_type").isin(*relations)
    return edges.withColumn("weight", F.when(hit, F.col("weight") * factor).otherwise(F.col("weight")))


def dedup_merge(entries: DataFrame, scope: list[str], text: str = "text", t: str = "created_at", key: str = "id") -> DataFrame:
    """Entries of a scope with the same first content become one: the newest, with how many it stands for and the first seen."""
    mark = F.md5(F.encode(F.btrim(F.coalesce(text, F.lit(""))), "utf-8"))
    return entries.groupBy(*scope, mark.alias("fingerprint")).agg(F.max_by(key, F.struct(t, key)).alias(key), F.min(t).alias("first_t"), F.max(t).alias("last_t"), F.count(F.lit(1)).alias("merged"))


def ttl_defaults(rows: DataFrame, default: float, now: Column) -> DataFrame:
    """Lifetime, creation and expiry where they are missing; no lifetime (zero) expires in the year 9999."""
    ttl, made = F.coalesce("ttl", F.lit(default)), F.coalesce("created_at", now)
    end = F.when(ttl > 0, made + F.make_dt_interval(secs=ttl.cast("decimal(18,6)"))).otherwise(F.lit("9999-12-31").cast("timestamp_ntz"))
    return rows.withColumns({"ttl": ttl, "created_at": made, "expires_at": F.coalesce("expires_at", end) if "expires_at" in rows.columns else end})


def expired(rows: DataFrame, now: Column, buffer_s: float = 0.0) -> DataFrame:
    """Rows whose lifetime (positive seconds from creation) and buffer have passed."""
    age = F.timestamp_diff("SECOND", F.col("created_at"), now)
    return rows.filter((F.col("ttl") > 0) & (age > F.col("ttl") + buffer_s))


def touch(rows: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Rows used now: last access, and expiry put off where there is a lifetime."""
    hit = rows.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left")
    later = now + F.make_dt_interval(secs=F.col("ttl").cast("decimal(18,6)"))
    return hit.withColumns({"last_accessed_at": F.when(F.col("_hit"), now).otherwise(F.col("last_accessed_at")), "expires_at": F.when(F.col("_hit") & (F.col("ttl") > 0), later).otherwise(F.col("expires_at"))}).drop("_hit")


def publish(rows: DataFrame, ids: DataFrame, flag: bool) -> DataFrame:
    return rows.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left").withColumn("published", F.when(F.col("_hit"), F.lit(flag)).otherwise(F.col("published"))).drop("_hit")


def purge_except(rows: DataFrame, source: str, keep: DataFrame) -> DataFrame:
    """Everything of a source goes, but for the kept ids."""
    own = F.col("source") == source
    return rows.filter(~own | F.col("source").isNull()).unionByName(rows.filter(own).join(keep.select("id"), "id", "left_semi"))


def approve_equivalents(edges: DataFrame, pending: DataFrame) -> DataFrame:
    """Equivalences after decisions on proposals (a, b, status; both ways are one): approved ones become EQUIV edges of weight 1, and edges
    that are there keep their weight; rejected ones take their EQUIV edge away. A pair with both decisions is rejected."""
    ends = pending.select(F.least("a", "b").alias("src_id"), F.greatest("a", "b").alias("dst_id"), "status")
    no = ends.filter("status = 'rejected'").select("src_id", "dst_id").distinct()
    ok = ends.filter("status = 'approved' AND src_id <> dst_id").select("src_id", "dst_id").distinct().join(no, ["src_id", "dst_id"], "left_anti")
    own = edges.select("src_id", "dst_id", "rel_type", "weight")
    equal, rest = own.filter("rel_type = 'EQUIV'").withColumns({"src_id": F.least("src_id", "dst_id"), "dst_id": F.greatest("src_id", "dst_id")}), own.filter("rel_type <> 'EQUIV' OR rel_type IS NULL")
    left = equal.groupBy("src_id", "dst_id").agg(F.max("weight").alias("weight")).join(no, ["src_id", "dst_id"], "left_anti")
    both = left.join(ok.withColumn("_new", F.lit(1.0)), ["src_id", "dst_id"], "full").select("src_id", "dst_id", F.lit("EQUIV").alias("rel_type"), F.coalesce("weight", "_new").alias("weight"))
    return rest.unionByName(both)


def purge(nodes: DataFrame, edges: DataFrame, doomed: DataFrame, owned: list[str], directed: bool = True, rounds: int = 32) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of nodes (id, label) and edges (src_id, dst_id, rel_type) when some nodes (id) go, and what went (id, label, round).

    A node of an owned label goes as well when the last edge that leads to it went with others: an entity that nothing mentions any more, then a
    place that only it was at, and so on to the fixed point. With directed=False it takes the last of all its edges, in whichever direction. One
    that had no such edge to begin with stays. Edges are counted once for each end that they hold, with those that have gone; what other ends hold
    is stored only where these can go themselves. A round joins that with what went in the round before; rounds are as many as the longest chain."""
    spark = nodes.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-max(nodes.count(), edges.count()) // ROWS))
    nodes_, doomed_ = nodes.repartition(parts, "id"), doomed.select("id").repartition(parts, "id")
    went = stored(nodes_.join(doomed_, "id", "left_semi").select("id", "label", F.lit(0).alias("round")), "purged")
    ends = edges.select(F.col("src_id").alias("holder"), F.col("dst_id").alias("id"))
    ends = ends if directed else ends.unionByName(edges.select(F.col("dst_id").alias("holder"), F.col("src_id").alias("id")))
    own = nodes.filter(F.col("label").isin(*owned))
    fate = own.select(F.col("id").alias("holder"), F.lit(False).alias("gone")).unionByName(went.select(F.col("id").alias("holder"), F.lit(True).alias("gone")))
    fate = fate.repartition(parts, "holder").groupBy("holder").agg(F.max("gone").alias("gone"))
    held = ends.repartition(parts, "holder").join(fate, "holder", "left").select(F.when(~F.col("gone"), F.col("holder")).alias("holder"), "id", F.coalesce("gone", F.lit(False)).alias("gone"))
    held = stored(held, "edges-held")
    counts = held.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if("gone").alias("lost"))
    state = stored(own.repartition(parts, "id").join(went.select("id").repartition(parts, "id"), "id", "left_anti").join(counts, "id").select("id", "label", "n", "lost"), "edges-lost")
    every, made = went, []
    for n in range(1, rounds + 1):
        went = stored(state.filter("lost = n").select("id", "label", F.lit(n).alias("round")), "purged")
        if went.isEmpty():
            break
        every = every.unionByName(went)
        _, last = small(went.select(F.col("id").alias("holder")).distinct(), FEW)
        more = held.filter("holder IS NOT NULL").join(last, "holder", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("more"))
        made.append(state)
        state = stored(state.filter("lost < n").join(more, "id", "left").select("id", "label", "n", (F.col("lost") + F.coalesce("more", F.lit(0))).alias("lost")), "edges-lost")
    else:
        raise RuntimeError(f"there are still orphans after {rounds} rounds")
    dropped(held, state, *made)
    gone = every.select("id")
    left = edges.join(gone.withColumnRenamed("id", "src_id"), "src_id", "left_anti").join(gone.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti").select(*edges.columns)
    return nodes.join(gone, "id", "left_anti"), left, every


def history(audit: DataFrame) -> DataFrame:
    """The latest version of each object in an append-only log (object_id, seq, snapshot)."""
    return audit.groupBy("object_id").agg(F.max("seq").alias("seq"), F.max_by("snapshot", "seq").alias("snapshot"))


def rollback(audit: DataFrame, before: int) -> DataFrame:
    """Objects as they were before a sequence number; those made later aren't there."""
    return history(audit.filter(F.col("seq") < before))


def chunked_turns(turns: DataFrame, most: int) -> DataFrame:
    """Turns of a session in chunks of so many."""
    w = Window.partitionBy("session_id").orderBy("idx")
    return turns.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / most))


def fill_times(turns: DataFrame, seconds: float) -> DataFrame:
    """Times of turns without one: an even step, aligned to the first known of the session."""
    w = Window.partitionBy("session_id")
    known = F.min(F.when(F.col("t").isNotNull(), F.struct("idx", "t"))).over(w)
    return turns.withColumn("t", F.coalesce("t", known["t"] + F.make_dt_interval(secs=((F.col("idx") - known["idx"]) * seconds).cast("decimal(18,6)"))))
