"""Pattern matches over node and edge tables: every match is an equi-join on a pre-aggregated edge table, never a product of branches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored

#: Rows of a partition, about.
ROWS = 500_000
#: Entities of a block, at least and at most; counts held at once, and how many of a row.
FEW, MANY, COUNTED, WIDE = 256, 16_384, 1 << 21, 128


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge both ways."""
    back = edges.withColumns({"src_id": F.col("dst_id"), "dst_id": F.col("src_id")})
    return edges.unionByName(back)


def relations_of(involves: DataFrame, events: DataFrame, entity: object, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Entities in the same events as one: how many events, when first and last."""
    own = involves.filter(F.col("entity_id") == F.lit(entity)).select("event_id")
    t = events.select(F.col("id").alias("event_id"), "t")
    if start is not None:
        t = t.filter(F.col("t") >= start)
    if end is not None:
        t = t.filter(F.col("t") <= end)
    both = involves.filter(F.col("entity_id") != F.lit(entity)).join(own, "event_id", "left_semi").join(t, "event_id")
    return both.groupBy("entity_id").agg(F.count_distinct("event_id").alias("strength"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def pairs_in_events(involves: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Unordered pairs a < b of entities of an event. The pairs of an event are its own; no event's rows meet another's. times (event_id, t) give them a time.

    Pairs come dealt by a and b, in partitions whose number goes by a count of them: what is small in bytes would be put together, and has many pairs."""
    size = involves.groupBy("event_id").count().agg(F.sum("count"), F.sum(F.expr("count * (count - 1) / 2"))).first()
    rows, pairs = (max(1, -(-int(n or 0) // ROWS)) for n in size)
    own = involves.repartition(rows, "event_id")
    x, y = own.select("event_id", F.col("entity_id").alias("a")), own.select("event_id", F.col("entity_id").alias("b"))
    x = x if times is None else x.join(times.repartition(rows, "event_id"), "event_id")
    return x.join(y, "event_id").filter("a < b").repartition(pairs, "a", "b")


def shared_events(involves: DataFrame, least: int = 1, block: int | None = None) -> DataFrame:
    """(a, b, weight): pairs a < b of entities that share at least so many different events, where events are long and pairs far more than rows.

    Entities, each with the set of its events, are cut into blocks of one size, and two blocks meet in a cell, which counts in a matrix, some rows
    at a time. Pairs are neither shuffled nor stored; an entity goes to as many cells as there are blocks, so blocks are large. Entities of the
    same events lie together and pairs come entity by entity, so weights and ids repeat and files of pairs are small. Null ids meet nothing."""
    own = involves.filter("event_id IS NOT NULL AND entity_id IS NOT NULL").groupBy("entity_id").agg(F.sort_array(F.collect_set("event_id")).alias("events"))
    own = own.withColumn("_like", F.xxhash64("events")).orderBy("_like", "entity_id")
    own = stored(own.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "entities")
    before, n = {}, 0
    for part, size in sorted(map(tuple, own.groupBy("_part").count().collect())):
        before[part], n = n, n + size
    most = block or max(FEW, min(MANY, n // 12))
    blocks = max(1, -(-n // most))
    start = F.create_map(*(F.lit(x) for p in before.items() for x in p))[F.col("_part")] if before else F.lit(0)
    dealt = own.withColumn("_own", F.floor((start + F.col("_at")) * blocks / max(1, n)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("entity_id", "events", "_like", "_own", F.least("_own", "_other").alias("_x"), F.greatest("_own", "_other").alias("_y"))
    kind = involves.schema["entity_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(batches)
        place = pc.rank(cell["entity_id"], tiebreaker="first").to_numpy()
        order = np.lexsort((place, cell["_like"].to_numpy()))
        owner, ids, place = cell["_own"].to_numpy()[order], cell["entity_id"].to_numpy()[order], place[order]
        x, y = cell["_x"][0].as_py(), cell["_y"][0].as_py()
        events = cell["events"].combine_chunks()
        code = events.flatten().dictionary_encode().indices.to_numpy()
        at = np.repeat(np.argsort(order), events.value_lengths().to_numpy())

        def side(block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Entities of a block; by event, which of them has it."""
            those = np.flatnonzero(owner == block)
            on = owner[at] == block
            entity = np.searchsorted(those, at[on])
            by = np.lexsort((entity, code[on]))
            return those, code[on][by], entity[by]

        def starts(codes: np.ndarray) -> np.ndarray:
            return np.searchsorted(codes, np.arange(code.max(initial=-1) + 2))

        rows, row_code, row = side(x)
        columns, column_code, column = side(y)
        # few columns at a time, so that a row's pairs are short and are like those of the row before it
        tiles = []
        for left in range(0, len(columns), WIDE):
            on = (column >= left) & (column < left + WIDE)
            tiles.append((left, column[on] - left, starts(column_code[on])))
        step = COUNTED // WIDE
        for lo in range(0, len(rows), step):
            on = (row >= lo) & (row < lo + step)
            those, first = row[on] - lo, starts(row_code[on])
            own = rows[lo : lo + step]
            for left, of, start in tiles:
                right = columns[left : left + WIDE]
                out = np.zeros((len(own), len(right)), np.int32)
                for c in np.flatnonzero((np.diff(first) > 0) & (np.diff(start) > 0)):
                    out[np.ix_(those[first[c] : first[c + 1]], of[start[c] : start[c + 1]])] += 1
                hit = out >= max(1, least)
                if x == y:
                    hit &= np.arange(left, left + len(right)) > np.arange(lo, lo + len(own))[:, None]
                ahead = place[own][:, None] < place[right]
                for which in (True, False):
                    i, j = np.nonzero(hit & (ahead == which))
                    ends = (ids[own][i], ids[right][j])
                    a, b = (pa.array(e, cell.schema.field("entity_id").type) for e in (ends if which else ends[::-1]))
                    yield pa.RecordBatch.from_arrays([a, b, pa.array(out[i, j].astype(np.int64))], ["a", "b", "weight"])

    # cells are work, not bytes, so they aren't left to be put together by their size
    dealt = dealt.repartition(min(2000, blocks * (blocks + 1) // 2), "_x", "_y")
    return dealt.groupBy("_x", "_y").applyInArrow(count, f"a {kind}, b {kind}, weight long")


def co_occurrence(involves: DataFrame, events: DataFrame, least: int = 1) -> DataFrame:
    """Weight, first and last time of each pair of entities that share at least so many events. Recomputed, so running twice changes nothing."""
    pairs = pairs_in_events(involves, events.select(F.col("id").alias("event_id"), "t"))
    return pairs.groupBy("a", "b").agg(F.count_distinct("event_id").alias("weight"), F.min("t").alias("first_t"), F.max("t").alias("last_t")).filter(F.col("weight") >= least)


def first_meetings(involves: DataFrame, events: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """The earliest event of each pair, by time and then id, and where it was."""
    pairs = pairs_in_events(involves, events.select(F.col("id").alias("event_id"), "t"))
    out = pairs.groupBy("a", "b").agg(F.min(F.struct("t", "event_id")).alias("m")).select("a", "b", "m.event_id", "m.t")
    return out.join(places, "event_id", "left") if places is not None else out


def expand(edges: DataFrame, seeds: DataFrame, hops: int, cap: int, directed: bool = False, relations: list[str] | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Neighbours of seeds (seed) within some hops: the strongest edge that reaches each, and its hop; at most cap for each seed.

    Hops are unrolled joins. Between hops each seed keeps one row per node, so the frontier is at most seeds times nodes reached."""
    own = edges.filter(F.upper("rel_type").isin(*[r.upper() for r in relations])) if relations else edges
    own = (own if directed else undirected(own)).select("src_id", "dst_id", "rel_type", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    frontier = seeds.select("seed", F.col("seed").alias("at")).distinct()
    found = None
    for hop in range(1, hops + 1):
        step = frontier.join(own, frontier["at"] == own["src_id"]).filter("dst_id <> seed").select("seed", F.col("dst_id").alias("to"), "rel_type", "weight", F.lit(hop).alias("hop"))
        if targets is not None:
            step = step.join(targets.select(F.col("id").alias("to")), "to", "left_semi").select("seed", "to", "rel_type", "weight", "hop")
        best = step.groupBy("seed", "to").agg(F.min(F.struct((-F.col("weight")).alias("w"), "hop", "rel_type")).alias("b"))
        best = best.select("seed", "to", F.col("b.rel_type").alias("rel_type"), (-F.col("b.w")).alias("weight"), F.col("b.hop").alias("hop"))
        found = best if found is None else found.unionByName(best)
        frontier = best.select("seed", F.col("to").alias("at"))
    kept = found.groupBy("seed", "to").agg(F.min(F.struct((-F.col("weight")).alias("w"), "hop", "rel_type")).alias("b"))
    kept = kept.select("seed", "to", F.col("b.rel_type").alias("rel"), (-F.col("b.w")).alias("weight"), F.col("b.hop").alias("hop"))
    w = Window.partitionBy("seed").orderBy(F.desc("weight"), "hop", "to")
    return kept.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= cap).drop("_k")


def paths(edges: DataFrame, start: str, least: float) -> DataFrame:
    """Paths of one or two edges of sufficient weight from a node."""
    e = edges.filter(F.col("weight") >= least)
    one = e.filter(F.col("src_id") == start)
    two = one.alias("x").join(e.alias("y"), F.col("x.dst_id") == F.col("y.src_id")).filter(F.col("y.dst_id") != start)
    return one.select(F.lit(1).alias("hops"), F.col("dst_id").alias("via"), F.col("dst_id").alias("to"), "weight").unionByName(
        two.select(F.lit(2).alias("hops"), F.col("x.dst_id").alias("via"), F.col("y.dst_id").alias("to"), (F.col("x.weight") * F.col("y.weight")).alias("weight")))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches."""
    touched = edges.select(F.col("src_id").alias("id")).union(edges.select(F.col("dst_id").alias("id")))
    return nodes.join(touched, "id", "left_anti")


def in_order(nodes: DataFrame, ids: list, key: str = "id") -> DataFrame:
    """The nodes asked for, in the order asked for, each once."""
    asked = nodes.sparkSession.createDataFrame([(i, p) for p, i in enumerate(dict.fromkeys(ids))], f"{key} {nodes.schema[key].dataType.simpleString()}, pos int")
    return nodes.join(F.broadcast(asked), key)  # as many rows as the request names


def newest(rows: DataFrame, keys: list[str], times: list[str], value: str) -> DataFrame:
    """The value of each key that was updated last (by the first time that isn't null)."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(F.coalesce(*map(F.col, times)), value)).alias(value))


def resolve_names(entities: DataFrame, query: str, distance: int = 2) -> DataFrame:
    """Entities by name: exact 1.0, containing 0.8, within an edit distance 0.6."""
    name, q = F.lower("name"), query.lower()
    score = F.when(name == q, 1.0).when(F.contains(name, F.lit(q)), 0.8).when(F.levenshtein(name, F.lit(q), distance) >= 0, 0.6)
    return entities.withColumn("score", score).filter("score IS NOT NULL")


def bundle(events: DataFrame, branches: dict[str, DataFrame]) -> DataFrame:
    """Events with a sorted list of ids from each branch (event_id, item). Each branch is aggregated before it is joined."""
    out = events
    for name, b in branches.items():
        own = b.groupBy("event_id").agg(F.sort_array(F.collect_set("item")).alias(name))
        out = out.join(own, "event_id", "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))
    return out
