"""A store of memory entries as Parquet, with what callers of such a service do: add, search, get, update, history, rollback, delete.

A tenant's entries are a table of their own in a folder of their own. A change is a commit: the tenant's table as it is after, and
what the change did to it as a segment of the log, are written into a folder aside, and that folder is then renamed to the
commit's number, which fails if the number is taken. Of two writers that start from the same state only one gets the
number; the other makes its change again from the new state. So no change is lost, a change and its log stand or fall
together, a writer that dies leaves nothing that counts, readers always find a whole table, and other tenants aren't
touched. The log is never rewritten. Renames are as exclusive as the file system's.

Searches are plans over the current table of a tenant; nothing is collected here but the names of a request's tenants.

Cases: an id that is twice in one request counts once, with the row that maintain.unique() chooses; rows without an id or tenant
are dropped; a change of ids that aren't there is no commit; an unknown tenant has no entries.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import filters, graph, maintain, scoring

COLUMNS = "id string, tenant_id string, text string, kind string, source string, published boolean, created_at timestamp_ntz, is_deleted boolean, vector array<float>"
AUDIT = "object_id string, tenant_id string, seq long, event string, snapshot string"
SNAPSHOT = "text string, kind string, source string, published boolean, is_deleted boolean, vector array<float>"
KEYS = ["tenant_id", "id"]
#: A commit is tried again so often when others come first.
TRIES = 20


class Conflict(RuntimeError):
    """Others kept committing first."""


@dataclass
class Memory:
    spark: SparkSession
    path: str
    #: Hook: (existing rows, new rows) to rows with a column `decision` of ADD, UPDATE, DELETE or NONE.
    decide: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    tools: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.tools |= {"search": self.search, "near": self.near, "get": self.get, "history": self.history, "rollback": self.rollback, "expand": graph.expand, "relations": graph.relations_of}

    # Files
    def _at(self, path: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _home(self, tenant: str) -> str:
        return f"{self.path}/tenant={quote(tenant, safe='')}"

    def commits(self, tenant: str) -> list[int]:
        """Numbers of a tenant's commits, in order."""
        return [int(n) for n in self._names(f"{self._home(tenant)}/commits")]

    def _table(self, tenant: str, last: int) -> DataFrame:
        return self.spark.read.schema(COLUMNS).parquet(f"{self._home(tenant)}/commits/{last:012d}/table") if last else self.spark.createDataFrame([], COLUMNS)

    def of(self, tenant: str) -> DataFrame:
        """A tenant's entries as they are now, deleted ones too."""
        return self._table(tenant, max(self.commits(tenant), default=0))

    def _all(self, schema: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _tenants(self) -> list[str]:
        return [x for x in self._names(self.path) if x.startswith("tenant=")]

    def entries(self) -> DataFrame:
        last = [(t, self._names(f"{self.path}/{t}/commits")) for t in self._tenants()]
        return self._all(COLUMNS, [f"{self.path}/{t}/commits/{c[-1]}/table" for t, c in last if c])

    def audit(self) -> DataFrame:
        return self._all(AUDIT, [f"{self.path}/{t}/commits/{n}/log" for t in self._tenants() for n in self._names(f"{self.path}/{t}/commits")])

    def _commit(self, tenant: str, change: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> int | None:
        """change: the table to (the table after, log rows: entries before the change with a column `event`). The commit's number, or None if nothing is logged."""
        home = self._home(tenant)
        for _ in range(TRIES):
            last = max(self.commits(tenant), default=0)
            after, changed = change(self._table(tenant, last))
            aside, number = f"{home}/aside/{uuid.uuid4().hex}", last + 1
            rows = changed.select(F.col("id").alias("object_id"), "tenant_id", F.lit(number).cast("long").alias("seq"), "event", F.to_json(F.struct("text", "kind", "source", "published", "is_deleted", "vector")).alias("snapshot"))
            rows.write.parquet(f"{aside}/log")
            some = not self.spark.read.schema(AUDIT).parquet(f"{aside}/log").isEmpty()
            if some:
                after.write.parquet(f"{aside}/table")
                if self._renamed(aside, f"{home}/commits", number):
                    return number
            fs, at = self._at(aside)
            fs.delete(at, True)
            if not some:
                return None
        raise Conflict(tenant)

    def _renamed(self, aside: str, commits: str, number: int) -> bool:
        """Whether the folder could take the number."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        fs, parent = self._at(commits)
        fs.mkdirs(parent)
        source, target = (fs.makeQualified(jvm.org.apache.hadoop.fs.Path(p)) for p in (aside, f"{commits}/{number:012d}"))
        nothing = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), conf).rename(source, target, nothing)
        except Exception as e:  # an existing target comes through the gateway as one of several kinds
            if fs.exists(target):
                return False
            raise e
        return True

    def vacuum(self, tenant: str, keep: int = 1) -> int:
        """Delete the tables of all but the last commits; the log stays. How many went. Readers of those tables must be done."""
        gone = 0
        for n in self.commits(tenant)[:-keep]:
            fs, at = self._at(f"{self._home(tenant)}/commits/{n:012d}/table")
            gone += fs.exists(at) and fs.delete(at, True)
        return gone

    # Changes
    def add(self, rows: DataFrame) -> None:
        """Insert or replace entries (id, tenant_id, text and any other column), as the hook decides; it may also delete, or leave rows out.

        A request over several tenants is a commit of each."""
        have = rows.columns
        full = rows.filter("id IS NOT NULL AND tenant_id IS NOT NULL").select(*(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(False if f.name == "is_deleted" else None).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], COLUMNS).schema))
        full = maintain.unique(full, KEYS)
        for tenant in sorted(r.tenant_id for r in full.select("tenant_id").distinct().collect()):
            own = full.filter(F.col("tenant_id") == tenant)

            def change(old: DataFrame, own: DataFrame = own) -> tuple[DataFrame, DataFrame]:
                decided = self.decide(old, own) if self.decide else own.withColumn("decision", F.lit("ADD"))
                put = maintain.unique(decided.filter("decision IN ('ADD', 'UPDATE')").drop("decision"), KEYS)
                gone = decided.filter("decision = 'DELETE'").select(*KEYS).distinct()
                fresh = put.join(old.select(*KEYS), KEYS, "left_anti").withColumn("event", F.lit("ADD"))
                changed = old.join(put.select(*KEYS), KEYS, "left_semi").withColumn("event", F.lit("UPDATE"))
                deleted = old.filter("NOT is_deleted").join(gone, KEYS, "left_semi").withColumn("event", F.lit("DELETE"))
                after = maintain.upsert(old, put, KEYS).join(gone.withColumn("_gone", F.lit(True)), KEYS, "left")
                after = after.withColumn("is_deleted", F.coalesce("_gone", "is_deleted")).select(*old.columns)
                return after, fresh.unionByName(changed).unionByName(deleted)

            self._commit(tenant, change)

    def _change(self, tenant: str, ids: list[str], changes: dict[str, Column], event: str) -> None:
        hit = F.col("id").isin(*ids)

        def change(old: DataFrame) -> tuple[DataFrame, DataFrame]:
            return old.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()}), old.filter(hit).withColumn("event", F.lit(event))

        self._commit(tenant, change)

    def update(self, tenant: str, key: str, text: str) -> None:
        self._change(tenant, [key], {"text": F.lit(text)}, "UPDATE")

    def delete(self, tenant: str, *ids: str) -> None:
        """Entries stay, marked, so history and rollback work."""
        self._change(tenant, list(ids), {"is_deleted": F.lit(True)}, "DELETE")

    def rollback(self, tenant: str, key: str, seq: int) -> None:
        """Give an entry what it was before the change of this number; one that the change added is deleted. Logged as a change itself."""
        row = self.history(tenant, key).filter(F.col("seq") == seq).select("event", F.from_json("snapshot", SNAPSHOT).alias("was")).first()
        if row is None:
            return
        if row.event == "ADD":
            self._change(tenant, [key], {"is_deleted": F.lit(True)}, "ROLLBACK")
            return
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], COLUMNS).schema}
        self._change(tenant, [key], {c: F.lit(v).cast(kinds[c]) for c, v in row.was.asDict().items()}, "ROLLBACK")

    def clear(self, tenant: str) -> None:
        """All of a tenant's entries and its log go."""
        fs, at = self._at(self._home(tenant))
        fs.delete(at, True)

    # Reading
    def get(self, tenant: str, key: str) -> DataFrame:
        return self.of(tenant).filter((F.col("id") == key) & ~F.col("is_deleted"))

    def _live(self, tenant: str, where: Column | None) -> DataFrame:
        live = self.of(tenant).filter(~F.col("is_deleted") & filters.published_is(True))
        return live.filter(where) if where is not None else live

    def search(self, tenant: str, text: str, k: int = 10, where: Column | None = None) -> DataFrame:
        """The k best entries of a tenant by words."""
        asked = self.spark.createDataFrame([(0, text)], "query_id int, text string")
        return scoring.top(scoring.bm25(self._live(tenant, where), asked), ["query_id"], k).select("id", "score", "rank")

    def near(self, tenant: str, vector: list[float], k: int = 10, least: float | None = None, where: Column | None = None) -> DataFrame:
        """The k entries of a tenant whose vectors are nearest; entries without one have a score of 0."""
        asked = self.spark.createDataFrame([(0, [float(x) for x in vector])], "query_id int, qvec array<double>")
        live = self._live(tenant, where).select("id", F.coalesce("vector", F.array().cast("array<float>")).alias("vector"))
        return scoring.cosine_top(asked, live, k, least).select("id", "score", "rank")

    def history(self, tenant: str, key: str) -> DataFrame:
        return self._all(AUDIT, [f"{self._home(tenant)}/commits/{n:012d}/log" for n in self.commits(tenant)]).filter(F.col("object_id") == key).orderBy("seq")
