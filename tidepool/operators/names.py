"""Names resolved against a vocabulary by a ladder of matches, each an equi-join.

A text is matched to a name as it is, then to an alias, then to names and aliases in normal form (lower case, dashes and underscores
as single spaces). Where none is, candidates are names that begin with it, then those that contain it, then those that an
edit or two away: these meet by an index of the names' pieces of one to three characters, so no text is held against
every name.

Cases: a null or blank text matches nothing and has no candidates; several names of one normal form are candidates of each
other; a text no longer than the edits has no names near it; an alias of an unknown name doesn't count; repeated names count once; ties go to the shorter name, then by code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import small

#: Vocabularies are broadcast up to so many rows of pieces.
MOST_PIECES = 500_000
PIECE = 3
CANDIDATES, FEW = 5, 3


def normal(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.btrim(F.coalesce(text, F.lit("")))), r"[\s_\-]+", " "))


def _pieces(text: Column) -> Column:
    """Distinct pieces of one to PIECE characters."""
    at = F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(*(F.substring(text, i, F.lit(n)) for n in range(1, PIECE + 1))))))


def resolve(texts: DataFrame, names: DataFrame, aliases: DataFrame, edits: int = 0) -> DataFrame:
    """(id, matched, ambiguous, canonical, candidates, source) for texts (id, text), names (name) and aliases (alias, name).

    source: canonical_exact, alias_exact, normalized_match or normalized_alias; null for candidates alone. With `edits`, names so many edits away are candidates
    as well, after the others."""
    t = texts.select("id", F.btrim(F.coalesce("text", F.lit(""))).alias("text")).withColumn("norm", normal(F.col("text")))
    known = names.select("name").filter("name <> ''").distinct()
    other = aliases.join(known, "name", "left_semi").select("alias", "name").distinct()
    steps = [(1, "canonical_exact", known.select(F.col("name").alias("key"), "name"), "text"), (2, "alias_exact", other.select(F.col("alias").alias("key"), "name"), "text"), (3, "normalized_match", known.select(normal(F.col("name")).alias("key"), "name"), "norm"), (4, "normalized_alias", other.select(normal(F.col("alias")).alias("key"), "name"), "norm")]
    hits = None
    for n, source, table, column in steps:
        _, keys = small(table.filter("key <> ''"), MOST_PIECES)
        one = t.join(keys, F.col(column) == F.col("key")).select("id", "name", F.lit(n).alias("step"), F.lit(source).alias("source"))
        hits = one if hits is None else hits.unionByName(one)
    first = hits.groupBy("id", "step", "source").agg(F.collect_set("name").alias("names"))
    first = first.groupBy("id").agg(F.min_by(F.struct("source", "names"), "step").alias("h"))

    # candidates for texts that no step has
    open_ = t.join(first, "id", "left_anti").filter("norm <> ''")
    forms = known.withColumn("form", normal(F.col("name"))).filter("form <> ''")
    _, index = small(forms.select("name", "form", F.explode(_pieces(F.col("form"))).alias("piece")), MOST_PIECES)
    asked = open_.withColumn("piece", F.substring("norm", 1, PIECE))
    within = asked.join(index, "piece").filter(F.contains("form", F.col("norm"))).select("id", "name", F.lit(0).alias("far"))
    if edits:
        # of edits + 1 parts of a text at least one is whole in a name that is no more edits away
        n, at = F.char_length("norm"), lambda j: F.floor(j * F.char_length("norm") / (edits + 1)).cast("int")
        parts = F.array(*(F.substring("norm", at(j) + 1, F.least(at(j + 1) - at(j), F.lit(PIECE))) for j in range(edits + 1)))
        near = open_.filter(n > edits).select("id", "norm", F.explode(F.array_distinct(parts)).alias("piece")).join(index, "piece").select("id", "norm", "name", "form").distinct()
        within = within.unionByName(near.filter(F.levenshtein("norm", "form", edits) > 0).select("id", "name", F.levenshtein("norm", "form", edits).alias("far")))
    order = Window.partitionBy("id").orderBy("far", F.char_length("name"), "name")
    best = within.groupBy("id", "name").agg(F.min("far").alias("far")).withColumn("n", F.row_number().over(order)).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("id"))).filter(F.col("n") <= CANDIDATES)
    listed = best.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]).alias("c"))
    out = t.join(first, "id", "left").join(listed, "id", "left")
    size = F.coalesce(F.size("h.names"), F.lit(0))
    tied = F.transform(F.array_sort(F.transform("h.names", lambda x: F.struct(F.char_length(x).alias("k"), x.alias("x")))), lambda x: x["x"])
    none = F.array().cast("array<string>")
    return out.select("id", (size == 1).alias("matched"), ((size > 1) | ((size == 0) & (F.coalesce(F.size("c"), F.lit(0)) > 1))).alias("ambiguous"), F.when(size == 1, F.col("h.names")[0]).alias("canonical"), F.when(size > 1, tied).when(size == 1, none).otherwise(F.coalesce("c", none)).alias("candidates"), F.col("h.source").alias("source"))
