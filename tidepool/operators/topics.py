"""Topics of events from tables of rules, synonyms and buckets, and a registry of their keys.

A term is looked for in all texts by one equi-join: the pairs of characters of a text meet the first pair of each term, and
only such terms are then compared. Keywords meet terms as a whole. So the work is that of the terms a text can have, however
many rules there are; no row is held against every rule.

The first of these that gives a known path counts: the event's own path; the satisfied rule of the highest priority (then
the first one); a synonym that is its topic, then its first keyword that is one, then the first one in its text; and else the
first bucket with a term in it. A rule is satisfied if one of its places and one of its `any` terms is a keyword or
in the text, and all of its `all` terms are keywords; a part that it doesn't have asks for nothing.

Cases: null and empty texts and lists have no terms; events without keywords get derived ones; a rule without any part is
satisfied by all; terms are compared as they are written; repeated ids must not occur.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import small

#: Term tables are broadcast up to so many rows.
MOST_TERMS = 100_000
LOOSE = "_uncategorized/"
#: Words that aren't keywords, and Chinese ones.
DULL = [
    "the", "and", "with", "from", "this", "that", "have", "has", "had", "about", "today", "yesterday", "tomorrow", "really", "very", "just", "thing", "things", "like", "want", "need", "plan", "work", "meeting",
    "project",
]

DULL_RUNS = ["今天", "昨天", "明天", "现在", "最近", "然后", "因为", "感觉", "一个", "我们", "你们", "他们", "就是", "还是", "但是", "这个", "那个", "事情", "东西", "问题", "有点", "有些", "其实"]


@dataclass(frozen=True)
class Vocabulary:
    """Tables: paths (path), tags (tag), rules (rule, priority, place, topic_path, tags), terms (rule, kind of place, any or all, term), synonyms (variant, canonical, place), buckets (path, place, term).

    `place` is the order in which rows of a table count."""

    paths: DataFrame
    tags: DataFrame
    rules: DataFrame
    terms: DataFrame
    synonyms: DataFrame
    buckets: DataFrame


def vocabulary(spark: SparkSession, paths: list[str], tags: list[str], rules: list[dict], synonyms: list[dict], buckets: dict[str, list[str]]) -> Vocabulary:
    """Tables of what configuration files say: rules with name, priority, match (places, keywords_any, keywords_all) and output (topic_path, tags); synonyms with canonical and variants."""
    ruled, terms = [], []
    for n, r in enumerate(rules):
        out, match = r.get("output") or {}, r.get("match") or {}
        ruled.append((n, int(r.get("priority") or 0), n, out.get("topic_path"), [t.strip() for t in out.get("tags") or [] if t.strip()]))
        terms += [(n, kind, t.strip()) for kind, name in (("place", "places"), ("any", "keywords_any"), ("all", "keywords_all")) for t in dict.fromkeys(match.get(name) or []) if t.strip()]
    known: dict[str, str] = {}
    for s in synonyms:
        known |= {v.strip(): s["canonical"].strip() for v in s.get("variants") or [] if v.strip() and s.get("canonical", "").strip()}
    return Vocabulary(
        spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(t,) for t in tags], "tag string"), spark.createDataFrame(ruled, "rule long, priority int, place long, topic_path string, tags array<string>"),
        spark.createDataFrame(terms, "rule long, kind string, term string"), spark.createDataFrame([(v, c, n) for n, (v, c) in enumerate(known.items())], "variant string, canonical string, place long"),
        spark.createDataFrame([(p, n, t) for n, (p, all_) in enumerate(buckets.items()) for t in all_], "path string, place long, term string"),
    )


def read_vocabulary(spark: SparkSession, folder: str, buckets: dict[str, list[str]], kind: str = "yaml") -> Vocabulary:
    """From topic_path, tags, normalization_rules and synonyms in a folder, each a YAML (where its parser is installed) or JSON file. They are configuration: a file is read whole."""

    def parsed(name: str) -> dict:
        raw = spark.read.text(f"{folder}/{name}.{kind}", wholetext=True).first()
        if raw is None or kind == "json":
            return json.loads(raw.value) if raw else {}
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs its parser; give JSON instead") from e
        return yaml.safe_load(raw.value) or {}

    paths = [p["path"].strip() for p in parsed("topic_path").get("paths") or [] if p.get("path")]
    return vocabulary(spark, paths, [t.strip() for t in parsed("tags").get("tags") or []], parsed("normalization_rules").get("rules") or [], parsed("synonyms").get("synonyms") or [], buckets)


def derived(text: Column, most: int = 8) -> Column:
    """Keywords of a text: its first Latin words in lower case, then pieces of its Chinese runs (the first, second and last two characters of long ones)."""
    none = F.array().cast("array<string>")
    words = F.array_except(F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9_+\-]{2,})"), 1), F.lower), F.array(*map(F.lit, DULL)))
    runs = F.filter(F.regexp_extract_all(text, F.lit("([一-鿿]{2,})"), 1), lambda x: ~x.isin(DULL_RUNS))
    pieces = F.flatten(F.transform(runs, lambda x: F.when(F.char_length(x) <= 4, F.array(x)).otherwise(F.array(F.substring(x, 1, 2), F.substring(x, 3, 2), F.substring(x, -2, 2)))))
    return F.slice(F.array_distinct(F.concat(words, F.array_except(F.coalesce(pieces, none), F.array(*map(F.lit, DULL_RUNS))))), 1, most)


def _grams(text: Column) -> Column:
    """Distinct characters and pairs of characters of a text."""
    at = F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(F.substring(text, i, F.lit(1)), F.substring(text, i, F.lit(2))))))


def found(events: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term, in_text, in_keywords, nth) of distinct terms (term) that events (id, text, keywords) have; nth is the first keyword that is the term."""
    _, own = small(terms.select("term").distinct().withColumn("gram", F.substring("term", 1, 2)), MOST_TERMS)
    text = events.select("id", "text", F.explode(_grams(F.col("text"))).alias("gram")).join(own, "gram").filter(F.contains("text", F.col("term"))).select("id", "term", F.lit(True).alias("in_text"), F.lit(None).cast("int").alias("nth"))
    words = events.select("id", F.posexplode("keywords").alias("nth", "term")).join(own.select("term"), "term").select("id", "term", F.lit(False).alias("in_text"), "nth")
    return text.unionByName(words).groupBy("id", "term").agg(F.max("in_text").alias("in_text"), F.min("nth").alias("nth")).withColumn("in_keywords", F.col("nth").isNotNull())


def by_rules(hits: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(id, rule) of the first satisfied rule of each event with a hit."""
    facts = vocabulary.terms.groupBy("rule").agg(F.max(F.when(F.col("kind") == "place", 1).otherwise(0)).alias("places"), F.max(F.when(F.col("kind") == "any", 1).otherwise(0)).alias("any"), F.count_if(F.col("kind") == "all").alias("all"))
    _, terms = small(vocabulary.terms, MOST_TERMS)
    _, facts = small(facts.join(vocabulary.rules.select("rule", "priority", "place"), "rule"), MOST_TERMS)
    met = hits.join(terms, "term").groupBy("id", "rule").agg(F.max(F.when(F.col("kind") == "place", 1).otherwise(0)).alias("p"), F.max(F.when(F.col("kind") == "any", 1).otherwise(0)).alias("a"), F.count_if((F.col("kind") == "all") & F.col("in_keywords")).alias("n"))
    good = met.join(facts, "rule").filter("p >= places AND a >= any AND n = all")
    return good.groupBy("id").agg(F.min_by(F.struct("priority", "place", "rule"), F.struct(-F.col("priority"), "place")).alias("r")).select("id", "r.*")


def normalise(events: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(id, topic_path, tags, keywords, origin) of events (id, summary, desc, topic_id, topic_path, keywords, tags)."""
    clean = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.btrim(x)), lambda x: F.coalesce(x != "", F.lit(False))))
    whole = lambda *more: F.concat_ws(" ", F.filter(F.concat(F.array(*(F.btrim(F.coalesce(c, F.lit(""))) for c in ("summary", "desc", "topic_id"))), *more), lambda x: x != ""))
    e = events.select("id", "summary", "desc", F.btrim(F.coalesce("topic_id", F.lit(""))).alias("topic_id"), F.btrim("topic_path").alias("own"), clean(F.col("keywords")).alias("keywords"), clean(F.col("tags")).alias("tags"))
    e = e.withColumn("keywords", F.when(F.size("keywords") > 0, F.col("keywords")).otherwise(derived(whole())))
    e = e.withColumn("text", whole(F.col("keywords"))).drop("summary", "desc")
    v = vocabulary
    terms = v.terms.select("term").union(v.synonyms.select("variant")).union(v.buckets.select("term"))
    hits = found(e.select("id", "text", "keywords"), terms)

    rule = by_rules(hits, v)
    free = v.rules.join(v.terms, "rule", "left_anti").agg(F.min_by(F.struct("priority", "place", "rule"), F.struct(-F.col("priority"), "place")).alias("free"))
    paths = v.paths.distinct()
    good = v.synonyms.join(paths.withColumnRenamed("path", "canonical"), "canonical", "left_semi")
    _, good = small(good.select(F.col("variant").alias("term"), "canonical", "place"), MOST_TERMS)
    same = hits.join(good, "term").groupBy("id").agg(F.min_by("canonical", F.when(F.col("in_keywords"), F.col("nth"))).alias("by_keyword"), F.min_by("canonical", F.when(F.col("in_text"), F.col("place"))).alias("by_text"))
    _, loose = small(v.buckets, MOST_TERMS)
    loose = hits.join(loose, "term").groupBy("id").agg(F.min_by("path", "place").alias("bucket"))

    _, own = small(paths.select(F.col("path").alias("own"), F.lit(True).alias("_known")).filter(~F.startswith("own", F.lit(LOOSE))), MOST_TERMS)
    _, exact = small(good.select(F.col("term").alias("topic_id"), F.col("canonical").alias("by_id")), MOST_TERMS)
    _, outputs = small(v.rules.join(paths.select("path", F.col("path").alias("rule_path")), F.col("topic_path") == F.col("path"), "left").select("rule", "rule_path", F.col("tags").alias("rule_tags")), MOST_TERMS)
    out = e.join(own, "own", "left").join(exact, "topic_id", "left").join(rule, "id", "left").join(F.broadcast(free), how="left")
    r, f = F.struct("priority", "place", "rule"), F.col("free")
    first = F.when(F.col("rule").isNull() | (f["priority"] > F.col("priority")) | ((f["priority"] == F.col("priority")) & (f["place"] < F.col("place"))), F.coalesce(f["rule"], F.col("rule"))).otherwise(r["rule"])
    out = out.withColumn("rule", F.when(F.col("_known").isNull(), first)).drop("priority", "place").join(outputs, "rule", "left").join(same, "id", "left").join(loose, "id", "left")
    steps = [("own", F.when(F.col("_known"), F.col("own"))), ("rule", F.col("rule_path")), ("topic", F.col("by_id")), ("keyword", F.col("by_keyword")), ("text", F.col("by_text")), ("bucket", F.col("bucket")), ("none", F.lit(LOOSE + "general"))]
    tags = F.when(F.size("rule_tags") > 0, F.col("rule_tags")).otherwise(F.col("tags"))
    out = out.select("id", F.coalesce(*(c for _, c in steps)).alias("topic_path"), tags.alias("tags"), "keywords", F.coalesce(*(F.when(c.isNotNull(), n) for n, c in steps)).alias("origin"))
    # tags outside the vocabulary go; the vocabulary of tags is a configuration, one row with an array
    allowed = v.tags.agg(F.collect_set("tag").alias("_allowed"))
    return out.join(F.broadcast(allowed), how="left").select("id", "topic_path", F.array_intersect("tags", "_allowed").alias("tags"), "keywords", "origin")


def registered(events: DataFrame, registry: DataFrame, most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Events (id, scope, key, t) with topic_id and whether the key was known in its scope; and the registry (scope, key, topic_id, last_t) after, which holds the `most` keys of a scope that were used last."""
    ids = events.withColumn("topic_id", T.topic_id(F.col("key")))
    seen = ids.join(registry.select("scope", "key", F.lit(True).alias("known")), ["scope", "key"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    used = ids.select("scope", "key", "topic_id", F.col("t").alias("last_t")).unionByName(registry.select("scope", "key", "topic_id", "last_t"))
    each = used.groupBy("scope", "key").agg(F.first("topic_id").alias("topic_id"), F.max("last_t").alias("last_t"))
    order = Window.partitionBy("scope").orderBy(F.desc("last_t"), "key")
    return seen, each.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")
