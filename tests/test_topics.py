"""Topics by rules, synonyms and buckets."""

import json
import random

from pyspark.sql import functions as F

from tidepool.operators import topics

EVENT = "id long, summary string, desc string, topic_id string, topic_path string, keywords array<string>, tags array<string>"
PATHS = ["travel/japan", "learning/programming", "health/mental/anxiety", "health", "free"]
RULES = [
    {"priority": 50, "match": {"keywords_any": ["焦虑", "health"]}, "output": {"topic_path": "health", "tags": ["health"]}},
    {"priority": 100, "match": {"places": ["Japan", "日本"], "keywords_any": ["旅行", "travel"]}, "output": {"topic_path": "travel/japan", "tags": ["travel", "unknown"]}},
    {"priority": 90, "match": {"keywords_any": ["焦虑"]}, "output": {"topic_path": "health/mental/anxiety"}},
    {"priority": 90, "match": {"keywords_any": ["焦虑"]}, "output": {"topic_path": "later/in/the/list"}},
    {"priority": 200, "match": {"keywords_all": ["a", "b"], "keywords_any": ["x"]}, "output": {"topic_path": "not/known"}},
]
SYNONYMS = [{"canonical": "learning/programming", "variants": ["学编程", "编"]}, {"canonical": "gone", "variants": ["code"]}, {"canonical": "free", "variants": ["zz", "code2"]}]
BUCKETS = {"_uncategorized/high_entropy": ["随便聊"], "_uncategorized/work": ["工作", "job"]}
CASES = [
    ("计划日本旅行，准备机票和酒店", None, None, None, ["日本", "旅行", "机票"], None, "travel/japan", ["travel"], "rule"),
    ("最近在学编程", None, "学编程", None, None, ["health"], "learning/programming", ["health"], "topic"),
    ("随便聊聊今天的天气", None, None, None, ["随便聊"], None, "_uncategorized/high_entropy", [], "bucket"),
    ("最近很焦虑", None, None, None, ["焦虑"], None, "health/mental/anxiety", [], "rule"),
    ("trip to Japan", None, None, "travel/japan", ["travel"], ["travel", "no"], "travel/japan", ["travel"], "own"),
    ("我的job", None, None, "_uncategorized/general", ["k"], None, "_uncategorized/work", [], "bucket"),
    ("Japan only", None, None, None, None, None, "_uncategorized/general", [], "none"),
    ("x marks", None, None, "bad/path", ["b", "a", "zz"], None, "free", [], "keyword"),  # its rule leads nowhere, but synonyms follow
    ("a b", "x", None, None, ["a"], None, "_uncategorized/general", [], "none"),  # `all` needs keywords
    ("some code2 here", None, "code", None, ["q"], None, "free", [], "text"),
    (None, None, None, None, None, None, "_uncategorized/general", [], "none"),
    ("  ", "", "", "", [" ", None], [None], "_uncategorized/general", [], "none"),
]


def vocab(spark, rules=RULES):
    return topics.vocabulary(spark, PATHS, ["travel", "health"], rules, SYNONYMS, BUCKETS)


def events(spark):
    return spark.createDataFrame([(n, *c[:6]) for n, c in enumerate(CASES)], EVENT).withColumns({"term": F.lit("x"), "rule": F.lit(1), "priority": F.lit(1)})


def test_cases(spark):
    got = {r.id: (r.topic_path, r.tags, r.origin) for r in topics.normalise(events(spark), vocab(spark)).collect()}
    assert got == {n: c[6:] for n, c in enumerate(CASES)}
    free = [*RULES, {"priority": 95, "match": {}, "output": {"topic_path": "free"}}]
    got = {r.id: (r.topic_path, r.origin) for r in topics.normalise(events(spark), vocab(spark, free)).collect()}
    assert got[10] == ("free", "rule") and got[0][0] == "travel/japan" and got[3][0] == "free" and got[4][1] == "own"
    assert topics.normalise(events(spark).limit(0), vocab(spark)).count() == 0


def test_keywords_are_derived(spark):
    df = spark.createDataFrame([("The Quick plan about C-3PO C-3PO, 我们今天 去日本京都旅行看看 ok",), ("今天 天气",), ("",)], "t string")
    got = [r.k for r in df.select(topics.derived(F.col("t")).alias("k")).collect()]
    assert got == [["quick", "c-3po", "我们今天", "去日", "本京", "看看"], ["天气"], []]


def test_ten_thousand_rules_meet_only_their_terms(spark):
    """Against brute force; rows joined are those of terms that a text has, not rules times events."""
    rng = random.Random(0)
    words = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "klmnprst"]
    rules = [{"priority": rng.randrange(50), "match": {"places": [rng.choice(words)], "keywords_any": [rng.choice(words), f"kw{n}"]}, "output": {"topic_path": f"p/{n}"}} for n in range(10_000)]
    texts = [" ".join(rng.choice(words) for _ in range(6)) for _ in range(60)]
    v = topics.vocabulary(spark, [f"p/{n}" for n in range(10_000)], [], rules, [], {})
    e = spark.createDataFrame([(n, t, None, None, None, ["none"], None) for n, t in enumerate(texts)], EVENT)
    want = {}
    for n, t in enumerate(texts):
        good = [(-r["priority"], k) for k, r in enumerate(rules) if r["match"]["places"][0] in t and any(x in t for x in r["match"]["keywords_any"])]
        want[n] = f"p/{min(good)[1]}" if good else "_uncategorized/general"
    assert {r.id: r.topic_path for r in topics.normalise(e, v).collect()} == want
    plan = topics.normalise(e, v)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") <= 2  # the rows of the unconditional rule and of the tags


def test_files(spark, tmp_path):
    data = {"topic_path": {"paths": [{"path": p} for p in PATHS]}, "tags": {"tags": ["travel", "health"]}, "normalization_rules": {"rules": RULES}, "synonyms": {"synonyms": SYNONYMS}}
    for name, x in data.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(x))
        (tmp_path / f"{name}.yaml").write_text(json.dumps(x))  # JSON is YAML
    for kind in ("json", "yaml"):
        got = {r.id: r.topic_path for r in topics.normalise(events(spark), topics.read_vocabulary(spark, str(tmp_path), BUCKETS, kind)).collect()}
        assert got == {n: c[6] for n, c in enumerate(CASES)}


def test_registry_knows_keys_and_stays_small(spark):
    old = spark.createDataFrame([("s", "k1", "tpk_old", 1), ("s", "k2", "tpk_2", 2), ("o", "k1", "x", 9)], "scope string, key string, topic_id string, last_t int")
    e = spark.createDataFrame([(1, "s", "k1", 5), (2, "s", "k9", 6), (3, "s", "k9", 7)], "id int, scope string, key string, t int")
    seen, after = topics.registered(e, old, most=2)
    assert {(r.id, r.known) for r in seen.collect()} == {(1, True), (2, False), (3, False)} and len({r.topic_id for r in seen.filter("key = 'k9'").collect()}) == 1
    assert {(r.scope, r.key, r.last_t) for r in after.collect()} == {("s", "k9", 7), ("s", "k1", 5), ("o", "k1", 9)}
