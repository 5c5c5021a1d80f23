"""Quality rules: base counts of a text and robust multivariate outliers, in DataFrame functions only.

Each text gets counts (words, characters in words, symbols, repeated lines, words in repeated 3-word windows), and from
them a vector of four transformed statistics. For each language and source, and for all rows together, the location and
scatter of these vectors are estimated by the minimum covariance determinant. A pass over the vectors gives several
starts: medians and quartiles, mean and covariance, and random subsets of five rows. Concentration steps keep the share
of rows nearest to an estimate and estimate again from those, which never raises the determinant; after a few steps
the start with the least determinant goes on until its determinant no longer falls. A step is one aggregate: rows
are counted and summed by steps of their distance, so its result has some hundred rows a group, whatever the group's size.
Each group's estimate counts with its rows against that of all rows with PRIOR rows, so small groups lean on the latter
and large ones don't. Rows whose squared Mahalanobis distance exceeds a chi-square quantile are rejected.

A statistic that hardly varies in clean text would make any deviation an outlier; so each has a floor of its standard
deviation, below which differences don't count.

Cases: null and empty texts and those of fewer than 50 words fail the base rules and aren't part of estimates; null lang
or source counts as an empty one; repeated rows each count; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: Fixed classes: white space between words, symbols.
SPACE = "[\\x20\\x09-\\x0D]"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT = 50
#: Share of rows that the concentration steps keep; steps that all starts take, and the most that the best one takes.
KEPT = 0.75
FIRST_STEPS, MOST_STEPS = 2, 12
#: Random starts, each from five rows.
RANDOM = 3
#: A determinant counts as lower if its logarithm falls by this much.
LOWER = 1e-3
#: Squared distances are told apart by this share of a doubling.
GRAIN = 16
#: The estimate of all rows counts like so many rows of a group.
PRIOR = 40.0
#: Rows beyond this quantile of chi-square (4 degrees of freedom) are outliers.
CONFIDENCE = 1 - 1e-5
#: Groups up to this many are broadcast (a few hundred bytes each); beyond, they are joined.
BROADCAST_GROUPS = 20_000
#: The vector and the least standard deviation of each part.
VECTOR = {
    "v1": ("ln((word_chars + 1) / (n_words + 1))", 0.12),
    "v2": ("sqrt(n_symbols / (word_chars + 1))", 0.025),
    "v3": ("sqrt(n_dup_lines / (n_words + 1))", 0.06),
    "v4": ("sqrt(n_repeat_words / (n_words + 1))", 0.12),
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _split(docs: DataFrame) -> DataFrame:
    """docs with _w (words), _l (lines with a word), _s (symbols)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return docs.withColumns({"_w": words, "_l": lines, "_s": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")})


def _windows(words: Column) -> Column:
    """Sorted (hash, start) of all 3-word windows."""
    n = F.size(words)
    pair = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))
    return F.when(n < 3, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), pair)))


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with the five counts and base_failed; every other column stays."""
    kept = docs.columns
    first = _split(docs).select(*kept, "_w", "_l", "_s", _windows(F.col("_w")).alias("_p"))
    p = F.col("_p")
    same = lambda x, j: F.coalesce(x["h"] == F.get(p, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(p, j + 1)["h"], F.lit(False))
    starts = F.when(F.size(F.array_distinct(F.transform(p, lambda x: x["h"]))) == F.size(p), F.array().cast("array<int>")).otherwise(F.sort_array(F.transform(F.filter(p, same), lambda x: x["i"])))
    second = first.select(*kept, F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), F.col("_s").alias("n_symbols"),
                          (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), starts.alias("_r"))
    r = F.col("_r")
    covered = F.aggregate(F.transform(r, lambda x, j: F.least(F.lit(3), x - F.coalesce(F.get(r, j - 1), x - 3))), F.lit(0).cast("long"), lambda a, x: a + x)
    repeats = F.when(F.size(r) > 0, covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words")
    # a generator of one row: filters on the counts stay above it, rather than computing them again for each mention
    out = second.select(*kept, F.inline(F.array(F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", repeats))))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


def vectors(counted: DataFrame) -> DataFrame:
    return counted.withColumns({k: F.expr(e) for k, (e, _) in VECTOR.items()}).withColumns({"g1": F.coalesce(F.col("lang").cast("string"), F.lit("")), "g2": F.coalesce(F.col("source").cast("string"), F.lit(""))})


def chi_square(x: float, even: int) -> float:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(even // 2))


def chi_square_quantile(p: float, even: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, even) < p else (low, mid)
    return high


P = len(VECTOR)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
ESTIMATE = [*(f"m_{i}" for i in range(P)), *(f"c_{i}{j}" for i, j in PAIRS)]


def _whitening(groups: DataFrame) -> DataFrame:
    """Adds to means m_i and covariances c_ij (i <= j) the inverse w_ij of the Cholesky factor, in closed form, and the logarithm of the determinant."""
    floors = [least**2 for _, least in VECTOR.values()]
    low: dict[tuple[int, int], Column] = {}
    out = groups
    for j in range(P):
        for i in range(j, P):
            rest = F.col(f"c_{j}{i}")
            if i == j:
                rest = F.greatest(rest, F.lit(0.0)) + F.lit(floors[i])
            for k in range(j):
                rest = rest - low[i, k] * low[j, k]
            out = out.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(rest, F.lit(floors[i] / 4))) if i == j else rest / low[j, j])
            low[i, j] = F.col(f"l_{i}{j}")
    for i in range(P):
        for j in range(i + 1):
            value = F.lit(1.0) if i == j else -sum((low[i, k] * F.col(f"w_{k}{j}") for k in range(j, i)), F.lit(0.0))
            out = out.withColumn(f"w_{i}{j}", value / low[i, i])
    out = out.withColumn("det", 2 * sum((F.log(low[i, i]) for i in range(P)), F.lit(0.0)))
    return out.drop(*(f"l_{i}{j}" for i, j in low))


def _distance() -> Column:
    z = [F.col(f"v{i + 1}") - F.col(f"m_{i}") for i in range(P)]
    return sum((F.pow(sum((F.col(f"w_{i}{j}") * z[j] for j in range(i + 1)), F.lit(0.0)), F.lit(2.0)) for i in range(P)), F.lit(0.0))


def _starts(rows: DataFrame) -> DataFrame:
    """(g1, g2, start, n, estimates): 0 from quartiles, 1 from means and covariances, then from random subsets, in one pass."""
    v = [F.col(f"v{i + 1}") for i in range(P)]
    point = F.struct(*v)
    picks = [F.min_by(point, F.xxhash64(*v, F.lit(k))).alias(f"r_{k}") for k in range(RANDOM * (P + 1))]
    facts = rows.groupBy("g1", "g2").agg(
        F.count(F.lit(1)).alias("n"), *(F.percentile_approx(x, [0.25, 0.5, 0.75]).alias(f"q_{i}") for i, x in enumerate(v)), *(F.avg(x).alias(f"a_{i}") for i, x in enumerate(v)),
        *(F.covar_pop(v[i], v[j]).alias(f"k_{i}{j}") for i, j in PAIRS), *picks,
    )
    starts = [{f"m_{i}": F.col(f"q_{i}")[1] for i in range(P)} | {f"c_{i}{j}": F.pow((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, F.lit(2.0)) if i == j else F.lit(0.0) for i, j in PAIRS}]
    starts.append({f"m_{i}": F.col(f"a_{i}") for i in range(P)} | {f"c_{i}{j}": F.col(f"k_{i}{j}") for i, j in PAIRS})
    for r in range(RANDOM):
        own = [[F.col(f"r_{k}")[f"v{i + 1}"] for k in range(r * (P + 1), (r + 1) * (P + 1))] for i in range(P)]
        mean = [sum(x[1:], x[0]) / (P + 1) for x in own]
        starts.append({f"m_{i}": mean[i] for i in range(P)} | {f"c_{i}{j}": sum((a * b for a, b in zip(own[i], own[j], strict=True)), F.lit(0.0)) / (P + 1) - mean[i] * mean[j] for i, j in PAIRS})
    each = F.array(*(F.struct(F.lit(k).alias("start"), *(x[c].cast("double").alias(c) for c in ESTIMATE)) for k, x in enumerate(starts)))
    facts = written(facts, "facts")
    return _whitening(written(facts.select("g1", "g2", "n", F.inline(each)), "subsets"))


def _concentrated(rows: DataFrame, now: DataFrame, few: bool) -> DataFrame:
    """One step: estimates from the share of rows nearest to each estimate of their group."""
    keys = ["g1", "g2", "start", "n"]
    v = [F.col(f"v{i + 1}") for i in range(P)]
    near = rows.join(F.broadcast(now) if few else now, ["g1", "g2"])
    near = near.withColumn("at", F.floor(GRAIN * F.log2(_distance() + 1e-6)))
    sums = [*(F.sum(x).alias(f"s_{i}") for i, x in enumerate(v)), *(F.sum(v[i] * v[j]).alias(f"t_{i}{j}") for i, j in PAIRS)]
    by_distance = near.groupBy(*keys, "at").agg(F.count(F.lit(1)).alias("k"), *sums)
    before = F.sum("k").over(Window.partitionBy(*keys).orderBy("at")) - F.col("k")  # some hundred steps of distance a group
    by_distance = by_distance.withColumn("take", F.least(F.greatest((KEPT * F.col("n") - before) / F.col("k"), F.lit(0.0)), F.lit(1.0)))
    names = [*(f"s_{i}" for i in range(P)), *(f"t_{i}{j}" for i, j in PAIRS)]
    total = by_distance.groupBy(*keys).agg(*(F.sum(F.col("take") * F.col(c)).alias(c) for c in names))
    held = KEPT * F.col("n")
    # the scatter of the nearest share of normal rows is too small by this factor
    factor = KEPT / chi_square(chi_square_quantile(KEPT, P), P + 2)
    mean = {i: F.col(f"s_{i}") / held for i in range(P)}
    return _whitening(total.select(*keys, *(mean[i].alias(f"m_{i}") for i in range(P)), *((factor * (F.col(f"t_{i}{j}") / held - mean[i] * mean[j])).alias(f"c_{i}{j}") for i, j in PAIRS)))


def minimum_determinants(rows: DataFrame) -> tuple[DataFrame, bool]:
    """(g1, g2, n, estimates, det) of vectors (g1, g2, v1 ...), stored, and whether groups are few enough to broadcast."""
    now = written(_starts(rows), "starts")
    few = now.count() <= BROADCAST_GROUPS
    for _ in range(FIRST_STEPS):
        after = written(_concentrated(rows, now, few), "estimate")
        discard(now)
        now = after
    columns = [c for c in now.columns if c not in ("g1", "g2")]
    best = written(now.groupBy("g1", "g2").agg(F.min(F.struct(F.col("det").alias("_d"), *columns)).alias("b")).select("g1", "g2", *(f"b.{c}" for c in columns)), "best")
    discard(now)
    for _ in range(MOST_STEPS - FIRST_STEPS):
        after = written(_concentrated(rows, best, few), "estimate")
        lower = after.join(best.select("g1", "g2", F.col("det").alias("was")), ["g1", "g2"]).filter(F.col("det") < F.col("was") - LOWER).limit(1).count()
        discard(best)
        best = after
        if not lower:
            break
    return best, few


def fit(counted: DataFrame) -> tuple[DataFrame, bool]:
    """Estimates by (g1, g2), stored, and whether they are few enough to broadcast. counted: base_counts() with lang and source."""
    rows = written(vectors(counted.filter("NOT base_failed")).select("g1", "g2", *VECTOR), "vectors")
    # each row counts for its own group and for the group of all rows
    keys = F.inline(F.array(F.struct(F.concat(F.lit("="), "g1").alias("g1"), F.concat(F.lit("="), "g2").alias("g2")), F.struct(F.lit("*").alias("g1"), F.lit("*").alias("g2"))))
    best, few = minimum_determinants(rows.select(keys, *VECTOR))
    pooled = best.filter("g1 = '*'").select(*(F.col(c).alias(f"p_{c}") for c in ESTIMATE))
    mine = best.filter("g1 <> '*'").join(F.broadcast(pooled), how="left")  # pooled is one row
    mixed = mine.select("g1", "g2", *(((F.col("n") * F.col(c) + PRIOR * F.col(f"p_{c}")) / (F.col("n") + PRIOR)).alias(c) for c in ESTIMATE))
    out = written(_whitening(mixed).drop("det", *(f"c_{i}{j}" for i, j in PAIRS)), "groups")
    discard(rows, best)
    return out, few


def judge(counted: DataFrame, estimates: tuple[DataFrame, bool]) -> DataFrame:
    """counted with distance and kept; all its columns stay."""
    groups, few = estimates
    limit = chi_square_quantile(CONFIDENCE, P)
    columns = counted.columns
    rows = vectors(counted).withColumns({"g1": F.concat(F.lit("="), "g1"), "g2": F.concat(F.lit("="), "g2")})
    rows = rows.join(F.broadcast(groups) if few else groups, ["g1", "g2"], "left")
    distance = F.when(~F.col("base_failed"), F.sqrt(_distance()))
    return rows.select(*columns, distance.alias("distance"), (~F.col("base_failed") & F.coalesce(_distance() <= limit, F.lit(True))).alias("kept"))


def rules(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the five counts, base_failed, distance, kept."""
    slim = docs.select("doc_id", "text", "lang", "source")
    counted = written(base_counts(slim).drop("text"), "counts")
    return judge(counted, fit(counted)).drop("lang", "source").select("doc_id", *BASE, "base_failed", "distance", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns. Each text is counted once: documents are stored with their counts."""
    own = docs.select(F.struct(*docs.columns).alias("row"), "text", "lang", "source")
    counted = written(base_counts(own).drop("text"), "counted")
    return judge(counted, fit(counted.drop("row"))).filter("kept").select("row.*")
