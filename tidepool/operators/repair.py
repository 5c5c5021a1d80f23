"""Rows from extractors made sound: every rule coerces and reports in one pass.

Each function gives the row as it should be and `errors`, an array of what was wrong with it, in the order of the rules.
What a strict caller rejects is where `errors` isn't empty; a lenient one takes the repaired values. `keep_row` is false
where nothing can be repaired: the row says nothing, or of something that isn't there.

Cases: null values take the default without an error, as they weren't given; texts are trimmed; sets of allowed values are
parameters; the tables of turns or properties that rows refer to are joined on their keys, never collected; a row comes back
once, however often its turn is in the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mark_policy
from ..sources.store import small

#: What a mark may say, and what it says if nothing is given.
CATEGORIES = ["fact", "preference", "task", "rule", "note"]
SUBTYPES = ["profile", "constraint", "commitment", "decision", "tool_grounded_fact", "user_pinned_note"]
EVIDENCE = ["S0_user_claim", "S1_ai_inference", "S2_tool_grounded", "S3_user_confirmed"]
SUBTYPE_OF = {"fact": "profile", "preference": "profile", "task": "commitment", "rule": "constraint", "note": "user_pinned_note"}
EVIDENCE_OF = {"user": "S0_user_claim", "tool": "S2_tool_grounded"}
SAVED_AT_LEAST, IMPORTANCE = 0.9, 0.5
EVENT_TYPES = ["Atomic", "Composite", "Milestone"]
STATUSES = ["mapped", "weak", "unmapped"]


def _pick(value: Column, table: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def _given(c: str, other: Column) -> Column:
    text = F.btrim(F.coalesce(F.col(c), F.lit("")))
    return F.when(text != "", text).otherwise(other)


def _errors(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items())))


def marks(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """Marks (mark_id, turn_id, keep, span_start, span_end, category, subtype, evidence_level, importance as text, saved, status) on turns (turn_id, role, text).

    Returns the same columns but status, with importance as a number, ttl_seconds, forget_policy, errors and keep_row."""
    own = turns.groupBy(F.btrim("turn_id").alias("turn_id")).agg(F.max(F.struct("role", "text")).alias("_t"))
    m = rows.withColumn("turn_id", F.btrim("turn_id")).join(own, "turn_id", "left")
    there, role, length = F.col("_t").isNotNull(), F.lower(F.btrim(F.col("_t.role"))), F.char_length(F.coalesce("_t.text", F.lit("")))
    saved = F.coalesce("saved", F.lit(False))
    asked = F.coalesce("keep", F.lit(False))
    category = F.lower(_given("category", F.lit("note")))
    good_category = F.when(~asked | category.isin(CATEGORIES), category).otherwise("note")
    subtype = _given("subtype", _pick(good_category, SUBTYPE_OF, "user_pinned_note"))
    good_subtype = F.when(~asked | subtype.isin(SUBTYPES), subtype).otherwise(_pick(good_category, SUBTYPE_OF, "user_pinned_note"))
    evidence = _given("evidence_level", _pick(role, EVIDENCE_OF, "S1_ai_inference"))
    good_evidence = F.when(~asked | evidence.isin(EVIDENCE), evidence).otherwise(_pick(role, EVIDENCE_OF, "S1_ai_inference"))
    number = F.expr("try_cast(importance AS double)")
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(IMPORTANCE))))
    some_span = F.col("span_start").isNotNull() | F.col("span_end").isNotNull()
    whole_span = (F.col("span_start") >= 0) & (F.col("span_end") > F.col("span_start")) & (F.col("span_end") <= length)
    errors = _errors({
        "unknown_turn_id": ~there, "keep_invalid": F.col("keep").isNull(), "span_invalid": some_span & (F.col("span_start").isNull() | F.col("span_end").isNull()),
        "span_range": F.col("span_start").isNotNull() & F.col("span_end").isNotNull() & ~whole_span, "category_invalid": asked & ~category.isin(CATEGORIES), "subtype_invalid": asked & ~subtype.isin(SUBTYPES),
        "evidence_invalid": asked & ~evidence.isin(EVIDENCE), "importance_invalid": F.col("importance").isNotNull() & number.isNull(), "importance_range": (number < 0) | (number > 1),
    })
    policy = mark_policy(good_category, good_evidence, F.col("status"))
    return m.select(
        "mark_id", "turn_id", (asked | saved).alias("keep"), F.when(whole_span, F.col("span_start")).alias("span_start"), F.when(whole_span, F.col("span_end")).alias("span_end"), good_category.alias("category"), good_subtype.alias("subtype"),
        good_evidence.alias("evidence_level"), F.when(saved, F.greatest(value, F.lit(SAVED_AT_LEAST))).otherwise(value).alias("importance"), saved.alias("saved"), F.when(saved, F.lit(0).cast("long")).otherwise(policy["ttl"]).alias("ttl_seconds"),
        F.when(saved, "permanent").otherwise(policy["policy"]).alias("forget_policy"), errors.alias("errors"), there.alias("keep_row"),
    )


def _turns_kept(rows: DataFrame, key: str, turns: DataFrame) -> DataFrame:
    """(key, turns): a row's known turns, in its order."""
    each = rows.select(key, F.posexplode("turn_ids").alias("n", "t")).withColumn("turn_id", F.btrim("t"))
    known = each.join(turns.select(F.btrim("turn_id").alias("turn_id")).distinct(), "turn_id", "left_semi")
    return known.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "turn_id"))), lambda x: x["turn_id"]).alias("turns"))


def _clamped(c: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))


def events(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """Events (event_id, summary, event_type, status, confidence, turn_ids) that rest on turns (turn_id): unknown turns go, and without any an event is unmapped; one without a summary says nothing."""
    e = rows.join(_turns_kept(rows, "event_id", turns), "event_id", "left").withColumn("turns", F.coalesce("turns", F.array().cast("array<string>")))
    summary, kind, status, some = F.btrim(F.coalesce("summary", F.lit(""))), _given("event_type", F.lit("Atomic")), F.lower(_given("status", F.lit("mapped"))), F.size("turns") > 0
    good_status = F.when(~some, "unmapped").when(status.isin(STATUSES), status).otherwise("mapped")
    errors = _errors({"summary_missing": summary == "", "event_type_invalid": ~kind.isin(EVENT_TYPES), "unknown_turns": F.size("turns") < F.size(F.coalesce("turn_ids", F.array().cast("array<string>"))), "status_invalid": ~status.isin(STATUSES), "confidence_range": (F.col("confidence") < 0) | (F.col("confidence") > 1)})
    return e.select("event_id", summary.alias("summary"), F.when(kind.isin(EVENT_TYPES), kind).otherwise("Atomic").alias("event_type"), good_status.alias("status"), _clamped("confidence").alias("confidence"), F.col("turns").alias("turn_ids"), F.size("turns").alias("evidence_count"), errors.alias("errors"), (summary != "").alias("keep_row"))


def states(rows: DataFrame, turns: DataFrame, properties: DataFrame) -> DataFrame:
    """States (state_id, subject, property, value, raw_value, negated, turn_ids) with values of known properties (property, allowed array or null for any, allow_raw): a value outside is `_other` with the raw value
    where the property allows that."""
    _, known = small(properties.select(F.col("property").alias("_p"), "allowed", "allow_raw"), 100_000)
    s = rows.withColumns({c: F.btrim(F.coalesce(c, F.lit(""))) for c in ("subject", "property", "value", "raw_value")}).join(_turns_kept(rows, "state_id", turns), "state_id", "left")
    s = s.join(known, F.col("property") == F.col("_p"), "left").withColumn("turns", F.coalesce("turns", F.array().cast("array<string>")))
    full = (F.col("subject") != "") & (F.col("property") != "") & (F.col("value") != "")
    outside = F.coalesce((F.size("allowed") > 0) & ~F.array_contains("allowed", F.col("value")), F.lit(False))
    raw = F.coalesce("allow_raw", F.lit(False))
    negated, there, some = F.coalesce("negated", F.lit(False)), F.col("_p").isNotNull(), F.size("turns") > 0
    errors = _errors({"incomplete": ~full, "negated": negated, "property_unknown": full & ~there, "value_outside": outside, "no_known_turn": ~some})
    other = outside & raw
    return s.select(
        "state_id", "subject", "property", F.when(other, "_other").otherwise(F.col("value")).alias("value"), F.when(F.col("raw_value") != "", F.col("raw_value")).when(other, F.col("value")).alias("raw_value"), F.col("turns").alias("turn_ids"),
        errors.alias("errors"), (full & ~negated & there & (~outside | raw) & some).alias("keep_row"),
    )
