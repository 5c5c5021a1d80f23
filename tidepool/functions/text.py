"""Scalar functions on names, topics, dates, ids."""

from __future__ import annotations

import datetime as dt
import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squeeze(name: Column) -> Column:
    return F.btrim(F.regexp_replace(name, r"\s+", " "))


def topic_token(text: Column) -> Column:
    """Lower case, one underscore for runs of space, dash and underscore, no other marks."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.btrim(text)), r"[\s\-_]+", "_"), r"[^\p{L}\p{N}_]", "")


def topic_key(path: Column, basis: Column, keywords: Column) -> Column:
    return F.concat(F.lit("v1|path="), F.coalesce(path, F.lit("")), F.lit("|basis="), F.coalesce(basis, F.lit("")), F.lit("|kw="), F.array_join(F.sort_array(F.array_distinct(keywords)), ","))


def topic_id(key: Column) -> Column:
    return F.concat(F.lit("tpk_"), F.substring(F.sha1(F.encode(key, "utf-8")), 1, 16))


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based identifier of RFC 9562, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 16 digits of the hash of parts; null parts are <none>, doubles have three digits, booleans 1 or 0 (give these as text)."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("<none>")) for p in parts)), 256), 1, 16))


def turn_number(ref: Column) -> Column:
    """The last number of a turn's name: D8:6, t12, a_3."""
    return F.regexp_extract(ref, r"(\d+)\D*$", 1).try_cast("int")


def duration_seconds(text: Column) -> Column:
    """7d, 3h, 5m, 2s or a number."""
    n, unit = F.regexp_extract(text, r"^\s*(\d+)\s*([dhms]?)\s*$", 1).try_cast("double"), F.lower(F.regexp_extract(text, r"^\s*(\d+)\s*([dhms]?)\s*$", 2))
    return n * F.when(unit == "d", 86400).when(unit == "h", 3600).when(unit == "m", 60).otherwise(1)


def time_bucket(t: Column) -> Column:
    return F.array(F.date_format(t, "yyyy"), F.date_format(t, "yyyy-MM"), F.date_format(t, "yyyy-MM-dd"))


def chat_time(text: Column) -> Column:
    """'1:56 pm on 8 May, 2023'."""
    return F.try_to_timestamp(F.upper(text), F.lit("h:mm a 'ON' d MMMM, yyyy"))


def proper_names(text: Column) -> Column:
    """Runs of capitalised ASCII words. Word boundaries are Unicode's on every Java, so no name ends before an accented letter."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\b([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})*)\b"), 1)


def speaker(text: Column) -> Column:
    """The name before a colon, and what it says."""
    p = r"(?s)^\s*([^:\n]{1,40}):\s*(.*)$"
    return F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).alias("speaker"), F.regexp_extract(text, p, 2).alias("body"))).otherwise(F.struct(F.lit("").alias("speaker"), text.alias("body")))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def language(text: Column) -> Column:
    return F.when(text.rlike(r"[\x{4e00}-\x{9fff}]"), "zh").otherwise("en")


def importance(word: Column) -> Column:
    return F.when(F.lower(word) == "high", 0.9).when(F.lower(word) == "medium", 0.6).when(F.lower(word) == "low", 0.3)


def governance(has_text: Column, has_control: Column, semantic: Column) -> tuple[Column, Column, Column]:
    """Importance, stability and lifetime in seconds."""
    value = 0.5 + F.when(has_text, 0.1).otherwise(0.0) + F.when(has_control, 0.1).otherwise(0.0)
    stable = 0.5 + F.when(semantic, 0.2).otherwise(0.0)
    return value, stable, F.when(value >= 0.8, 0).when(value >= 0.6, 7 * 86400).otherwise(86400)


def governed(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Lifetimes and importances changed by domain: rows (domain, ttl in seconds, importance, ttl_pinned, importance_pinned) and rules (domain, ttl as a duration, delta).

    A rule's lifetime takes the place of a row's, its delta is added within 0 and 1, unless pinned; a duration that can't be read changes nothing. Domains are few (a configuration)."""
    r = rules.groupBy(F.col("domain").alias("_domain")).agg(F.max(F.struct("ttl", "delta")).alias("_r"))
    both = rows.join(F.broadcast(r), F.col("domain") == F.col("_domain"), "left")
    free = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    seconds = duration_seconds(F.col("_r.ttl"))
    ttl = F.when(free("ttl_pinned") & seconds.isNotNull(), F.greatest(F.lit(0.0), seconds))
    value = F.when(free("importance_pinned") & F.col("_r.delta").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("importance", F.lit(0.5)) + F.col("_r.delta"))))
    return both.withColumns({"ttl": F.coalesce(ttl, F.col("ttl")), "importance": F.coalesce(value, F.col("importance"))}).drop("_domain", "_r")


def keywords(text: Column, stop: list[str], most: int = 8) -> Column:
    """The first different words that say something."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{3,})"), 1)
    return F.slice(F.array_except(F.array_distinct(words), F.array(*map(F.lit, stop)).cast("array<string>")), 1, most)


def normalised_topic(path: Column, text: Column, known: list[str], rules: dict[str, list[str]], fallback: str = "_uncategorized/general") -> Column:
    """A known path stays; else the first rule with a word in the text; else the fallback."""
    out = F.lit(fallback)
    for topic, words in reversed(list(rules.items())):
        out = F.when(F.lower(text).rlike("|".join(map(re.escape, words))), topic).otherwise(out)
    return F.when(path.isin(*known), path).otherwise(out)


def xywh(bbox: Column) -> Column:
    """Corners as corner and size; null where the box has none."""
    w, h = bbox[2] - bbox[0], bbox[3] - bbox[1]
    return F.when((F.size(bbox) == 4) & (w > 0) & (h > 0), F.array(bbox[0], bbox[1], w, h))


def time_range(text: Column, as_of: Column) -> Column:
    """What a text says of time, as a struct of start and end (excluded) or null: two dates with to, until, and, a dash or dots between them (either order); one date, month or year
    written with digits; or today, yesterday, this or last week, month and year, in English or Chinese. The first of these that it has counts; a date that doesn't exist doesn't."""
    low, day, iso = F.lower(F.coalesce(text, F.lit(""))), F.date_trunc("DAY", as_of).cast("timestamp_ntz"), r"(\d{4}-\d{1,2}-\d{1,2})"
    to = r"\s*(?:to|until|and|through|till|-|–|\.\.|到|至)\s*"
    date = lambda p, g=1: F.try_to_timestamp(F.regexp_extract(low, p, g), F.lit("y-M-d")).cast("timestamp_ntz")
    one = F.expr("INTERVAL 1 DAY")
    a, b = date(iso + to + iso, 1), date(iso + to + iso, 2)
    month = F.try_to_timestamp(F.regexp_extract(low, r"\b(\d{4}-\d{1,2})(?![\d-])", 1), F.lit("y-M")).cast("timestamp_ntz")
    year = F.try_to_timestamp(F.regexp_extract(low, r"\b((?:19|20)\d{2})(?![\d-])", 1), F.lit("y")).cast("timestamp_ntz")
    span = lambda unit: F.date_trunc(unit, day).cast("timestamp_ntz")
    back = lambda unit: span(unit) - F.expr(f"INTERVAL 1 {unit}")
    pair = lambda x, y: F.struct(x.alias("start"), y.alias("end"))
    says = lambda *words: low.rlike("|".join(words))
    named = [
        (says("yesterday", "昨天"), pair(day - one, day)), (says("today", "今天"), pair(day, day + one)), (says("last week", "上周"), pair(back("WEEK"), span("WEEK"))), (says("this week", "本周", "这周"), pair(span("WEEK"), span("WEEK") + F.expr("INTERVAL 1 WEEK"))),
        (says("last month", "上个月"), pair(back("MONTH"), span("MONTH"))), (says("this month", "这个月", "本月"), pair(span("MONTH"), span("MONTH") + F.expr("INTERVAL 1 MONTH"))), (says("last year", "去年"), pair(back("YEAR"), span("YEAR"))), (says("this year", "今年"), pair(span("YEAR"), span("YEAR") + F.expr("INTERVAL 1 YEAR"))),
    ]
    single = date(r"\b" + iso + r"\b")
    return F.coalesce(
        F.when(a.isNotNull() & b.isNotNull(), pair(F.least(a, b), F.greatest(a, b) + one)), F.when(single.isNotNull(), pair(single, single + one)), F.when(month.isNotNull(), pair(month, month + F.expr("INTERVAL 1 MONTH"))),
        F.when(year.isNotNull(), pair(year, year + F.expr("INTERVAL 1 YEAR"))), *(F.when(c, v) for c, v in named),
    )


def time_window(question: str, as_of: dt.datetime) -> tuple[dt.datetime, dt.datetime] | None:
    """What a question says of time, on the driver: a date, today, yesterday, last week or month."""
    q, day = question.lower(), as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    one = dt.timedelta(days=1)
    if m := re.search(r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", q):
        start = dt.datetime(*map(int, m.groups()))
        return start, start + one
    if "yesterday" in q or "昨天" in q:
        return day - one, day
    if "today" in q or "今天" in q:
        return day, day + one
    if "last week" in q or "上周" in q:
        monday = day - dt.timedelta(days=day.weekday())
        return monday - 7 * one, monday
    if "last month" in q or "上个月" in q:
        first = day.replace(day=1)
        return (first - one).replace(day=1), first
    return None


def mark_policy(category: Column, evidence: Column, status: Column) -> Column:
    """How long a mark lives by default: struct of ttl (seconds, 0 for no end) and policy."""
    grounded = evidence.isin("S2_tool_grounded", "S3_user_confirmed")
    lasting = category.isin("preference", "rule") | ((category == "fact") & F.coalesce(grounded, F.lit(False)))
    finished = F.lower(status).isin("done", "completed", "closed")
    days = F.when(lasting, 0).when(category == "fact", 180).when((category == "task") & finished, 7).otherwise(30)
    policy = F.when(category == "preference", "until_changed").when(lasting, "permanent").otherwise("temporary")
    return F.struct((days * 86_400).cast("long").alias("ttl"), policy.alias("policy"))


def cut(text: Column, most: int) -> Column:
    """Text of at most so many characters, with an ellipsis where some are missing."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("\u2026"))).otherwise(text)


def compact(items: Column, n: int, most: int) -> Column:
    """The first n texts of an array that have any, each cut."""
    return F.transform(F.slice(F.filter(items, lambda x: F.length(F.btrim(x)) > 0), 1, n), lambda x: cut(x, most))


def digest(given: Column, utterances: Column, modality: Column, start: Column, end: Column) -> Column:
    """A window's summary: the given one, else the texts of its first two utterances, else what it is and when."""
    said = F.array_join(F.filter(F.slice(utterances, 1, 2), lambda x: F.length(F.btrim(x)) > 0), " ")
    when = F.concat(modality, F.lit(" activity in "), F.format_string("%.1f-%.1fs", start, end))
    some = lambda x: F.when(F.length(F.btrim(x)) > 0, x)
    return F.coalesce(some(given), some(said), when)
