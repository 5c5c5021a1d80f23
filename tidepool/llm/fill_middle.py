"""Fill-in-the-middle rewriting with relational units.

1. Every text is cut into units by a pattern (lines by default) and only the units' lengths go on, once for each id and text.
2. posexplode makes a row of each unit, and a window sums up the lengths of the units before it.
3. A document asks for two cuts, each the ordinal of a unit; requests meet units by an equi-join and an aggregate per
   document gives the two offsets.
4. The offsets are joined to the texts, and prefix, middle and suffix are substrings. The offsets are the small side of
   that join, so texts are shuffled once and never sorted, and adaptive execution may split or broadcast it.

Cuts and forms are drawn from a hash of seed and id, so they don't depend on partitions or on the order of rows.

Cases: a null text is empty; an empty text, one that has a sentinel in it, or one that its units don't cover is plain;
a null id is hashed as an empty one; repeated rows each give a row; of repeated ids with other texts each is cut by its
own units; an empty table gives none; other columns are not read. Texts of one id are told apart by 64 bits and their length.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import texts

LINES = r"[^\n]*\n|[^\n]+"
#: Prefix, suffix and middle. Each begins with a character that it has nowhere else, so none can arise where pieces meet.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 7
FIM_PERCENT = 100
SPM_PERCENT = 50


def _draws(seed: int) -> list[Column]:
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.col("_id")), "utf-8"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _quoted(sentinel: str) -> str:
    return re.sub(r"(\W)", r"\\\1", sentinel)


KEY = ["_id", "_hash", "_size"]


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _id, _hash, _size): id, hash and size tell texts apart."""
    return texts(docs).withColumns({"_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_hash": F.xxhash64("text"), "_size": F.char_length("text")})


def offsets(docs: DataFrame, unit: str = LINES, seed: int = SEED) -> DataFrame:
    """(_id, _hash, _size, n, covered, low, high): a text's units, the code points they cover, and its two cuts in code points."""
    lengths = F.transform(F.regexp_extract_all("text", F.lit(f"({unit})"), F.lit(0)), F.char_length)
    once = _keyed(docs).select(*KEY, lengths.alias("lengths")).groupBy(*KEY).agg(F.first("lengths").alias("lengths"))
    # unit 0 is empty, so that a cut before the first unit meets a row as well
    units = once.select(*KEY, F.posexplode(F.concat(F.array(F.lit(0)), "lengths")).alias("ordinal", "length"))
    before = Window.partitionBy(*KEY).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = units.select(*KEY, "ordinal", F.sum("length").over(before).alias("end"))
    h1, h2, _, _ = _draws(seed)
    n = F.size("lengths")
    asked = once.select(*KEY, n.cast("long").alias("n"), F.posexplode(F.array((h1 % (n + 1)).cast("int"), (h2 % (n + 1)).cast("int"), n)).alias("request", "ordinal"))
    cut = F.when(F.col("request") < 2, F.col("end"))
    return asked.join(ends, [*KEY, "ordinal"]).groupBy(*KEY, "n").agg(F.max("end").alias("covered"), F.min(cut).alias("low"), F.max(cut).alias("high"))


def rewritten(docs: DataFrame, unit: str = LINES, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Per row: doc_id, text, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output."""
    p, s, m = map(F.lit, sentinels)
    whole = _keyed(docs).join(offsets(docs, unit, seed).hint("shuffle_hash"), KEY)
    _, _, h3, h4 = _draws(seed)
    marked = F.contains("text", p) | F.contains("text", s) | F.contains("text", m)
    plain = (F.col("n") == 0) | marked | (F.col("covered") != F.col("_size")) | (h3 % 100 >= fim_percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    whole = whole.select("doc_id", "text", "n", form.alias("form"), F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high"))
    prefix, middle, suffix = F.expr("substring(text, 1, low)"), F.expr("substring(text, low + 1, high - low)"), F.expr("substring(text, high + 1)")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut = F.col("form") != "plain"
    return whole.select("doc_id", "text", "n", "form", F.when(cut, F.col("low").cast("long")).alias("prefix_chars"), F.when(cut, (F.col("high") - F.col("low")).cast("long")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made from."""
    p, s, m = sentinels
    psm = F.split(F.substr(output, F.lit(len(p) + 1)), f"{_quoted(s)}|{_quoted(m)}", -1)
    spm = F.split(F.substr(output, F.lit(len(s) + 1)), f"{_quoted(p)}|{_quoted(m)}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(psm[0], psm[2], psm[1])).otherwise(F.concat(spm[1], spm[2], spm[0]))


def digests(docs: DataFrame, **options: object) -> DataFrame:
    """rewritten() with hashes in place of texts: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    hashed = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    out = rewritten(docs, **options)
    back = restored(F.col("output"), F.col("form"), options.get("sentinels", SENTINELS))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(back).alias("restored_sha256"))
