"""Resolving meetings named in words: one meeting, several candidates, or a reason why not.

Ambiguous and unresolved are values, never exceptions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.text import group_code, meeting_descriptor

SHOWN = 10  # candidates listed with an ambiguous hint


def calendar_order(calendar: DataFrame) -> DataFrame:
    """Calendar rows, each (wg, meeting_no, suffix, start_date) once, with order_no by number and suffix within the group."""
    keys = ["wg", "meeting_no", "suffix", "start_date"]
    rest = [c for c in calendar.columns if c not in keys]
    once = calendar.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else calendar.distinct()
    w = Window.partitionBy("wg").orderBy(F.try_to_number("meeting_no", F.lit("99999")), F.coalesce("suffix", F.lit("")), "start_date")
    return once.withColumn("order_no", F.row_number().over(w).cast("bigint"))


def calendar_rows(rows: DataFrame) -> DataFrame:
    """Calendar (wg code, meeting_no, suffix, start_date, end_date, meeting_kind, source) from table rows (wg, source, cells) of a group's calendar page.

    A row counts if it names a meeting of the group and a date; the first date is the start, the second the end.
    """
    r = rows.select("wg", "source", F.array_join("cells", " ", "").alias("text"))
    r = r.withColumn("m", F.expr(r"get(regexp_extract_all(text, concat('(?i)\\b', wg, '[-\\s]?([0-9]+(?:[-\\s]?[A-Za-z][A-Za-z0-9-]*)?)\\b'), 1), 0)"))
    dates = F.transform(F.regexp_extract_all("text", F.lit(r"\b(20\d{2}[-\x{2010}-\x{2015}]\d{2}[-\x{2010}-\x{2015}]\d{2})\b"), F.lit(1)), lambda d: F.try_to_date(F.regexp_replace(d, r"[\x{2010}-\x{2015}]", "-"), "yyyy-MM-dd"))
    r = r.withColumn("d", F.filter(dates, lambda d: d.isNotNull())).where("m is not null and size(d) > 0")
    kind = F.when(F.col("text").rlike(r"(?i)\b(?:AHG|SWG)\b"), "subgroup").otherwise("working_group")
    out = r.select(
        "wg", F.regexp_extract("m", "^([0-9]+)", 1).alias("meeting_no"), F.nullif(F.lower(F.regexp_extract("m", r"^[0-9]+[-\s]?(.*)$", 1)), F.lit("")).alias("suffix"),
        F.try_element_at("d", F.lit(1)).alias("start_date"), F.try_element_at("d", F.lit(2)).alias("end_date"), kind.alias("meeting_kind"), "source",
    )
    return out.dropDuplicates(["wg", "meeting_no", "suffix", "start_date"])


def month_matches(hints: DataFrame, calendar: DataFrame) -> DataFrame:
    """hints (hint_id, wg code, year, month) with the calendar rows of that group and month."""
    c = calendar.withColumnRenamed("wg", "_wg")
    return hints.join(c, (F.col("wg") == F.col("_wg")) & (F.year("start_date") == F.col("year")) & (F.month("start_date") == F.col("month"))).drop("_wg")


def directory_matches(hints: DataFrame, directories: DataFrame) -> DataFrame:
    """(hint_id, name, url, score) of directories (wg code, name, url) that can be the meeting (number, suffix).

    The number must stand apart from other digits; 5 for it, 3 more if every part of the
    suffix is a part of the name. A suffix that is asked for must be there.
    """
    parts = F.filter(F.split(F.lower(F.col("name")), r"[^a-z0-9]+"), lambda p: p != "")
    asked = F.filter(F.split(F.coalesce("suffix", F.lit("")), "[^a-z0-9]+"), lambda p: p != "")
    d = directories.withColumnRenamed("wg", "_wg")
    joined = hints.where("number is not null").join(d, F.col("wg") == F.col("_wg"))
    hit = F.expr("regexp_like(name, concat('(?<![0-9])', number, '(?![0-9])'))")
    suffix_ok = F.forall(asked, lambda s: F.array_contains(parts, s))
    return joined.where(hit & suffix_ok).select("hint_id", "name", "url", (F.lit(5) + F.when(F.size(asked) > 0, 3).otherwise(0)).alias("score"))


def best_or_tied(candidates: DataFrame, key: str = "hint_id") -> DataFrame:
    """Per key the best score, how many share it, the one name if it is unique, and the first SHOWN candidates."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "name")
    ranked = candidates.withColumn("place", F.row_number().over(w)).withColumn("best", F.max("score").over(Window.partitionBy(key)))
    return ranked.groupBy(key).agg(
        F.max("best").alias("best_score"),
        F.count_if(F.col("score") == F.col("best")).alias("tied"),
        F.min_by("url", "place").alias("first_url"),
        F.array_sort(F.collect_list(F.when(F.col("place") <= SHOWN, F.struct("place", "name", "url", "score")))).alias("candidates"),
    )


def resolve_meetings(hints: DataFrame, calendar: DataFrame, directories: DataFrame) -> DataFrame:
    """One row per hint (hint_id, hint): status, kind, confidence, selected_url, reason, candidates.

    calendar: (wg code, meeting_no, suffix, start_date, meeting_kind); directories: (wg code,
    name, url). A ladder, the first that applies: an address is taken as it is; no group or
    neither number nor month is unresolved; a month must have exactly one working-group
    meeting (subgroup meetings only if the hint asks for one), and its number the hint's;
    then the directory must be unique. Null and empty hints are unresolved.
    """
    d = hints.withColumn("d", meeting_descriptor(F.coalesce("hint", F.lit(""))))
    d = d.select("hint_id", "hint", group_code(F.col("d.wg")).alias("wg"), "d.number", "d.suffix", "d.year", "d.month")
    subgroup = F.coalesce(F.col("suffix").rlike("(?i)ah|swg"), F.lit(False)) | F.col("hint").rlike(r"(?i)\b(ahg?|swg|ad hoc)\b")
    d = d.withColumn("wants_subgroup", F.coalesce(subgroup, F.lit(False)))
    m = month_matches(d.select("hint_id", "wg", "year", "month", "wants_subgroup", F.col("number").alias("asked")), calendar.select("wg", "meeting_no", "suffix", "start_date", "meeting_kind").distinct())
    fits = (F.col("meeting_kind") == "subgroup") == F.col("wants_subgroup")
    m = m.groupBy("hint_id").agg(
        F.count_if(fits).alias("in_month"),
        F.count_if(fits & (F.col("meeting_no") == F.col("asked"))).alias("asked_in_month"),
        F.min(F.when(fits, F.col("meeting_no"))).alias("month_number"),
        F.array_sort(F.collect_list(F.when(~fits, F.struct("meeting_no", "suffix", "start_date")))).alias("excluded"),
    )
    d = d.join(m, "hint_id", "left").na.fill(0, ["in_month", "asked_in_month"])
    d = d.withColumn("use_number", F.coalesce("number", F.when(F.col("in_month") == 1, F.col("month_number"))))
    found = best_or_tied(directory_matches(d.select("hint_id", "wg", F.col("use_number").alias("number"), "suffix"), directories.select("wg", "name", "url").distinct()))
    d = d.join(found, "hint_id", "left").na.fill(0, ["tied"])
    address = F.coalesce(F.col("hint").rlike(r"(?i)^(https?|file)://"), F.lit(False))
    dated = F.col("month").isNotNull()
    reason = (
        F.when(address, F.lit(None).cast("string"))
        .when(F.col("wg").isNull(), "no group")
        .when(F.col("number").isNull() & ~dated, "neither number nor month")
        .when(dated & (F.col("in_month") == 0), "no meeting in that month")
        .when(dated & F.col("number").isNotNull() & (F.col("asked_in_month") == 0), "number not in that month")
        .when(dated & F.col("number").isNull() & (F.col("in_month") > 1), "several meetings in that month")
        .when(F.col("tied") == 0, "no directory")
        .when(F.col("tied") > 1, "several directories")
    )
    d = d.withColumn("reason", reason)
    ambiguous = F.col("reason").isin("number not in that month", "several meetings in that month", "several directories")
    done = F.col("reason").isNull()
    return d.select(
        "hint_id",
        "hint",
        "wg",
        F.when(done, "resolved").when(ambiguous, "ambiguous").otherwise("unresolved").alias("status"),
        F.when(address, F.when(F.col("hint").rlike("(?i)^file:"), "file_uri").otherwise("url")).otherwise("name").alias("kind"),
        F.when(address, "explicit").when(done, "high").when(ambiguous, "candidate").otherwise("unresolved").alias("confidence"),
        F.when(address, F.col("hint")).when(done, F.col("first_url")).alias("selected_url"),
        "reason",
        "use_number",
        F.array_compact("candidates").alias("candidates"),
    )
