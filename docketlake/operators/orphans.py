"""References to records that do not exist, by the time of the reference, and their cascade.

A reference (key, time) is sound if a target row with that key is alive then: it began
at or before that time and has not ended. Defined results: a null key is no reference;
a reference without a time is reported only where no target row exists at all; a target
without a begin counts as always begun, one without an end as still alive, and one that
ends no later than it begins never lives but did begin. Repeated rows count once. Empty
tables give no orphans (no references) or only ``missing`` ones (no targets). Columns
other than those named are ignored.

The cascade is a fixpoint: the direct orphans are its first round, and every further round
takes, by a semi-join down the graph of keys, the records that refer to a document orphaned
in the round before, until a round adds no document. A document is orphaned with the first
of its records.

Skew: a key may hold a third of all rows. Nothing is joined pair by pair: begins, ends
and references are summed map-side per key and moment, so that any number of rows of one
moment is one; running sums go over the hours of a key, then over the moments of an hour.
References without a time meet the keys in a plain anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.charforms import canonical_tdoc
from docketlake.operators.graph import reach
from docketlake.session import checkpoint, table


def _ever() -> Column:
    return F.lit("0001-01-01 00:00:00").cast("timestamp")


def orphan_references(
    refs: DataFrame, targets: DataFrame, *, record_id: Column, key: Column, at: Column, target_key: Column, begins: Column, ends: Column
) -> DataFrame:
    """(record_id, at, reason) of every reference without a live target; reason: missing, deleted, later."""
    r = refs.select(record_id.cast("bigint").alias("record_id"), key.alias("k"), at.alias("at")).where("k is not null").distinct()
    t = targets.select(target_key.alias("k"), F.coalesce(begins, _ever()).alias("b"), ends.alias("e")).where("k is not null")
    untimed = r.where("at is null").join(t.select("k").distinct(), "k", "left_anti").select("record_id", "at", F.lit("missing").alias("reason"))
    r = r.where("at is not null")
    lives = F.col("e").isNull() | (F.col("e") > F.col("b"))
    marks = t.select(
        "k",
        F.explode(
            F.array(
                F.struct(F.col("b").alias("ts"), F.lit(1).alias("began"), lives.cast("int").alias("alive"), F.lit(False).alias("asked")),
                F.struct(F.when(lives, F.col("e")).alias("ts"), F.lit(0).alias("began"), F.lit(-1).alias("alive"), F.lit(False).alias("asked")),
            )
        ).alias("m"),
    ).where("m.ts is not null")
    asked = r.select("k", F.struct(F.col("at").alias("ts"), F.lit(0).alias("began"), F.lit(0).alias("alive"), F.lit(True).alias("asked")).alias("m"))
    moments = marks.unionByName(asked).groupBy("k", "m.ts").agg(F.sum("m.began").alias("began"), F.sum("m.alive").alias("alive"), F.max("m.asked").alias("asked"))
    moments = moments.withColumn("hour", F.date_trunc("hour", "ts"))
    hours = moments.groupBy("k", "hour").agg(F.sum("began").alias("began"), F.sum("alive").alias("alive"), F.max("asked").alias("asked"))
    past = Window.partitionBy("k").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    before = hours.select(
        "k", "hour", "asked", F.coalesce(F.sum("began").over(past), none).alias("pre_began"), F.coalesce(F.sum("alive").over(past), none).alias("pre_alive"),
        F.sum("began").over(Window.partitionBy("k")).alias("all_began"),
    ).where("asked").drop("asked")
    within = Window.partitionBy("k", "hour").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = moments.select("k", "hour", "ts", "asked", F.sum("began").over(within).alias("began"), F.sum("alive").over(within).alias("alive")).where("asked").drop("asked")
    reason = (
        F.when(F.col("all_began") == 0, "missing")
        .when(F.col("alive") + F.col("pre_alive") > 0, F.lit(None))
        .when(F.col("began") + F.col("pre_began") > 0, "deleted")
        .otherwise("later")
    )
    bad = state.join(before, ["k", "hour"]).select("k", F.col("ts").alias("at"), reason.alias("reason")).where("reason is not null")
    return r.join(bad, ["k", "at"]).select("record_id", "at", "reason").unionByName(untimed).distinct()


def meeting_orphans(spark, sf_dir: str) -> DataFrame:
    """(src_table, record_id, at, reason): relationships against the agenda, the agenda against the manifest."""
    rel, agenda, manifest = (table(spark, sf_dir, t) for t in ("relationships", "agenda", "manifest"))
    a = orphan_references(
        rel, agenda, record_id=F.col("rel_id"), key=canonical_tdoc(F.col("to_tdoc")), at=F.col("seen_at"),
        target_key=canonical_tdoc(F.col("tdoc")), begins=F.col("received_at"), ends=F.col("deleted_at"),
    )
    b = orphan_references(
        agenda, manifest, record_id=F.col("row_id"), key=canonical_tdoc(F.col("tdoc")), at=F.col("received_at"),
        target_key=canonical_tdoc(F.col("tdoc")), begins=F.col("listed_at"), ends=F.col("removed_at"),
    )
    return a.select(F.lit("relationships").alias("src_table"), "*").unionByName(b.select(F.lit("agenda").alias("src_table"), "*"))


def inherited_orphans(orphans: DataFrame, links: DataFrame) -> DataFrame:
    """(node, depth) of every node that leads to an orphan node (node) along links child -> parent, the orphans at 0.

    A fixpoint of semi-joins down the key graph; cycles end because a node is taken once,
    at its least depth.
    """
    return reach(orphans, links.select(F.col("parent").alias("src"), F.col("child").alias("dst")))


def orphan_cascade(spark, sf_dir: str) -> DataFrame:
    """(src_table, record_id, at, kind, depth, reason): direct orphans, and records that only lead to orphaned ones.

    A document is orphaned at depth 0 if one of its agenda rows or of the references it
    makes is a direct orphan, at depth n + 1 if it refers to one of depth n. A
    relationship row is an inherited orphan of depth n + 1 if its target is sound but
    orphaned at depth n. The manifest refers to nothing, so no agenda row inherits.
    """
    rel = table(spark, sf_dir, "relationships").select(
        "rel_id", canonical_tdoc(F.col("from_tdoc")).alias("child"), canonical_tdoc(F.col("to_tdoc")).alias("parent"), "seen_at"
    )
    rel = rel.dropDuplicates(["rel_id"])
    agenda = table(spark, sf_dir, "agenda").select("row_id", canonical_tdoc(F.col("tdoc")).alias("node"))
    direct = checkpoint(meeting_orphans(spark, sf_dir))
    of_rel, of_agenda = direct.where("src_table = 'relationships'"), direct.where("src_table = 'agenda'")
    seeds = (
        agenda.join(of_agenda, agenda.row_id == of_agenda.record_id, "left_semi")
        .select("node")
        .union(rel.join(of_rel, rel.rel_id == of_rel.record_id, "left_semi").select("child"))
    )
    nodes = inherited_orphans(seeds, rel.select("child", "parent"))
    inherited = (
        rel.join(of_rel, rel.rel_id == of_rel.record_id, "left_anti")
        .join(nodes, F.col("parent") == F.col("node"))
        .select(F.lit("relationships").alias("src_table"), F.col("rel_id").alias("record_id"), F.col("seen_at").alias("at"), F.lit("inherited").alias("kind"), (F.col("depth") + 1).alias("depth"), F.lit(None).cast("string").alias("reason"))
    )
    return direct.select("src_table", "record_id", "at", F.lit("direct").alias("kind"), F.lit(0).alias("depth"), "reason").unionByName(inherited)


def p1_found(spark, sf_dir: str) -> DataFrame:
    return orphan_cascade(spark, sf_dir).where("kind = 'direct'").select("src_table", "record_id", "reason")


def p1_monthly(spark, sf_dir: str) -> DataFrame:
    """Orphans per table, month of the reference, kind and reason."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    return orphan_cascade(spark, sf_dir).groupBy("src_table", month, "kind", "reason").agg(F.count("*").alias("orphans"))


def p1_cascade(spark, sf_dir: str) -> DataFrame:
    return orphan_cascade(spark, sf_dir).drop("at")
