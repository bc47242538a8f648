"""Scoping a question: which records it means, what belongs to them, in which order to read.

A query is words, document numbers and companies. Nothing is limited: batches order the
work, they never shorten it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.ids import KEY_ISSUE, SOLUTION, SOLUTION_VARIANT, TDOC, identifiers
from docketlake.functions.text import TOPIC_ALIASES, fold

FIELDS = ("tdoc", "title", "source_company", "status", "agenda", "comments", "discussion")
TEXT = "text"  # the row as a whole, where a record has it
ID_KINDS = {"tdocs": TDOC, "key_issues": KEY_ISSUE, "solution_variants": SOLUTION_VARIANT, "solutions": SOLUTION}
# Words that only name a kind of identifier.
STRUCTURE_WORDS = ("ki", "key", "issue", "solution", "variant", "sv")


class QueryError(ValueError):
    """A query that cannot be run as given."""


def _plain_tdoc(value: str) -> str:
    compact = re.sub(r"[^A-Za-z0-9]", "", value).upper()
    return f"{compact[:2]}-{compact[2:]}" if len(compact) >= 9 else value.strip().upper()


@dataclass(frozen=True)
class Query:
    text: str = ""
    tdocs: tuple[str, ...] = ()
    companies: tuple[str, ...] = ()
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        numbers = tuple(map(_plain_tdoc, self.tdocs))
        if wrong := [t for t in numbers if not re.fullmatch(r"[A-Z]\d-\d{7}", t)]:
            raise QueryError(f"not a document number: {', '.join(wrong)}")
        object.__setattr__(self, "tdocs", numbers)

    @property
    def terms(self) -> list[str]:
        def split(s: str) -> list[str]:
            return [w for w in re.findall(r"[a-z0-9]+(?:\.[0-9]+)?|[一-鿿]+", s.casefold()) if len(w) > 1 or w.isdigit()]

        base = split(self.text)
        return list(dict.fromkeys(base + [w for t in base for phrase in TOPIC_ALIASES.get(t, ()) for w in split(phrase)]))

    @property
    def required(self) -> dict[str, list[str]]:
        """Identifiers the text names, by kind."""
        out = {k: list(dict.fromkeys(re.findall(p, self.text, re.I))) for k, p in ID_KINDS.items()}
        return {**out, "tdocs": [_plain_tdoc(t) for t in out["tdocs"]]}

    @property
    def topic_terms(self) -> list[str]:
        """Terms that are neither numbers, identifiers asked for, nor words of identifier kinds."""
        ids = {v.casefold() for vs in self.required.values() for v in vs}
        return [t for t in self.terms if t not in STRUCTURE_WORDS and t not in ids and not re.fullmatch(r"\d+(?:\.\d+)*", t)]


def _contains_any(text: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out


def match_score(query: Query, fields: tuple[str, ...] = FIELDS) -> Column:
    """2 per topic term, 5 per kind of identifier asked for, 4 per company; -1 where one of the three is not met.

    Terms match as substrings of the folded fields; every company must match, by name or
    alias. Null fields count as empty.
    """
    hay = fold(F.concat_ws(" ", *(F.coalesce(F.col(f), F.lit("")) for f in fields)))
    ids = identifiers(hay)
    score, fail = F.lit(0), F.lit(False)
    for kind, wanted in query.required.items():
        if wanted:
            fail = fail | ~F.arrays_overlap(ids[kind], F.array(*map(F.lit, wanted)))
            score = score + 5
    if topic := query.topic_terms:
        fail = fail | ~_contains_any(hay, topic)
        for t in topic:
            score = score + F.when(hay.contains(t), 2).otherwise(0)
    for company in query.companies:
        spelled = [v.casefold().replace("ß", "ss") for v in (company, *query.aliases.get(company, ()))]
        fail = fail | ~_contains_any(hay, spelled)
        score = score + 4
    return F.when(fail, -1).otherwise(score)


def direct_matches(records: DataFrame, query: Query) -> DataFrame:
    """Records that the query means by itself: those asked for by number, else those with a score; all if nothing is asked."""
    if query.tdocs:
        return records.where(F.col("tdoc").isin(*query.tdocs))
    if not query.terms and not query.companies:
        return records
    fields = (*FIELDS, TEXT) if TEXT in records.columns else FIELDS
    return records.where(match_score(query, fields) > 0)


def scoped_records(related: DataFrame, records: DataFrame, matches: DataFrame, explicit: tuple[str, ...] = ()) -> DataFrame:
    """Every related document (tdoc) with its record, or blanks and metadata_missing, and why it is in scope."""
    direct = matches.select("tdoc").distinct().withColumn("_direct", F.lit(True))
    asked = F.col("tdoc").isin(*explicit) if explicit else F.lit(False)
    joined = related.select("tdoc").distinct().join(records.withColumn("_known", F.lit(True)), "tdoc", "left").join(direct, "tdoc", "left")
    basis = F.when(asked, "explicit_tdoc").when(F.col("_direct"), "direct_query").otherwise("explicit_relationship")
    return joined.withColumn("scope_basis", basis).withColumn("metadata_missing", F.col("_known").isNull()).drop("_known", "_direct")


def with_source(ids: DataFrame, files: DataFrame, root: str | Column = "") -> DataFrame:
    """Adds source: the least listed file (tdoc, source) of a document, else its usual place below the meeting's root."""
    first = files.groupBy("tdoc").agg(F.min("source").alias("_listed"))
    usual = F.concat(root if isinstance(root, Column) else F.lit(root), F.lit("Docs/"), F.col("tdoc"), F.lit(".zip"))
    return ids.join(first, "tdoc", "left").withColumn("source", F.coalesce("_listed", usual)).drop("_listed")


def task_priority(hints: Column, matched: Column, known: Column, explicit: Column | None = None) -> Column:
    """0 asked for, baseline or approved; 1 matched; 2 known; 3 unknown."""
    first = F.coalesce(F.arrays_overlap(hints, F.array(F.lit("approved"), F.lit("baseline"))), F.lit(False))
    if explicit is not None:
        first = first | F.coalesce(explicit, F.lit(False))
    return F.when(first, 0).when(F.coalesce(matched, F.lit(False)), 1).when(F.coalesce(known, F.lit(False)), 2).otherwise(3)


def stage(tasks: DataFrame, name: str) -> DataFrame:
    """core: priority 0, or what matched (priority 1) if there is none; complete: all."""
    if name == "complete":
        return tasks
    if name != "core":
        raise QueryError(f"no such stage: {name}")
    least = tasks.where("priority <= 1").agg(F.min("priority").alias("_least"))  # one row
    return tasks.join(F.broadcast(least), F.col("priority") == F.col("_least")).drop("_least")


def positions(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Adds each row's place, from 0, in an order of all rows.

    Places come from a range-partitioned sort and the sizes of its ranges, not from one
    window over all rows. Rows that are equal in ``order`` get some order among each other.
    """
    ranged = rows.repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism * 4, *order).withColumn("_part", F.spark_partition_id())
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row per range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + place - 1).drop("_part", "_before")


def batches(tasks: DataFrame, size: int) -> DataFrame:
    """Adds batch_no in the order (priority, tdoc)."""
    if size < 1:
        raise QueryError("a batch holds at least one document")
    return positions(tasks, ["priority", "tdoc"], "_at").withColumn("batch_no", F.floor(F.col("_at") / size)).drop("_at")


MOST_SPELLINGS = 20_000


def company_mentions(records: DataFrame, rid: str, text: Column, register: DataFrame, company_id: str = "company_id", name: str = "name", aliases: str = "aliases") -> DataFrame:
    """(record_id, company_id): every company whose name or an alias occurs in a record's folded text, as a substring.

    The spellings go to the tasks in blocks of about MOST_SPELLINGS, each as one automaton
    that finds all of them in a single pass over a text. Null texts mention nobody; blank
    spellings are left out.
    """
    import ahocorasick

    spelled = register.select(F.col(company_id).cast("bigint").alias("c"), F.explode(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))).alias("s"))
    spelled = spelled.select("c", fold(F.trim("s")).alias("s")).where("s <> ''").distinct()
    blocks = max(1, -(-spelled.count() // MOST_SPELLINGS))
    rows = records.select(F.col(rid).cast("bigint").alias("record_id"), fold(text).alias("t")).where("t is not null")
    out = None
    for b in range(blocks):
        part = spelled.where(F.pmod(F.xxhash64("s"), F.lit(blocks)) == b) if blocks > 1 else spelled
        known = records.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])  # about MOST_SPELLINGS rows

        def run(it: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            by_spelling: dict[str, set[int]] = {}
            for c, s in known.value:
                by_spelling.setdefault(s, set()).add(c)
            automaton = ahocorasick.Automaton()
            for s, cs in by_spelling.items():
                automaton.add_word(s, cs)
            automaton.make_automaton()
            for pdf in it:
                hits = [(r, c) for r, t in zip(pdf["record_id"], pdf["t"], strict=True) for c in (set().union(*(cs for _, cs in automaton.iter(t))) if by_spelling else ())]
                yield pd.DataFrame(hits, columns=["record_id", "company_id"])

        found = rows.mapInPandas(run, "record_id bigint, company_id bigint")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def distributions(records: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """(dimension, value, n) for every column of dimensions {name: column}; null and blank as (blank). One pass."""
    pairs = [F.struct(F.lit(d).alias("dimension"), F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("(blank)")).alias("value")) for d, c in dimensions.items()]
    return records.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))
