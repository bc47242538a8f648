"""Several values packed in one cell: find a source's delimiters, split, keep the position.

Delimiters are inferred for every field of every source (the file a cell came from). Every
candidate is scored over the different cells in which it is the only one, so that copies of a
cell weigh nothing: *piece type regularity* is the share of its pieces whose shape (letters
lowered, numbers, ids, quoted and bracketed parts masked) also occurs as a whole cell of the
field without any candidate, taken at the lower end of its interval, so that few pieces prove
little; *piece-count consistency* is the chance that two of its cells have the same number of
pieces. The score is regularity x (1 + consistency) / 2. The separators documented for a field
hold in every source; what is inferred is added to them.

Scores and plain cells stay in the JVM; cells with quotes, brackets, legal forms behind a comma or
unusual space are scanned in Python, over Arrow batches.

Defined results: null and blank cells give no value; empty pieces are dropped and not
counted; an opening quote or bracket without its end is an ordinary character; repeated
rows come out once. Very long cells are scanned once, left to right.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from docketlake.session import checkpoint, table

# Separators documented per field, and characters tried besides.
SEPARATORS = {
    "source": (",", ";", "/", "|", "+", "、", "\t", "\n", " and "),
    "comments": (";", "|", "//", "•", "\n"),
}
CANDIDATES = (",", ";", "/", "//", "|", "+", "、", "\t", "\n", " and ", "&", "•", ":", "=")
# Legal forms of companies; only those that end a company's name here are used.
LEGAL_FORMS = ("AB", "AG", "AS", "BV", "Co", "Corp", "GmbH", "Inc", "KG", "KK", "LLC", "LLP", "Ltd", "NV", "Oy", "Oyj", "Plc", "Pty", "SA", "SAS", "SE", "SpA", "SRL")
QUOTES = {'"': '"', "“": "”", "«": "»"}
LEAST_SCORE = 0.2
DEVIATIONS = 3.0  # how sure the regularity of a candidate must be, in standard deviations
UNUSUAL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"  # other space and controls


@dataclass(frozen=True)
class Rules:
    separators: tuple[str, ...]
    legal_forms: tuple[str, ...] = ()


@lru_cache(64)
def _scanner(rules: Rules) -> tuple[re.Pattern, re.Pattern | None]:
    alts = sorted((r"\r\n|\r|\n" if s == "\n" else re.escape(s) for s in rules.separators), key=len, reverse=True)
    stop = re.compile("|".join([*alts, r"\("]) if alts else r"\(")
    legal = None
    if rules.legal_forms:
        forms = sorted({r"\.?".join(map(re.escape, f)) + r"\.?" for f in rules.legal_forms}, key=len, reverse=True)
        one = "|".join(forms)
        ahead = "|".join([r"\s*$", r"\s*[(\[\"”»]", *(rf"\s*(?:{a})" if a.strip("\\") != " and " else a for a in alts)])
        legal = re.compile(rf"\s*(?:{one})(?:,?\s*(?:{one}))?(?={ahead})", re.I)
    return stop, legal


def _closing(cell: str, start: int) -> int:
    """Index behind the quote that closes the one at start; -1 if none does."""
    close = QUOTES[cell[start]]
    at = start + 1
    while (at := cell.find(close, at)) >= 0:
        if close == '"' and cell.startswith('""', at):
            at += 2
            continue
        return at + 1
    return -1


def _bracket_end(cell: str, start: int) -> int:
    depth = 0
    for m in re.compile(r"[()]").finditer(cell, start):
        depth += 1 if m[0] == "(" else -1
        if depth == 0:
            return m.end()
    return -1


def _clean(piece: str) -> str:
    piece = piece.strip()
    if piece[:1] in QUOTES and len(piece) > 1 and _closing(piece, 0) == len(piece):
        quote = piece[0]
        piece = piece[1:-1]
        if quote == '"':
            piece = piece.replace('""', '"')
        piece = piece.strip()
    return piece


def split_cell(cell: str | None, rules: Rules) -> list[str]:
    """The values of one cell in order."""
    if not cell or not cell.strip():
        return []
    stop, legal = _scanner(rules)
    out, start, at, opening, last_bracket = [], 0, 0, True, -1
    n = len(cell)
    while at < n:
        if opening:
            while at < n and cell[at].isspace() and not stop.match(cell, at):
                at += 1
            opening = False
            if at < n and cell[at] in QUOTES and (end := _closing(cell, at)) > 0:
                at = end
                continue
        m = stop.search(cell, at)
        if not m:
            break
        if m[0] == "(":
            end = _bracket_end(cell, m.start()) if m.start() > last_bracket else -1
            if end < 0:
                last_bracket = n  # no bracket further on can close either
            at = end if end > 0 else m.end()
            continue
        if m[0] == "," and legal and (form := legal.match(cell, m.end())) and cell[start : m.start()].strip():
            at = form.end()
            continue
        out.append(cell[start : m.start()])
        start = at = m.end()
        opening = True
    out.append(cell[start:])
    return [p for p in map(_clean, out) if p]


def _legal_pattern(legal: tuple[str, ...]) -> str:
    """A legal form behind a comma, for the JVM."""
    return r"(?i),\s*(?:" + "|".join(r"\.?".join(f) for f in sorted(legal, key=len, reverse=True)) + r")\.?(?![\p{L}\p{N}])"


def _masked(cell: Column, legal: tuple[str, ...]) -> Column:
    """A cell whose quoted and bracketed parts and legal forms hide no delimiter."""
    out = F.regexp_replace(cell, r'"(?:[^"]|"")*"|“[^”]*”|«[^»]*»', "Q")
    for _ in range(2):
        out = F.regexp_replace(out, r"\([^()]*\)", "B")
    return F.regexp_replace(out, _legal_pattern(legal), "") if legal else out


def shape(piece: Column) -> Column:
    """What kind of value it is: ids and numbers masked, letters lowered, signs and spaces dropped."""
    s = F.regexp_replace(piece, r"\b[A-Za-z]\d-?\d{7}\b", "I")
    return F.regexp_replace(F.regexp_replace(F.lower(s), r"\d+(?:\.\d+)*", "9"), r"(?U)\W+", "")


def delimiter_scores(cells: DataFrame, legal: tuple[str, ...] = ()) -> DataFrame:
    """(source, field, delim, n, hits, cells, consistency, score) over the different cells of (source, field, cell)."""
    c = cells.select("source", "field", "cell").where("trim(cell) <> ''").distinct()
    # each step is made once a cell: explode keeps the optimizer from writing an expression into all its uses
    made = lambda d, name, value: d.select("*", F.explode(F.array(value)).alias(name))
    c = made(c, "m", F.regexp_replace(_masked(F.col("cell"), legal), "\r\n?", "\n")).drop("cell")
    here = F.filter(F.array(*map(F.lit, CANDIDATES)), lambda d: F.col("m").contains(d))
    c = made(c, "h", here)
    c = made(c, "here", F.when(F.array_contains("h", "//"), F.array_remove("h", "/")).otherwise(F.col("h"))).where("size(here) < 2")
    c = made(c, "delim", F.coalesce(F.try_element_at("here", F.lit(1)), F.lit("")))
    # a piece that is cut off empty is none
    pieces = F.when(F.col("delim") == "", F.array("m")).otherwise(F.split("m", F.concat(F.lit("\\Q"), "delim", F.lit("\\E"))))
    c = made(c, "shapes", F.filter(F.transform(pieces, shape), lambda p: p != ""))
    c = c.where((F.col("delim") == "") | (F.size("shapes") > 1)).select("source", "field", "delim", F.size("shapes").alias("pieces"), F.explode("shapes").alias("shape"))
    seen = c.groupBy("source", "field", "delim", "pieces", "shape").agg(F.count("*").alias("n"))
    whole = seen.where("delim = ''").select("field", "shape", F.lit(True).alias("known")).distinct()
    # a shape comes once for each source at most, however many cells have it
    by_count = seen.where("delim <> ''").join(whole, ["field", "shape"], "left").groupBy("source", "field", "delim", "pieces")
    by_count = by_count.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("hits"))
    of_cells = F.col("n") / F.col("pieces")
    scores = by_count.groupBy("source", "field", "delim").agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum(of_cells).alias("cells"), (F.sum(of_cells * of_cells) / (F.sum(of_cells) * F.sum(of_cells))).alias("consistency")
    )
    z2, share = DEVIATIONS**2, F.col("hits") / F.col("n")
    low = (share + z2 / (2 * F.col("n")) - DEVIATIONS * F.sqrt(share * (1 - share) / F.col("n") + z2 / (4 * F.col("n") * F.col("n")))) / (1 + z2 / F.col("n"))
    return scores.withColumn("score", low * (1 + F.col("consistency")) / 2)


def inferred_delimiters(cells: DataFrame, known: dict[str, tuple[str, ...]], legal: tuple[str, ...] = ()) -> DataFrame:
    """(source, field, extra array<string>): what is inferred beyond the known delimiters of a field, for the sources where something is."""
    scores = delimiter_scores(cells, legal).where(F.col("score") >= LEAST_SCORE)
    for field, delims in known.items():
        scores = scores.where(~((F.col("field") == field) & F.col("delim").isin(*delims)))
    return scores.groupBy("source", "field").agg(F.sort_array(F.collect_set("delim")).alias("extra"))  # at most len(CANDIDATES)


def legal_forms(companies: DataFrame, name: str = "name") -> tuple[str, ...]:
    """Those of LEGAL_FORMS that end a name, without full stops."""
    end = F.rtrim(F.col(name))
    last = F.upper(F.regexp_replace(F.substring_index(F.regexp_replace(end, r"(?U)\s", " "), " ", -1), r"\.", ""))
    before = F.upper(F.regexp_replace(F.regexp_extract(F.substring_index(end, ",", -2), r"(\S+),\s*\S+$", 1), r"\.", ""))
    ends = companies.select(F.explode(F.array(last, before)).alias("e")).where(F.col("e").isin([f.upper() for f in LEGAL_FORMS])).distinct()
    found = {r.e for r in ends.collect()}  # at most len(LEGAL_FORMS) rows
    return tuple(f for f in LEGAL_FORMS if f.upper() in found)


@F.pandas_udf(ArrayType(StringType()))
def _scanned(cells: pd.Series, rules: pd.DataFrame) -> pd.Series:
    found = zip(cells, rules["separators"], rules["legal_forms"], strict=True)
    return pd.Series([None if c is None else split_cell(c, Rules(tuple(s), tuple(f))) for c, s, f in found], dtype=object)


_scanned = _scanned.asNondeterministic()  # else a filter that explode implies splits every cell twice


def split_values(cell: Column, rules: Rules, extra: Column | None = None) -> Column:
    """array<string> of a cell's values; a cell with separators of its own (extra) or that is not plain goes to Python."""
    alts = [r"\r\n|\r|\n" if s == "\n" else rf"\Q{s}\E" for s in sorted(rules.separators, key=len, reverse=True)]
    odd = cell.rlike(r'["“«(]') | cell.rlike(UNUSUAL)
    if rules.legal_forms:
        odd = odd | cell.rlike(_legal_pattern(rules.legal_forms))
    every = F.array(*map(F.lit, rules.separators))
    if extra is not None:
        odd, every = odd | extra.isNotNull(), F.concat(every, F.coalesce(extra, F.array().cast("array<string>")))
    legal = F.array(*map(F.lit, rules.legal_forms)).cast("array<string>")
    plain = F.filter(F.transform(F.split(cell, "|".join(alts)), lambda v: F.btrim(v, F.lit(" \t\r\n"))), lambda v: v != "")
    scanned = _scanned(F.when(odd, cell), F.struct(every.alias("separators"), legal.alias("legal_forms")))
    return F.when(odd, scanned).otherwise(plain)


FIELDS = ("source", "comments")


def agenda_cells(spark, sf_dir: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(row_id, source, field, cell) of every cell that is not blank; source: the file it came from."""
    a = table(spark, sf_dir, "agenda").select("row_id", "metadata_source", *(F.col(f).alias(f"cell_{f}") for f in fields)).dropDuplicates(["row_id"])
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"cell_{f}").alias("cell")) for f in fields))
    return a.select("row_id", F.coalesce("metadata_source", F.lit("")).alias("source"), F.explode(cells).alias("c")).select("row_id", "source", "c.field", "c.cell").where("trim(cell) <> ''")


def agenda_values(spark, sf_dir: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(row_id, field, pos, value, values) of every cell; values: how many the cell holds."""
    legal = legal_forms(table(spark, sf_dir, "companies"))
    rows = agenda_cells(spark, sf_dir, fields)
    extra = checkpoint(inferred_delimiters(rows, {f: SEPARATORS[f] for f in fields}, legal))
    own = None
    if not extra.isEmpty():  # a row per source and field at most
        rows, own = rows.join(extra, ["source", "field"], "left"), F.col("extra")
    out = None
    for f in fields:
        rules = Rules(SEPARATORS[f], legal if "," in SEPARATORS[f] else ())
        part = rows.where(F.col("field") == f).withColumn("v", split_values(F.col("cell"), rules, own))
        part = part.select("row_id", "field", F.size("v").alias("values"), F.posexplode("v").alias("pos", "value"))
        out = part if out is None else out.unionByName(part)
    return out.select("row_id", "field", "pos", "value", "values")


def p2_found(spark, sf_dir: str) -> DataFrame:
    return agenda_values(spark, sf_dir).where("values > 1").select("row_id", "field", "pos", "value")


def p2_delimiters(spark, sf_dir: str) -> DataFrame:
    """Scores of every candidate delimiter, per source and field."""
    scores = delimiter_scores(agenda_cells(spark, sf_dir), legal_forms(table(spark, sf_dir, "companies")))
    return scores.select("source", "field", "delim", "n", "hits", F.round("cells").cast("bigint").alias("cells"), F.round("consistency", 6).alias("consistency"), F.round("score", 6).alias("score"))
