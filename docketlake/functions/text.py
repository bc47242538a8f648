"""Scalar text functions over columns; all inside the JVM.

Folding: lower case with sharp s as ss, white space including the separators U+001C to
U+001F collapsed. That equals full case folding but for ligatures and the final sigma.
Null in, null out unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]+"
# Words that a topic word also stands for.
TOPIC_ALIASES = {
    "ai": ("artificial intelligence", "machine learning", "inference", "training", "agent"),
    "ml": ("machine learning", "artificial intelligence"),
}
# Names a column may have in an agenda table, without signs.
HEADERS = {
    "tdoc": ("td", "tdoc", "tdocno", "tdocnumber", "document", "documentno"),
    "title": ("title", "subject"),
    "source": ("source", "company", "companies"),
    "status": ("status", "result", "conclusion", "treatment"),
    "agenda": ("agenda", "agendaitem", "ai"),
    "comments": ("comments", "comment"),
    "discussion": ("emaildiscussion", "discussion"),
}
# Suffixes and name parts of files that may list documents.
METADATA_SUFFIXES = ("xlsx", "csv", "docx", "htm", "html", "zip")
METADATA_WORDS = ("agenda", "status", "report", "list", "tdoc", "index")
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTHS = {**{m: i for i, m in enumerate(_MONTHS, 1)}, **{m[:3]: i for i, m in enumerate(_MONTHS, 1)}, "sept": 9}


def fold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def text_hash(text: Column) -> Column:
    return F.sha2(collapse(fold(text)), 256)


def words(text: Column) -> Column:
    """Folded words (with a decimal part) and Han runs; single letters are left out, single digits stay."""
    every = F.regexp_extract_all(fold(text), F.lit(r"[a-z0-9]+(?:\.[0-9]+)?|[\x{4e00}-\x{9fff}]+"), F.lit(0))
    return F.filter(every, lambda w: (F.length(w) > 1) | w.rlike(r"^[0-9]$"))


def query_terms(text: Column) -> Column:
    """Different words of a query, then the words their aliases stand for."""
    base = words(text)
    more = [F.when(F.array_contains(base, k), F.array(*(F.lit(w) for v in vs for w in v.split()))).otherwise(F.array().cast("array<string>")) for k, vs in TOPIC_ALIASES.items()]
    return F.array_distinct(F.concat(base, *more))


def safe_name(text: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("item"))


def source_path(source: Column) -> Column:
    """The unquoted path of an http, https or file address, anything else as it is; a plus sign stays."""
    path = F.coalesce(F.regexp_extract(source, r"(?i)^[a-z]+://[^/?#]*([^?#;]*)", 1), F.lit(""))
    plain = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.when(source.rlike(r"(?i)^(https?|file)://"), F.coalesce(plain, path)).otherwise(source)


def tdoc_from_name(source: Column) -> Column:
    from docketlake.functions.ids import TDOC, found, normalize_tdoc

    hit = found(source_path(source), TDOC)
    return F.when(hit != "", normalize_tdoc(hit))


def canonical_header(cell: Column) -> Column:
    key = F.regexp_replace(fold(cell), "[^a-z0-9]", "")
    out = F.lit(None).cast("string")
    for name, spellings in reversed(HEADERS.items()):
        out = F.when(key.isin(*spellings), F.lit(name)).otherwise(out)
    return out


def role_hints(title: Column, comments: Column, status: Column) -> Column:
    """baseline if title or comments say so, approved if the status holds the word."""
    said = F.lower(F.concat_ws(" ", title, comments))
    return F.array_compact(
        F.array(
            F.when(said.contains("baseline"), F.lit("baseline")),
            F.when(F.coalesce(status, F.lit("")).rlike(r"(?iU)\bapproved\b"), F.lit("approved")),
        )
    )


def excerpt(text: Column, pattern: str, reach: int = 100) -> Column:
    """The first match with ``reach`` characters on either side, white space collapsed; null without a match."""
    at = F.regexp_instr(text, F.lit(pattern))
    size = F.length(F.regexp_substr(text, F.lit(pattern)))
    start = F.greatest(F.lit(1), at - reach)
    return F.when(at > 0, collapse(F.substr(text, start, at + size + reach - start)))


def metadata_priority(source: Column) -> Column:
    """0 the agenda page, 1 reports, 2 indexes, 4 older copies, 3 the rest."""
    name = F.replace(fold(source_path(source)), F.lit("\\"), F.lit("/"))
    return (
        F.when(name.rlike(r"/tdocsbyagenda\.html?$"), 0)
        .when(name.contains("/report/") & ~name.contains("/_older/"), 1)
        .when(F.regexp_extract(name, r"([^/]*)$", 1).contains("index"), 2)
        .when(name.contains("/_older/"), 4)
        .otherwise(3)
    )


def likely_metadata(source: Column) -> Column:
    name = fold(source_path(source))
    part = F.lit(False)
    for w in METADATA_WORDS:
        part = part | name.contains(w)
    return name.rlike(rf"\.({'|'.join(METADATA_SUFFIXES)})$") & part


def group_code(group: Column) -> Column:
    """SA5 -> S5, RAN1 -> R1, CT3 -> C3."""
    return F.regexp_replace(group, r"^([SRC])[A-Z]*([0-9]+)$", "$1$2")


def month_hint(text: Column) -> Column:
    """struct(year, month): 2026年5月, 2026-05, May 2026 or 2026 May, the first form that occurs."""
    # The four ways in which a month is written, tried in this order.
    names = "|".join(sorted(MONTHS, key=len, reverse=True))
    number = F.create_map(*(x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))))
    forms = (
        (r"\b(20\d{2})\s*年\s*(1[0-2]|0?[1-9])\s*月", 1, 2, False),
        (r"\b(20\d{2})[-/.](1[0-2]|0?[1-9])\b", 1, 2, False),
        (rf"(?i)\b({names})\.?\s+(20\d{{2}})\b", 2, 1, True),
        (rf"(?i)\b(20\d{{2}})\s+({names})\b", 1, 2, True),
    )
    out = []
    for pattern, y, m, named in forms:
        year, month = F.regexp_extract(text, pattern, y), F.regexp_extract(text, pattern, m)
        value = number[F.lower(month)] if named else F.try_to_number(month, F.lit("99")).cast("int")
        out.append(F.when(year != "", F.struct(year.cast("int").alias("year"), value.alias("month"))))
    return F.coalesce(*out)


def meeting_descriptor(hint: Column) -> Column:
    """struct(wg, tsg, number, suffix, year, month) of a meeting named in words; what is not said is null.

    Month names are taken out before the suffix is read, so ``SA5#167 May 2026`` has none.
    """
    text = collapse(F.replace(hint, F.lit("_"), F.lit("-")))
    # The matching language of groups and meetings.
    group = r"(?iU)\b(SA|RAN|CT)\s*[-_ ]?\s*([1-6])\b"
    tsg = F.nullif(F.upper(F.regexp_extract(text, group, 1)), F.lit(""))
    names = "|".join(sorted(MONTHS, key=len, reverse=True))
    bare = F.regexp_replace(text, rf"(?i)\b(?:{names})\.?\s+20\d{{2}}\b|\b20\d{{2}}\s+(?:{names})\b|\b20\d{{2}}[-/.]\d{{1,2}}\b", "")
    meeting = group + r"\s*(?:#|meeting\s*#?|会议\s*#?)?\s*(\d{2,3})(?!\d)(?:[-_ ]?([A-Za-z][A-Za-z0-9-]*))?"
    when = month_hint(text)
    return F.struct(
        F.concat(tsg, F.regexp_extract(text, group, 2)).alias("wg"),
        tsg.alias("tsg"),
        F.nullif(F.regexp_extract(bare, meeting, 3), F.lit("")).alias("number"),
        F.nullif(F.lower(F.trim(F.regexp_extract(bare, meeting, 4), F.lit("-"))), F.lit("")).alias("suffix"),
        when["year"].alias("year"),
        when["month"].alias("month"),
    )
