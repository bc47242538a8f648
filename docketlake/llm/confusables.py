"""Visually identical text with different characters, brought to one consistent form.

Widths, ligatures, dashes, space-like and invisible characters are resolved by rule.
Then every word with Greek, Cyrillic, Armenian or Cherokee letters is looked at as a whole: each letter has a
set of scripts in which a letter of the same look exists, the word's resolved script set
is their intersection. An empty set marks a mixed-script word, a set with a script other
than the letters' own a whole-script confusable. The word is spelled in the first of
``SCRIPTS`` that is in its set; without any, letter by letter in the Latin
twin where there is one. The result depends only on the look, so words that look the
same become equal. Case, accents, superscripts, subscripts stay.

Defined results: null stays null; empty and blank text become empty; texts of any length
are handled whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docketlake.functions.charforms import ARMENIAN_LATIN, CHEROKEE_LATIN, CYRILLIC_LATIN, GREEK_LATIN, LATIN_OF, form_map
from docketlake.session import checkpoint, table

TWINS = {"Cyrillic": CYRILLIC_LATIN, "Greek": GREEK_LATIN, "Armenian": ARMENIAN_LATIN, "Cherokee": CHEROKEE_LATIN}
SCRIPTS = ("Latin", *TWINS)
_WORD = re.compile("[\\w\u0300-\u036f]+")
_FOREIGN = re.compile("[\u0370-\u03ff\u0400-\u058f\u13a0-\u13ff]")


@lru_cache(None)
def _spellings() -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """Letter -> its look (the Latin twin or itself); script -> look -> letter of that script."""
    by_script: dict[str, dict[str, str]] = {"Latin": {v: v for v in LATIN_OF.values()}, **{s: {} for s in TWINS}}
    for name, twins in TWINS.items():
        for letter, latin in twins.items():
            by_script[name].setdefault(latin, letter)
    return dict(LATIN_OF), by_script


@lru_cache(100_000)
def _own_script(ch: str) -> str | None:
    if not ch.isalpha():
        return None
    name = unicodedata.name(ch, "")
    return next((s for s in SCRIPTS if name.startswith(s.upper())), "other")


def script_sets(word: str) -> list[set[str]]:
    """For each letter of a word, the scripts that have a letter of its look."""
    looks, by_script = _spellings()
    out = []
    for ch in word:
        if (own := _own_script(ch)) is not None:
            look = looks.get(ch, ch)
            out.append({own} | {s for s in SCRIPTS if look in by_script[s]} | ({"Latin"} if look in LATIN_OF.values() else set()))
    return out


def respell(word: str) -> str:
    """The consistent script spelling of one word."""
    looks, by_script = _spellings()
    flat = unicodedata.normalize("NFD", word)
    sets = script_sets(flat)
    common = set.intersection(*sets) if sets else set()
    script = next((s for s in SCRIPTS if s in common), None)
    if script is None or script == "Latin":
        flat = "".join(looks.get(c, c) for c in flat)
    else:
        flat = "".join(by_script[script].get(looks.get(c, c), c) for c in flat)
    return unicodedata.normalize("NFC", flat)


_respelled = lru_cache(200_000)(respell)


@lru_cache(None)
def _mapped() -> re.Pattern:
    """Every character of the basic plane that form_map() changes; the search is several times faster than translate()."""
    return re.compile("[" + "".join(re.escape(chr(c)) for c in form_map() if c < 0x10000) + "]")


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def _one_form(m: re.Match) -> str:
    return form_map().get(ord(m[0]), m[0])


def _resolved(text: str) -> str:
    """Every character as form_map() has it."""
    s = _mapped().sub(_one_form, text)
    return _ASTRAL.sub(_one_form, s) if _ASTRAL.search(s) else s


def consistent_form(text: str | None) -> str | None:
    if text is None:
        return None
    if text.isascii() and text.isprintable():
        return text.strip()
    s = _resolved(text)
    if not s.isascii():
        s = unicodedata.normalize("NFC", s)
        if _FOREIGN.search(s):
            s = _WORD.sub(lambda m: _respelled(m[0]) if _FOREIGN.search(m[0]) else m[0], s)
    return s.strip()


@F.pandas_udf(StringType())
def _form(texts: pd.Series) -> pd.Series:
    return pd.Series([consistent_form(t) for t in texts], dtype=object)


def look(text: Column) -> Column:
    """consistent_form of a column; plain ASCII stays in the JVM."""
    plain = text.rlike(r"\A[\x20-\x7e]*\z")
    return F.when(plain, F.trim(text)).otherwise(_form(F.when(~plain, text)))


def same_look_pairs(rows: DataFrame, rid: str, text: str) -> DataFrame:
    """(id_a, id_b) of records that look the same but differ as stored.

    Rows meet through the distinct stored spellings of a look, so copies of one spelling
    are never paired with each other, however many there are.
    """
    r = rows.select(F.col(rid).alias("id"), F.unhex(F.md5(F.col(text))).alias("s"), F.unhex(F.md5(look(F.col(text)))).alias("k")).where("s is not null")
    r = checkpoint(r.dropDuplicates(["id"]))  # every form is made once
    odd = r.groupBy("k").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi").select("k")
    r = r.join(odd, "k", "left_semi")
    spellings = r.select("k", F.col("s").alias("other")).distinct()
    left = r.join(spellings, "k").where("s <> other").select("k", "other", F.col("id").alias("id_a"))
    right = r.select("k", F.col("s").alias("other"), F.col("id").alias("id_b"))
    return left.join(right, ["k", "other"]).where("id_a < id_b").select("id_a", "id_b")


FIELDS = {"agenda": ("row_id", "tdoc"), "evidence": ("evidence_id", "text")}


def p6_found(spark, sf_dir: str) -> DataFrame:
    out = [same_look_pairs(table(spark, sf_dir, t), rid, col).select(F.lit(t).alias("src_table"), "id_a", "id_b") for t, (rid, col) in FIELDS.items()]
    return out[0].unionByName(out[1])


def p6_forms(spark, sf_dir: str) -> DataFrame:
    """The consistent form of every record."""
    out = [
        table(spark, sf_dir, t).select(F.lit(t).alias("src_table"), F.col(rid).alias("record_id"), look(F.col(col)).alias("form")).dropDuplicates(["record_id"])
        for t, (rid, col) in FIELDS.items()
    ]
    return out[0].unionByName(out[1])


def p6_classes(spark, sf_dir: str) -> DataFrame:
    """(src_table, record_id, class_id, spellings): the records that look the same share the least of their ids; how many spellings the look has."""
    out = None
    for t, (rid, col) in FIELDS.items():
        r = table(spark, sf_dir, t).select(F.col(rid).alias("record_id"), F.unhex(F.md5(F.col(col))).alias("s"), F.unhex(F.md5(look(F.col(col)))).alias("k")).where("s is not null").dropDuplicates(["record_id"])
        r = checkpoint(r)
        looks = r.groupBy("k", "s").agg(F.min("record_id").alias("least")).groupBy("k").agg(F.min("least").alias("class_id"), F.count("*").alias("spellings"))
        part = r.join(looks, "k").select(F.lit(t).alias("src_table"), "record_id", "class_id", "spellings")
        out = part if out is None else out.unionByName(part)
    return out
