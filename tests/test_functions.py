"""Scalar functions: ids, text, look-alike characters."""

import hashlib
import re

from pyspark.sql import functions as F

from docketlake.functions import ids, text
from docketlake.functions.charforms import canonical_tdoc


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first().r


def test_canonical_tdoc(spark):
    for written in ("S2-2605845", "s22605845", " Ѕ２－２６０５８４５ ", "S2–26​05845", "S2−2605845", "S­2‑2605845"):
        assert one(spark, written, canonical_tdoc) == "S2-2605845"
    for other in (None, "", "TBD", "n/a", "-", "S2-26058451", "S2-260584"):
        assert one(spark, other, canonical_tdoc) is None


def test_normalize_tdoc(spark):
    assert one(spark, "s2 2605845", ids.normalize_tdoc) == "S2-2605845"
    assert one(spark, " ab–1 ", ids.normalize_tdoc) == "AB-1"
    assert one(spark, None, ids.normalize_tdoc) is None


def test_identifiers(spark):
    got = one(spark, "KI#18, KI 3.1 and Solution Variant#18.7; Solution #4; SV5 s22605845 S2–2605845", ids.identifiers)
    assert got.tdocs == ["S2-2605845"] and got.key_issues == ["18", "3.1"]
    assert got.solution_variants == ["18.7", "5"] and got.solutions == ["4"]
    assert one(spark, None, ids.identifiers).tdocs == []


def test_hash_is_folded_and_collapsed(spark):
    want = hashlib.sha256(re.sub(r"\s+", " ", "  Straße　\x1cA\n B ".casefold()).strip().encode()).hexdigest()
    assert one(spark, "  Straße　\x1cA\n B ", text.text_hash) == want
    assert one(spark, None, text.text_hash) is None


def test_words_and_terms(spark):
    assert one(spark, "KI#18 a 5 intent 18.7 会议", text.words) == ["ki", "18", "5", "intent", "18.7", "会议"]
    assert one(spark, "AI intent", text.query_terms) == ["ai", "intent", "artificial", "intelligence", "machine", "learning", "inference", "training", "agent"]


def test_names_and_paths(spark):
    assert one(spark, "../a b/ç.zip", text.safe_name) == "a_b_.zip"
    assert one(spark, "...", text.safe_name) == "item"
    assert one(spark, "https://x.example/ftp/a%20b+c/S2-2605845.zip?q=1", text.source_path) == "/ftp/a b+c/S2-2605845.zip"
    assert one(spark, "https://x.example/ftp/s22605845.zip", text.tdoc_from_name) == "S2-2605845"
    assert one(spark, "Docs/plain", text.source_path) == "Docs/plain"


def test_headers_and_roles(spark):
    assert [one(spark, h, text.canonical_header) for h in ("T-Doc No.", "Agenda Item", "E-mail Discussion", "Other", None)] == ["tdoc", "agenda", "discussion", None, None]
    df = spark.createDataFrame([("Baseline text", None, "not approved"), (None, None, None)], "t string, c string, s string")
    assert [r.r for r in df.select(text.role_hints(F.col("t"), F.col("c"), F.col("s")).alias("r")).collect()] == [["baseline", "approved"], []]


def test_metadata_sources(spark):
    got = [one(spark, s, text.metadata_priority) for s in ("https://h.example/m/TdocsByAgenda.htm", "https://h.example/m/Report/r.docx", "https://h.example/m/index.html", "https://h.example/_older/a.zip", "a.zip")]
    assert got == [0, 1, 2, 4, 3]
    assert one(spark, "https://h.example/Agenda%20v1.xlsx", text.likely_metadata) is True
    assert one(spark, "https://h.example/agenda.pdf", text.likely_metadata) is False


def test_months_and_meetings(spark):
    for hint in ("2026年5月", "2026-05", "May 2026", "2026 may", "x 2026/5"):
        got = one(spark, hint, text.month_hint)
        assert (got.year, got.month) == (2026, 5), hint
    assert one(spark, "nothing", text.month_hint) is None
    got = one(spark, "SA5#167 May 2026", text.meeting_descriptor)
    assert (got.wg, got.tsg, got.number, got.suffix, got.month) == ("SA5", "SA", "167", None, 5)
    got = one(spark, "ran 1 meeting #99-bis", text.meeting_descriptor)
    assert (got.wg, got.number, got.suffix) == ("RAN1", "99", "bis")
    assert one(spark, "RAN1", text.group_code) == "R1"


def test_excerpt(spark):
    value = "x" * 150 + " TS 23.501 " + "y" * 150
    got = one(spark, value, lambda c: text.excerpt(c, r"TS [0-9.]+", 20))
    assert got == "x" * 19 + " TS 23.501 " + "y" * 19
    assert one(spark, "none", lambda c: text.excerpt(c, "TS")) is None
