"""Exports, positions, mentions, earlier runs, folder listings, saved members, candidate sources."""

import random

from office_files import archive
from pyspark.sql import functions as F

from docketlake import schemas
from docketlake.operators import relations, scope
from docketlake.sources import fetch, office


def test_exports_keep_their_columns(spark):
    edges = spark.createDataFrame([("A", "B", "input_to", "said", 5)], "src string, dst string, type string, excerpt string, other int")
    got = schemas.conform(edges, "relationships")
    assert got.columns == ["from", "to", "type", "classification", "confidence", "source", "locator", "evidence", "warning"]
    assert got.first().evidence == "said" and got.first().warning is None
    assert schemas.conform(edges.select("src", "dst", "type"), "diffs").first().status == "available"
    for name in schemas.EXPORTS:
        assert schemas.conform(spark.createDataFrame([], "x int"), name).count() == 0


def test_positions_are_a_total_order(spark):
    rng = random.Random(1)
    data = [(rng.randrange(40), i) for i in range(500)]
    got = {(r.a, r.b): r.position for r in scope.positions(spark.createDataFrame(data, "a int, b int"), ["a", "b"]).collect()}
    assert got == {x: i for i, x in enumerate(sorted(data))}
    assert scope.positions(spark.createDataFrame([], "a int"), ["a"]).count() == 0


def test_mentions(spark, monkeypatch):
    register = spark.createDataFrame([(1, "Nokia", ["NSN", " "]), (2, "Groß AG", None), (3, "Nokia", None), (4, None, None)], "company_id bigint, name string, aliases array<string>")
    records = spark.createDataFrame([(1, "x NOKIA y"), (2, "nsn"), (3, "GROSS ag"), (4, None), (5, "none"), (1, "x NOKIA y")], "rid bigint, t string").withColumn("company_id", F.lit("clash"))
    want = [(1, 1), (1, 3), (2, 1), (3, 2)]
    assert sorted(tuple(r) for r in scope.company_mentions(records, "rid", F.col("t"), register).collect()) == want
    monkeypatch.setattr(scope, "MOST_SPELLINGS", 1)
    assert sorted(tuple(r) for r in scope.company_mentions(records, "rid", F.col("t"), register).collect()) == want
    assert scope.company_mentions(records, "rid", F.col("t"), register.where("false")).count() == 0


def test_edges_of_an_earlier_run(spark):
    now = spark.createDataFrame([("A", "B", "input_to", "s", "l", "candidate", "x")], "src string, dst string, type string, source string, locator string, classification string, excerpt string")
    before = spark.createDataFrame([("B", "C", "revision_of", "s", "l", "candidate"), ("C", "D", "merged_into", "s", "l", "invalidated"), ("A", "B", "input_to", "s", "l", "candidate")], "src string, dst string, type string, source string, locator string, classification string")
    got = relations.with_previous(now, before)
    assert sorted((r.src, r.dst, r.excerpt) for r in got.collect()) == [("A", "B", "x"), ("B", "C", None)]
    assert {r.tdoc for r in relations.one_hop(got, spark.createDataFrame([("B",)], "tdoc string")).collect()} == {"A", "B", "C"}


def test_listing_and_saved_members(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    (root / "Sub").mkdir(parents=True)
    (root / "b.zip").write_bytes(archive({"a/x.txt": "1", "b/x.txt": "2", "../no.txt": "3"}))
    (root / "A.txt").write_text("a")
    (root / "Sub" / "c.zip").write_bytes(b"broken")
    assert [(r.name, r.is_folder, r.n) for r in office.directory_index(spark, str(root)).collect()] == [("A.txt", False, 0), ("b.zip", False, 1), ("Sub/", True, 2)]
    files = office.read_files(spark, str(root)).where("path like '%.zip'").withColumn("tdoc", F.lit("S2-2600001"))
    got = sorted(r.inner_file for r in office.save_members(files, str(out)).collect())
    assert got == ["a/x.txt", "b/x.txt"]
    assert (out / "S2-2600001" / "a" / "x.txt").read_text() == "1" and not (tmp_path / "no.txt").exists()


def test_first_candidate_that_succeeds(tmp_path):
    (tmp_path / "f.txt").write_text("hello")
    good = (tmp_path / "f.txt").as_uri()
    got, log = fetch.fetch_first([(tmp_path / "none").as_uri(), good, "http://127.0.0.1:1/never"], str(tmp_path / "c"), retries=0)
    assert got.source == good and got.state == "downloaded" and [x.state for x in log] == ["fetch_error", "downloaded"]
