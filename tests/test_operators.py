"""Core operators on small tables, with nulls, ties, repeated rows, empty tables and extra columns."""

import datetime as dt
import random

from pyspark.sql import functions as F

from docketlake.operators import agenda, diff, graph, ordered, orphans, packed, passages, relations, resolve, scope
from docketlake.operators.scope import Query

T = lambda d: dt.datetime(2026, 1, d)


def brute_orphans(refs, targets):
    out = set()
    for rid, k, at in refs:
        if k is None:
            continue
        own = [(b or dt.datetime.min, e) for key, b, e in targets if key == k]
        if not own:
            out.add((rid, "missing"))
        elif at is not None and not any(b <= at and (e is None or at < e) for b, e in own):
            out.add((rid, "deleted" if any(b <= at for b, _ in own) else "later"))
    return out


def run_orphans(spark, refs, targets):
    r = spark.createDataFrame(refs, "rid bigint, k string, at timestamp").withColumn("b", F.lit(1)).withColumn("ts", F.lit("x"))
    t = spark.createDataFrame(targets, "k string, b timestamp, e timestamp").withColumn("rid", F.lit(7))
    got = orphans.orphan_references(r, t, record_id=F.col("rid"), key=F.col("k"), at=F.col("at"), target_key=F.col("k"), begins=F.col("b"), ends=F.col("e"))
    return [(x.record_id, x.reason) for x in got.collect()]


def test_orphans_by_brute_force(spark):
    rng = random.Random(3)
    day = lambda: rng.choice([None, *map(T, range(1, 9))])
    refs = [(i, rng.choice(["a", "b", "c", "d", None]), day()) for i in range(80)]
    targets = [(rng.choice("abc"), day(), day()) for _ in range(12)]
    got = run_orphans(spark, refs + refs[:10], targets + targets[:3])
    assert len(got) == len(set(got)) and set(got) == brute_orphans(refs, targets)


def test_orphans_of_empty_tables(spark):
    assert run_orphans(spark, [], [("a", T(1), None)]) == []
    assert run_orphans(spark, [(1, "a", T(1))], []) == [(1, "missing")]


def test_inherited_orphans_in_a_cycle(spark, rows):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("b", "c"), ("d", "d"), (None, "a"), ("e", "x")], "child string, parent string")
    got = orphans.inherited_orphans(spark.createDataFrame([("a",), ("a",), (None,)], "node string"), links)
    assert rows(got) == [("a", 0), ("b", 1), ("c", 2)]


RULES = packed.Rules(packed.SEPARATORS["source"], ("BV", "Co", "Ltd", "AB"))


def test_split_cell():
    split = lambda c, r=RULES: packed.split_cell(c, r)
    assert split("A; B/C|D+E、F\tG\r\nH and I") == list("ABCDEFGHI")
    assert split('"A, B", “C; D”, «E/F»') == ["A, B", "C; D", "E/F"]
    assert split('"a ""b"", c"; d') == ['a "b", c', "d"]
    assert split("Foo (x, y), Bar & Baz, B.V., Qux Co., Ltd., AB") == ["Foo (x, y)", "Bar & Baz, B.V.", "Qux Co., Ltd., AB"]
    assert split("ABC, ABle") == ["ABC", "ABle"]
    assert split(" , ; ") == [] and split(None) == [] and split("") == []
    assert split('say "hi, you"') == ['say "hi', 'you"']
    assert split("(open, a") == ["(open", "a"] and split('"open, a') == ['"open', "a"]
    assert split('"", x') == ["x"]
    comments = packed.Rules(packed.SEPARATORS["comments"])
    assert split("a, b/c and d // e • f | g; h\ni", comments) == ["a, b/c and d", "e", "f", "g", "h", "i"]
    long = "(" * 50_000 + ",".join("x" * 50_000)
    assert len(split(long)) == 50_000


def test_delimiters_are_inferred_per_source(spark):
    names = [f"Name{c} Inc" for c in "abcdefghijkl"]
    cells = [("s", n) for n in names * 3] + [("s", f"{a}: {b}") for a in names for b in names[:6]] + [("t", f"{a} x & y{b}") for a in names for b in names] + [("t", f"q{a}: z{b}") for a in names for b in names[:3]]
    df = spark.createDataFrame(cells, "source string, cell string").withColumn("field", F.lit("f"))
    got = {(r.source, r.field): r.extra for r in packed.inferred_delimiters(df, {"f": (",",)}).collect()}
    assert got == {("s", "f"): [":"]}  # in t neither sign has pieces that are values of their own
    assert packed.inferred_delimiters(df, {"f": (",", ":")}).count() == packed.inferred_delimiters(df.where("false"), {"f": (",", "|")}).count() == 0


def test_hot_cell_adds_no_delimiter(spark):
    cells = [("Name1 Inc",), ("x",), ("y",)] + [("odd one | odd two",)] * 500 + [("x = y",)] * 500 + [(f"Name{i} Inc; Name{i + 1} Inc",) for i in range(20)]
    df = spark.createDataFrame(cells, "cell string").withColumn("field", F.lit("f")).withColumn("source", F.lit("s"))
    assert packed.inferred_delimiters(df, {"f": (";", "|")}).count() == 0
    assert {r.delim: r.n for r in packed.delimiter_scores(df).collect()} == {";": 40, "|": 2, "=": 2}


def test_long_cells_count_with_all_their_pieces(spark):
    df = spark.createDataFrame([("; ".join(f"a{i} b" for i in range(60)),)], "cell string").withColumn("field", F.lit("f")).withColumn("source", F.lit("s"))
    assert [(r.delim, r.n, r.cells, r.consistency) for r in packed.delimiter_scores(df).collect()] == [(";", 60, 1.0, 1.0)]


def test_plain_and_scanned_cells_split_alike(spark):
    cells = [" A; B/C|D+E、F\tG\r\nH and I ", "Foo (x, y), Bar & Baz, B.V., Qux Co., Ltd., AB", "a,,b , ", ";", "x  and y; and z", "\u00a0a ; b\u3000", "ABC, ABle", "“a; b”; c", "p\u2003; q"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = {r.i: r.v for r in df.select("i", packed.split_values(F.col("c"), RULES).alias("v")).collect()}
    assert got == {i: packed.split_cell(c, RULES) for i, c in enumerate(cells)}
    own = {r.i: r.v for r in df.select("i", packed.split_values(F.col("c"), RULES, F.when(F.col("i") == 6, F.array(F.lit("B")))).alias("v")).collect()}
    assert own[6] == ["A", "C", "A", "le"] and own[0] == got[0]


def test_p2_counts_repeated_rows_once(spark, tmp_path):
    spark.createDataFrame([(1, "A; B", None, "f"), (1, "A; B", None, "f"), (2, None, "x // y", None), (3, "", " ", "g")], "row_id bigint, source string, comments string, metadata_source string").write.parquet(str(tmp_path / "agenda.parquet"))
    spark.createDataFrame([("A Ltd.",)], "name string").write.parquet(str(tmp_path / "companies.parquet"))
    got = sorted(tuple(r) for r in packed.p2_found(spark, str(tmp_path)).collect())
    assert got == [(1, "source", 0, "A"), (1, "source", 1, "B"), (2, "comments", 0, "x"), (2, "comments", 1, "y")]


def test_agenda_header_carries_and_changes(spark):
    data = [("f", 1, ["note"]), ("f", 2, ["TDoc", "Title", "Title"]), ("f", 3, ["s22605845", "a", "b"]), ("f", 9000, ["Status", "Document"]), ("f", 9001, ["Approved", "S2-2605846"]), ("f", 9002, ["x", None]), ("g", 1, None)]
    got = agenda.agenda_records(spark.createDataFrame(data, "file string, ordinal int, cells array<string>")).orderBy("tdoc").collect()
    assert [(r.tdoc, r.title, r.status, r.role_hints) for r in got] == [("S2-2605845", "b", None, []), ("S2-2605846", None, "Approved", ["approved"])]


def test_first_record_prefers_the_better_source(spark):
    data = [("T", "b/z.xlsx", 1, "z"), ("T", "https://h.example/m/tdocsbyagenda.htm", 5, "page"), ("T", "a/a.xlsx", 1, "a"), ("U", "x", 1, "u"), ("U", "x", 1, "u")]
    got = agenda.first_per_document(spark.createDataFrame(data, "tdoc string, metadata_source string, ordinal int, title string"))
    assert sorted((r.tdoc, r.title) for r in got.collect()) == [("T", "page"), ("U", "u")]


def test_carry_and_neighbours_across_buckets(spark):
    n = 3 * ordered.BUCKET + 5
    marks = {0, ordered.BUCKET - 1, 2 * ordered.BUCKET, n - 1}
    df = spark.range(n).select(F.lit(None).cast("string").alias("f"), F.col("id").alias("o"), F.col("id").isin(*marks).alias("m"))
    near = {r.o for r in ordered.near_marked(df, ["f"], "o", F.col("m"), "near").where("near").collect()}
    assert near == {x for m in marks for x in (m - 1, m, m + 1) if 0 <= x < n}
    last = ordered.carry_last(df, ["f"], "o", F.when(F.col("m"), F.col("o")), "c").groupBy("c").count().collect()
    points = sorted(marks)
    assert {r.c: r["count"] for r in last} == {a: b - a for a, b in zip(points, [*points[1:], n], strict=True)}


def test_body_edges_of_every_kind(spark):
    said = "Merged into S2-2600001. Revision of S22600002; S2-2600003 was revised to this. Input to s2-2600004, reply on S2-2600005. Comments on S2-2600009 and comments on S2-2600006."
    df = spark.createDataFrame([("S2-2600009", said, "p:1", "x"), ("S2-2600009", None, "p:2", "x")], "tdoc string, text string, locator string, source string")
    got = {(r.dst, r.type) for r in relations.body_edges(df).collect()}
    assert got == {("S2-2600001", "merged_into"), ("S2-2600002", "revision_of"), ("S2-2600003", "revision_of"), ("S2-2600004", "input_to"), ("S2-2600005", "responds_to"), ("S2-2600006", "responds_to")}


def test_scores(spark):
    q = Query("KI#18 intent structure", companies=("Nokia",), aliases={"Nokia": ("NSN",)})
    data = [("S2-2600001", "KI#18 intent structure", "Nokia"), ("S2-2600002", "KI#18 intent", "nsn"), ("S2-2600003", "KI#1 intent", "Nokia"), ("S2-2600004", "KI#18 intent", "Other"), ("S2-2600005", "KI#18 other", "Nokia"), (None, None, None)]
    df = spark.createDataFrame(data, "tdoc string, title string, source_company string")
    for c in ("status", "agenda", "comments", "discussion"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    assert [r.s for r in df.select(scope.match_score(q).alias("s")).collect()] == [13, 11, -1, -1, -1, -1]
    assert scope.direct_matches(df, Query()).count() == 6


def test_batches_never_change_the_scope(spark):
    df = spark.createDataFrame([(f"T{i:03}", i % 4) for i in range(50)], "tdoc string, priority int")
    for size in (1, 7, 100):
        got = scope.batches(df, size).collect()
        assert sorted(r.tdoc for r in got) == sorted(r.tdoc for r in df.collect())
        order = sorted(got, key=lambda r: (r.priority, r.tdoc))
        assert [r.batch_no for r in order] == [i // size for i in range(50)]


def test_core_is_part_of_complete(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "tdoc string, priority int")
    assert {r.tdoc for r in scope.stage(df, "core").collect()} == {"a", "b"}
    assert scope.stage(df, "complete").count() == 3
    assert scope.stage(df.where("false"), "core").count() == 0


def test_closure_directions(spark, rows):
    edges = spark.createDataFrame([("a", "b", "candidate"), ("b", "c", "candidate"), ("c", "a", "candidate"), ("b", "d", "invalidated"), ("z", "a", "candidate")], "src string, dst string, classification string")
    files = spark.createDataFrame([(x,) for x in "abcdz"], "tdoc string")
    seeds = files.where("tdoc = 'a'")
    assert rows(graph.closure(seeds, edges, files)) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(graph.closure(seeds, edges, files.where("tdoc <> 'b'"))) == [("a", 0)]
    assert ("z", 1) in rows(graph.closure(seeds, edges, files, "both"))
    assert rows(graph.closure(seeds.where("false"), edges, files)) == []


def test_duplicates(spark):
    data = [(2, "A  b", None), (1, "a B", ""), (3, None, None), (4, None, None), (5, "x", "given")]
    df = spark.createDataFrame(data, "n int, text string, paragraph_hash string")
    got = {r.n: r.duplicate_of for r in passages.mark_duplicates(df, ["n"], F.col("n").cast("string")).collect()}
    assert got == {1: None, 2: "1", 3: None, 4: "3", 5: None}


def test_diff_blocks_rebuild_the_new_version(spark):
    rng = random.Random(5)
    old = [rng.choice("abcdefgh") for _ in range(30)]
    new = [x for x in old if rng.random() > 0.2]
    new.insert(3, "zz")
    data = [(t, "f", i, f"p:{i}", x, "current", x) for t, p in (("N", new), ("O", old)) for i, x in enumerate(p)] + [("O", "f", 99, "p:99", "gone", "deleted", "gone")]
    index = spark.createDataFrame(data, "tdoc string, inner_file string, ordinal int, locator string, paragraph_hash string, change_state string, text string")
    edges = spark.createDataFrame([("N", "O", "revision_of", "candidate")] * 2 + [("N", "N", "revision_of", "candidate"), ("N", "X", "input_to", "candidate")], "src string, dst string, type string, classification string")
    blocks = sorted(diff.paragraph_diffs(edges, index).collect(), key=lambda r: r.block)
    built, at = [], 0
    for b in blocks:
        built += old[at : b.old_from] + new[b.new_from : b.new_to]
        at = b.old_to
    assert built + old[at:] == new
    nested = diff.nested_diffs(diff.paragraph_diffs(edges, index), index).collect()
    assert len(nested) == 1 and [c.operation for c in nested[0].changes] == [b.operation for b in blocks]
    first = nested[0].changes[0]
    assert [x.text for x in first.candidate] == new[blocks[0].new_from : blocks[0].new_to]


def test_resolve_ladder(spark):
    cal = spark.createDataFrame(
        [("C3", "147", None, dt.date(2026, 5, 1), "working_group"), ("C3", "148", "AH", dt.date(2026, 5, 20), "subgroup"), ("S5", "167", None, dt.date(2026, 5, 2), "working_group"), ("S5", "168", None, dt.date(2026, 5, 22), "working_group")],
        "wg string, meeting_no string, suffix string, start_date date, meeting_kind string",
    )
    dirs = spark.createDataFrame([("C3", "TSGC3_147", "u1"), ("C3", "TSGC3_147-bis", "u2"), ("C3", "TSGC3_1147", "u3"), ("S5", "TSGS5_167", "u4")], "wg string, name string, url string")
    hints = ["https://h.example/m/", "file:///m", "CT3#147-bis", "CT3#147", "CT3 May 2026", "SA5 May 2026", "SA5#167 May 2026", "SA5#169 May 2026", "SA5 June 2026", "SA5", "hello", None, "SA5#170"]
    got = {r.hint: (r.status, r.selected_url or r.reason) for r in resolve.resolve_meetings(spark.createDataFrame(list(enumerate(hints)), "hint_id int, hint string"), cal, dirs).collect()}
    assert got == {
        "https://h.example/m/": ("resolved", "https://h.example/m/"),
        "file:///m": ("resolved", "file:///m"),
        "CT3#147-bis": ("resolved", "u2"),
        "CT3#147": ("ambiguous", "several directories"),
        "CT3 May 2026": ("ambiguous", "several directories"),
        "SA5 May 2026": ("ambiguous", "several meetings in that month"),
        "SA5#167 May 2026": ("resolved", "u4"),
        "SA5#169 May 2026": ("ambiguous", "number not in that month"),
        "SA5 June 2026": ("unresolved", "no meeting in that month"),
        "SA5": ("unresolved", "neither number nor month"),
        "hello": ("unresolved", "no group"),
        None: ("unresolved", "no group"),
        "SA5#170": ("unresolved", "no directory"),
    }
