"""The golden meeting: agenda with a baseline, a revision, an input and a wrong merge; one body per document."""

import pytest
from office_files import archive, docx, xlsx

from docketlake.operators.scope import Query, QueryError
from docketlake.plans import api

AGENDA = [
    ["Document", "Subject", "Company", "Result", "AI", "Comment"],
    ["R3-2411870", "KI#7 Solution Variant#7.3 lantern relay baseline", "Orvane Telecom", "Open", "4.2", "Baseline incl. R3-2412044 and R3-2411988; revised in the evening to R3-2412190"],
    ["R3-2411988", "Billing of guest devices", "Quill & Tarn Ltd.", "Open", "4.2", "merged into R3-2411870 - wrong agenda assignment"],
    ["R3-2412044", "KI#7 figures for the lantern relay", "Bexholm Labs", "merge into R3-2412190", "4.2", None],
    ["R3-2412190", "KI#7 Solution Variant#7.3 lantern relay, second text", "Orvane Telecom, Bexholm Labs", "Approved", "4.2", "revision of R3-2411870"],
]
QUERY = Query("KI#7 Solution Variant#7.3 lantern relay")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("meeting")
    (root / "Agenda").mkdir()
    (root / "Docs").mkdir()
    (root / "Agenda" / "agenda.xlsx").write_bytes(xlsx(AGENDA))
    for number, *_ in AGENDA[1:]:
        text = f"The lantern relay of {number} is proposed." + (" Comments on R3-2413333." if number == "R3-2412044" else "")
        (root / "Docs" / f"{number}.zip").write_bytes(archive({f"{number}.docx": docx([text, "Thanks to all who wrote."])}))
    (root / "Docs" / "R3-2413333.zip").write_bytes(b"not-a-zip")
    return str(root)


@pytest.fixture(scope="module")
def core(spark, folder):
    return api.collect(spark, [folder], QUERY)


@pytest.fixture(scope="module")
def complete(spark, folder):
    return api.collect(spark, [folder], QUERY, stage="complete")


def edges(result):
    return {(r.src, r.dst, r.type, r.classification) for r in result.tables["relationships"].collect()}


def test_agenda_edges_and_invalidation(core):
    assert edges(core) >= {
        ("R3-2412044", "R3-2411870", "input_to", "candidate"),
        ("R3-2412044", "R3-2412190", "merged_into", "candidate"),
        ("R3-2412190", "R3-2411870", "revision_of", "candidate"),
        ("R3-2411988", "R3-2411870", "merged_into", "invalidated"),
        ("R3-2411988", "R3-2411870", "input_to", "invalidated"),
    }


def test_wrong_merge_is_not_scoped(core):
    got = {r.tdoc for r in core.tables["candidates"].collect()}
    assert got == {"R3-2411870", "R3-2412190", "R3-2412044"}


def test_core_and_complete(core, complete):
    processed = lambda r: {x.tdoc for x in r.tables["document_index"].collect()}
    assert processed(core) == {"R3-2411870", "R3-2412190"}
    assert processed(complete) == {"R3-2411870", "R3-2412190", "R3-2412044"}
    assert core.signature == complete.signature


def test_body_edge_is_followed_and_bad_archive_reported(complete):
    assert ("R3-2412044", "R3-2413333", "responds_to", "candidate") in edges(complete)
    row = complete.tables["coverage"].collect()[0]
    assert row.unsupported_files == 1 and row.completeness == "partial"


def test_duplicates_keep_all_rows(complete):
    same = [r.duplicate_of for r in complete.tables["evidence"].where("text = 'Thanks to all who wrote.'").orderBy("priority", "tdoc").collect()]
    assert same == [None, "R3-2411870:R3-2411870.docx:paragraph:2", "R3-2411870:R3-2411870.docx:paragraph:2"]


def test_diffs(complete):
    got = {(r.src, r.dst): [c.operation for c in r.changes] for r in complete.tables["diffs"].collect()}
    assert got[("R3-2412190", "R3-2411870")] == ["replace"]


def test_preview_of_missing_folder_is_blocked(spark, tmp_path):
    got = api.preview(spark, [str(tmp_path / "none")], QUERY)
    assert got.blocked and got.exit_code == 2


def test_explicit_numbers(spark, folder):
    got = api.preview(spark, [folder], Query(tdocs=("R3-2411870", "r32419999")))
    basis = {r.tdoc: (r.scope_basis, r.metadata_missing) for r in got.tables["candidates"].collect()}
    assert basis["R3-2411870"] == ("explicit_tdoc", False)
    assert basis["R3-2419999"] == ("explicit_tdoc", True)
    with pytest.raises(QueryError):
        Query(tdocs=("no number",))


def test_cache_parses_once(spark, folder, tmp_path):
    first = api.collect(spark, [folder], QUERY, cache_dir=str(tmp_path / "cache"))
    n = spark.read.parquet(str(tmp_path / "cache")).count()
    again = api.collect(spark, [folder], QUERY, cache_dir=str(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache")).count() == n
    assert first.tables["document_index"].count() == again.tables["document_index"].count() == 4


def test_written_tables(core, tmp_path):
    core.write(str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir()} >= {"relationships", "evidence", "document_index", "coverage", "run.json"}


def test_only_files_asked_for_are_opened(spark, folder, tmp_path):
    """The access time of a file that no task needs does not move."""
    import os
    import shutil

    copy = str(tmp_path / "copy")
    shutil.copytree(folder, copy)
    for number in ("R3-2411988", "R3-2413333", "R3-2412044"):
        os.utime(f"{copy}/Docs/{number}.zip", ns=(10**9, 10**9))
    rows = {r.tdoc: (r.state, r.body_bytes) for r in api.collect(spark, [copy], QUERY).tables["documents"].collect()}
    assert set(rows) == {"R3-2411870", "R3-2412190"} and all(s == "local_processed" and n > 100 for s, n in rows.values())
    for number in ("R3-2411988", "R3-2413333", "R3-2412044"):
        at = os.stat(f"{copy}/Docs/{number}.zip")
        assert at.st_atime_ns == at.st_mtime_ns == 10**9  # never read


def test_a_second_run_reads_nothing_and_a_complete_one_only_the_rest(spark, folder, tmp_path):
    state = str(tmp_path / "state")
    counts = lambda r: r.tables["coverage"].first()
    options = api.Options(batch_size=1)
    first = counts(api.collect(spark, [folder], QUERY, state_dir=state, options=options))
    again = counts(api.collect(spark, [folder], QUERY, state_dir=state, options=options))
    more = api.collect(spark, [folder], QUERY, stage="complete", state_dir=state, options=options)
    assert (first.documents_read, again.documents_read, counts(more).documents_read) == (2, 0, 2)
    assert first.total_body_bytes == again.total_body_bytes > 0
    assert {r.tdoc for r in more.tables["document_index"].collect()} == {"R3-2411870", "R3-2412190", "R3-2412044"}
    other = counts(api.collect(spark, [folder], Query("KI#7 figures"), state_dir=state))
    assert other.documents_read > 0


def test_cached_runs_say_so(spark, folder, tmp_path):
    for want in (("miss", "local_processed", 0), ("parsed_hit", "cached_processed", 2)):
        run = api.collect(spark, [folder], QUERY, cache_dir=str(tmp_path / "cache"))
        assert {(r.cache_state, r.state) for r in run.tables["documents"].collect()} == {want[:2]}
        assert run.tables["coverage"].first().parsed_cache_hits == want[2]


def test_preview_counts(spark, folder):
    row = api.preview(spark, [folder], Query("lantern relay", tdocs=("R3-2411870", "R3-2419999"))).tables["counts"].first()
    assert (row.agenda_records, row.candidates, row.current_candidates, row.historical_candidates) == (4, 4, 3, 1)
    assert [w for w in row.warnings if "asked for" in w]
