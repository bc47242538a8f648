"""The command line and its exit codes."""

import datetime as dt
import json

from office_files import archive, docx, xlsx

from docketlake.__main__ import main


def folder(tmp_path):
    root = tmp_path / "m"
    (root / "Docs").mkdir(parents=True)
    (root / "tdoc_list.xlsx").write_bytes(xlsx([["TDoc", "Title", "Source"], ["S2-2605845", "Solution for Example Labs", "Example Labs"], ["S2-2605846", "Other", "Else"]]))
    (root / "Docs" / "S2-2605845.zip").write_bytes(archive({"a.docx": docx(["Text of the solution."])}))
    return str(root)


def test_collect_with_aliases_and_cache(spark, tmp_path, capsys):
    (tmp_path / "a.json").write_text(json.dumps({"Example": ["Example Labs"]}))
    m, out, cache = folder(tmp_path), str(tmp_path / "out"), str(tmp_path / "cache")
    args = ["collect", "--meeting", m, "--company", "Example", "--aliases", str(tmp_path / "a.json"), "--output", out, "--cache-dir", cache]
    assert main(args, spark) == 0
    assert [r.tdoc for r in spark.read.json(f"{out}/documents").collect()] == ["S2-2605845"]
    capsys.readouterr()
    assert main(["cache", "info", "--cache-dir", cache], spark) == 0
    assert json.loads(capsys.readouterr().out)["entries"] == 1
    assert main(["cache", "clear", "--cache-dir", cache], spark) == 2
    assert main(["cache", "clear", "--cache-dir", cache, "--yes"], spark) == 0


def test_blocked_and_wrong_options(spark, tmp_path):
    assert main(["preview", "--meeting", str(tmp_path / "none"), "--output", str(tmp_path / "o")], spark) == 2
    assert main(["preview", "--meeting", folder(tmp_path), "--include-tdoc", "not-a-tdoc", "--output", str(tmp_path / "o")], spark) == 2


def test_resolve(spark, tmp_path, capsys):
    spark.createDataFrame([("C3", "147", None, dt.date(2026, 5, 1), "working_group")], "wg string, meeting_no string, suffix string, start_date date, meeting_kind string").write.parquet(str(tmp_path / "c"))
    spark.createDataFrame([("C3", "TSGC3_147", "u1")], "wg string, name string, url string").write.parquet(str(tmp_path / "d"))
    base = ["resolve", "--calendar", str(tmp_path / "c"), "--directories", str(tmp_path / "d"), "--output", str(tmp_path / "r.json")]
    assert main([*base, "--meeting", "CT3 May 2026"], spark) == 0
    assert json.loads((tmp_path / "r.json").read_text())[0]["selected_url"] == "u1"
    assert main([*base, "--meeting", "CT3#147", "--meeting", "hello"], spark) == 2
