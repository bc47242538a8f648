"""Office parsing, routing, links, cache, sinks, and fetching from a scripted local server."""

import io
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from office_files import W, archive, docx, pptx, xlsx
from pyspark.sql import functions as F

from docketlake.sources import cache, fetch, links, office, routing, sinks


def read(name, data):
    return [(r.get("state"), r.get("locator"), r.get("text"), r.get("change_state")) for r in office.read_file(name, data)]


def test_docx_tables_and_tracked_changes():
    body = (
        "<w:p><w:r><w:t>kept </w:t></w:r><w:del><w:r><w:delText>lost</w:delText></w:r></w:del><w:ins><w:r><w:t>new</w:t></w:r></w:ins></w:p>"
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"
    )
    rows = list(office.read_file("d.docx", docx(["plain"], body)))
    assert [(r["locator"], r["text"], r["change_state"]) for r in rows] == [
        ("table-row:1", "a|b | ", "current"), ("paragraph:1", "plain", "current"), ("paragraph:2", "kept new", "inserted"),
        ("paragraph:2/deleted", "lost", "deleted"), ("paragraph:3", "a|b", "current"),
    ]
    assert rows[0]["cells"] == ["a|b", ""]
    assert W in zipfile.ZipFile(io.BytesIO(docx([]))).read("word/document.xml").decode()


def test_xlsx_cells_by_reference_and_slides_in_order():
    (row,) = office.read_file("x.xlsx", xlsx([["a", None, "c"]]))
    assert row["cells"] == ["a", "", "c"]
    assert [r["text"] for r in office.read_file("p.pptx", pptx([f"s{i}" for i in range(1, 12)]))] == [f"s{i}" for i in range(1, 12)]


def test_html_csv_text():
    page = "<table><tr><th>TDoc<td> S2-1 </tr><tr><td>x | y</table>out".encode("utf-16")
    assert [r["cells"] for r in office.read_file("p.htm", page)] == [["TDoc", "S2-1"], ["x | y"]]
    assert [r["cells"] for r in office.read_file("c.csv", b'a,"b, c"\n,\nd\n')] == [["a", "b, c"], ["d"]]
    assert read("t.txt", b"caf\xe9") == [("parsed", "text:1", "café", "current")]
    assert read("t.md", b"  ") == [("parsed", None, None, None)]


def test_archives_are_safe_and_failures_are_rows():
    z = archive({"../escape.docx": docx(["bad"]), "/abs.txt": "bad", "in/safe.txt": "good", "in/broken.docx": "no zip", "old.doc": "x", "deep.zip": archive({"a.txt": "deep"})})
    got = {(r["inner_file"], r["state"].split(":")[0], r.get("text")) for r in office.read_file("m.zip", z)}
    assert got == {("in/safe.txt", "parsed", "good"), ("in/broken.docx", "parse_error", None), ("old.doc", "unsupported", None), ("a.txt", "parsed", "deep")}
    assert read("m.zip", b"not-a-zip") == [("unsupported", None, None, None)]


def test_index_of_files(spark, tmp_path):
    (tmp_path / "S2-2605845.docx").write_bytes(docx(["1 Scope", "Text for KI#3", "2.1 Next", "end"]))
    (tmp_path / "S2-2605846.docx").write_bytes(b"no zip")
    parsed = office.parse_files(office.read_files(spark, str(tmp_path)))
    index = office.document_index(parsed, F.regexp_extract("path", "(S2-[0-9]+)", 1), F.col("path")).orderBy("ordinal").collect()
    assert [(r.text, r.section, r.identifiers.key_issues) for r in index] == [("1 Scope", "1 Scope", []), ("Text for KI#3", "1 Scope", ["3"]), ("2.1 Next", "2.1 Next", []), ("end", "2.1 Next", [])]
    assert parsed.where("state like 'parse_error%'").count() == 1


HOSTS = ("docs.example.org",)


def test_routing(spark):
    df = spark.createDataFrame([("https://docs.example.org/ftp/a/b.zip",), ("http://other.example/x",), ("file:///x",), ("/local",), ("https://m.example/root/a",), (None,)], "s string")
    assert [r.k for r in df.select(routing.source_kind(F.col("s"), HOSTS, "https://m.example/root").alias("k")).collect()] == ["public", "remote", "file_uri", "local", "private_mirror", "local"]
    got = routing.candidates(df.limit(2), "s", HOSTS, "https://m.example/root", F.lit(True)).orderBy("s", "rank").collect()
    assert [(r.rank, r.effective) for r in got if r.s.startswith("https://docs")] == [(0, "https://docs.example.org/ftp/a/b.zip"), (1, "https://m.example/root/ftp/a/b.zip"), (2, "https://m.example/root/a/b.zip")]
    paths = spark.createDataFrame([("a%20b\\c+d",), ("../x",), ("a//b",), ("",), ("./a",)], "p string")
    assert [r.p for r in paths.select(routing.safe_relative(F.col("p")).alias("p")).collect()] == ["a b/c+d", None, None, None, None]
    fails = spark.createDataFrame([(404, False), (403, False), (503, False), (200, False), (None, True), (None, None)], "h int, n boolean")
    assert [r.f for r in fails.select(routing.host_failure(F.col("h"), F.col("n")).alias("f")).collect()] == [False, True, True, False, True, False]


def test_circuit_equals_its_window(spark):
    df = spark.createDataFrame([(k, i, (i * 7 + len(k)) % 5 == 0) for k in ("a", "bb", "ccc") for i in range(9)], "k string, n int, f boolean")
    a = {(r.k, r.n): r.circuit_open for r in routing.circuit(df, ["k"], ["n"], F.col("f")).collect()}
    b = {(k, i): any((j * 7 + len(k)) % 5 == 0 for j in range(i)) for k in ("a", "bb", "ccc") for i in range(9)}
    assert a == b and any(a.values()) and not all(a.values())


def test_redaction_keys_and_local_paths(spark):
    df = spark.createDataFrame([("OSError at //secret/share/x", "private_mirror"), ("plain", "public")], "m string, k string")
    got = [r.r for r in df.select(routing.redact(F.col("m"), F.col("k"), "//secret/share").alias("r")).collect()]
    assert "secret" not in got[0] and got[0].startswith("<private-mirror>") and got[1] == "plain"
    keys = spark.createDataFrame([("HTTP://Ex.org/A?b#c",), ("http://ex.org/A?b",)], "u string").select(routing.cache_key(F.col("u")).alias("k")).collect()
    assert keys[0].k == keys[1].k
    assert routing.file_uri_to_path("file:///a%20b/c") == "/a b/c"
    assert routing.file_uri_to_path("file://srv/share/x", windows=True) == "\\\\srv\\share\\x"
    assert routing.file_uri_to_path("file:///C:/x", windows=True) == "C:\\x"
    assert routing.join_mirror("/mnt/m/", "a%20b/c") == "/mnt/m/a b/c"
    for bad in ("../x", "", "a/../b"):
        with pytest.raises(ValueError):
            routing.join_mirror("/m", bad)


def test_links(spark):
    html = """<a href="b.zip">1</a><A HREF='../c/d.zip?x=1'>2</A><a href=/e.zip#f>3</a><a href="b.zip">again</a><a href="#x">n</a><a href="mailto:a@b">m</a><a href="https://else.example/z">o</a>"""
    df = spark.createDataFrame([("https://docs.example.org/ftp/a/", html), ("https://docs.example.org/", None)], "url string, html string")
    assert [(r.n, r.link) for r in links.page_links(df).orderBy("n").collect()] == [(0, "https://docs.example.org/ftp/a/b.zip"), (1, "https://docs.example.org/ftp/c/d.zip"), (2, "https://docs.example.org/e.zip")]


def test_crawl(spark):
    pages = {"https://d.example/m/": ["a.zip", "Docs/", "Inbox/", "/up/"], "https://d.example/m/Docs/": ["b.zip", "deep/", "../"], "https://d.example/m/Docs/deep/": ["c.zip"]}
    site = spark.createDataFrame([(u, "".join(f'<a href="{x}">' for x in ls)) for u, ls in pages.items()], "url string, html string")
    got = links.crawl(lambda level: site.join(level, "url", "left_semi"), spark.createDataFrame([("https://d.example/m/",)], "url string"))
    assert sorted((r.link[20:], r.depth) for r in got.where("kind = 'file'").collect()) == [("Docs/b.zip", 1), ("Docs/deep/c.zip", 2), ("a.zip", 0)]
    short = links.crawl(lambda level: site.join(level, "url", "left_semi"), spark.createDataFrame([("https://d.example/m/",)], "url string"), most=1)
    assert sorted((r.link[20:], r.kind) for r in short.collect()) == [("Docs/", "not_visited"), ("a.zip", "file")]


def test_cache_and_reports(spark, tmp_path):
    files = spark.createDataFrame([("p1", b"x"), ("p2", b"x"), ("p3", b"y")], "path string, content binary")
    keyed = cache.keyed(files)
    assert keyed.select("sha256").distinct().count() == 2
    assert [r.path for r in cache.unparsed(keyed, keyed.where("path <> 'p3'")).collect()] == ["p3"]
    info = cache.cache_info(spark.createDataFrame([("k", 3), ("k", 4), ("l", 5)], "cache_key string, length long")).first()
    assert (info.entries, info.files, info.bytes) == (2, 3, 12)
    (tmp_path / "c").mkdir()
    with pytest.raises(ValueError):
        cache.cache_clear(str(tmp_path / "c"))
    assert cache.cache_clear(str(tmp_path / "c"), confirm=True) and not (tmp_path / "c").exists()
    assert sinks.write_report(files.select("path"), str(tmp_path / "r" / "f.json")) == 3
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in sinks.read_rows(spark, str(tmp_path / "l.jsonl"), "a int").collect()) == [1, 2]
    assert sinks.read_rows(spark, str(tmp_path / "none"), "a int").count() == 0


class Script(BaseHTTPRequestHandler):
    body, statuses, log, cut = archive({"a.txt": "x" * 3000}), [], [], False

    def do_GET(self):
        type(self).log.append(dict(self.headers))
        status = self.statuses.pop(0) if self.statuses else 200
        if status == 200 and self.headers.get("If-None-Match") == "e1":
            status = 304
        if status != 200:
            self.send_response(status)
            self.end_headers()
            return
        start = int(self.headers["Range"][6:-1]) if "Range" in self.headers and self.headers.get("If-Range") == "e1" else 0
        data = self.body[start:]
        self.send_response(206 if start else 200)
        self.send_header("ETag", "e1")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        if type(self).cut:
            type(self).cut = False
            data = data[: len(data) // 2]
        self.wfile.write(data)

    def log_message(self, *a):
        pass


@pytest.fixture
def server():
    Script.statuses, Script.log, Script.cut = [], [], False
    s = ThreadingHTTPServer(("127.0.0.1", 0), Script)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/a.zip"
    s.shutdown()


def test_fetch_retries_resumes_and_revalidates(server, tmp_path):
    Script.statuses, waits = [429], []
    Script.cut = True
    got = fetch.fetch(server, str(tmp_path), sleep=waits.append)
    assert got.state == "resumed_complete" and got.pressure and got.retry_count == 2 and len(waits) == 2
    assert got.resumed_bytes > 0 and got.body_bytes == len(Script.body)
    again = fetch.fetch(server, str(tmp_path))
    assert again.state == "cached" and again.body_bytes == 0 and again.sha256 == got.sha256
    Script.statuses = [503] * 9
    stale = fetch.fetch(server, str(tmp_path), retries=1, sleep=waits.append)
    assert stale.state == "cached" and stale.error == "HTTP 503"
    Script.statuses = [404]
    missing = fetch.fetch(server + "x", str(tmp_path), sleep=waits.append)
    assert missing.state == "fetch_error" and missing.retry_count == 0 and not missing.pressure


def test_fetch_log_is_a_table(spark, server, tmp_path):
    tasks = spark.createDataFrame([(server,), (server,), (None,)], "source string")
    (row,) = fetch.fetch_all(tasks, str(tmp_path), 2, fetch.Route(wait=0)).collect()
    assert row.state == "downloaded" and row.sha256 and json.dumps(row.asDict())
