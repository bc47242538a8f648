"""The remote path over a loopback server: pages, files, a failing host with its mirror, pressure, calendar pages."""

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from office_files import archive, docx, xlsx

from docketlake.operators.scope import Query
from docketlake.plans import api
from docketlake.sources import fetch, office

ROWS = [["Document", "Subject", "Company", "Result"], ["R3-2411870", "lantern relay", "Orvane Telecom", "Open"], ["R3-2412044", "harbour lights", "Bexholm Labs", "Open"]]
CALENDAR = "<table><tr><td>R3-131-bis</td><td>Malmo</td><td>2024‑04‑15</td><td>2024‑04‑19</td></tr><tr><td>R3 AHG 7</td><td>R3-7</td><td>2024-04-02</td></tr><tr><td>R2-131</td><td>2024-04-15</td></tr><tr><td>no date R3-5</td></tr></table>"
SITE = {
    "/m/": b'<a href="Agenda/">a</a><a href="Docs/?C=N&amp;O=D">d</a><a href="Inbox/">i</a>',
    "/m/Agenda/": b'<a href="agenda.xlsx">x</a>',
    "/m/Docs/": b'<a href="R3-2411870.zip">1</a><a href="R3-2412044.zip">2</a>',
    "/m/Agenda/agenda.xlsx": xlsx(ROWS),
    "/m/Docs/R3-2411870.zip": archive({"R3-2411870.docx": docx(["The lantern relay."])}),
    "/m/Docs/R3-2412044.zip": archive({"R3-2412044.docx": docx(["Harbour lights."])}),
    "/cal/R3.htm": CALENDAR.encode(),
    "/list/": b'<a href="TSGR3_131-bis/">m</a><a href="/else/">n</a>',
}


class Site(BaseHTTPRequestHandler):
    failing, asked = {}, []

    def do_GET(self):
        type(self).asked.append((self.path, self.headers.get("If-None-Match"), self.headers.get("User-Agent"), self.headers.get("Referer")))
        body, left = SITE.get(self.path), self.failing.get(self.path, 0)
        status = 503 if left else 404 if body is None else 304 if self.headers.get("If-None-Match") == self.path else 200
        if left:
            self.failing[self.path] = left - 1
        self.send_response(status)
        if status == 200:
            self.send_header("ETag", self.path)
            self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        if status == 200:
            self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture
def site():
    Site.failing, Site.asked = {}, []
    s = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def options(tmp_path, **route):
    return api.Options(str(tmp_path / "work"), fetch.Route(wait=0, **route), max_concurrency=2)


def test_a_meeting_behind_an_address(spark, site, tmp_path):
    Site.failing["/m/Docs/R3-2411870.zip"] = 1
    run = api.collect(spark, [f"{site}/m/"], Query("lantern"), options=options(tmp_path, referer="http://here.example/"))
    (doc,) = run.tables["documents"].collect()
    assert (doc.tdoc, doc.state, doc.transfer_state, doc.retry_count) == ("R3-2411870", "processed", "downloaded", 1) and doc.body_bytes == len(SITE["/m/Docs/R3-2411870.zip"])
    assert [r.text for r in run.tables["document_index"].collect()] == ["The lantern relay."]
    paths = [a[0] for a in Site.asked]
    assert "/m/Docs/R3-2412044.zip" not in paths and "/m/Inbox/" not in paths
    assert all(a[2] == "docketlake/1" and a[3] == "http://here.example/" for a in Site.asked)
    Site.asked.clear()
    again = api.collect(spark, [f"{site}/m/"], Query("lantern"), options=options(tmp_path)).tables["documents"].first()
    assert (again.transfer_state, again.cache_state, again.fetched_bytes) == ("cached", "hit", 0) and all(a[1] for a in Site.asked)


def test_a_failed_host_is_left_for_its_mirror(site, tmp_path):
    mirror = tmp_path / "mirror" / "m" / "Docs"
    mirror.mkdir(parents=True)
    for n in ("R3-2411870", "R3-2412044"):
        (mirror / f"{n}.zip").write_bytes(SITE[f"/m/Docs/{n}.zip"])
    Site.failing = {f"/m/Docs/{n}.zip": 9 for n in ("R3-2411870", "R3-2412044")}
    router = fetch.Router(fetch.Route(("127.0.0.1",), str(tmp_path / "mirror"), retries=0, wait=0))
    one, two = (fetch.routed(f"{site}/m/Docs/{n}.zip", str(tmp_path / "work"), router) for n in ("R3-2411870", "R3-2412044"))
    assert (one.state, one.fallback_reason, two.state, two.fallback_reason) == ("local", "HTTP 503", "local", "circuit_open")
    assert [a[0] for a in Site.asked] == ["/m/Docs/R3-2411870.zip"]
    gone = fetch.routed(f"{site}/m/none.zip", str(tmp_path / "work"), fetch.Router(fetch.Route(retries=0)))
    assert gone.state == "fetch_error" and gone.http_status == 404


def test_width_follows_pressure(spark, site, tmp_path):
    for n in range(40):
        SITE[f"/w/{n:02}.bin"] = b"x"
    Site.failing = {"/w/03.bin": 1, "/w/30.bin": 1}
    log = fetch.fetch_adaptive(spark.createDataFrame([(f"{site}/w/{n:02}.bin",) for n in range(40)], "source string"), str(tmp_path / "w"), fetch.Route(wait=0), most=2)
    widths = {int(r.source[-6:-4]): r.width for r in log.collect()}
    assert len(widths) == 40 and {w for n, w in widths.items() if n < 16} == {2} and {w for n, w in widths.items() if 16 <= n < 24} == {1} and {w for n, w in widths.items() if 24 <= n} == {2}


def test_one_writer_a_payload(tmp_path):
    with fetch.locked(str(tmp_path)):
        fetch.LOCK_WAIT, kept = 0.0, fetch.LOCK_WAIT
        try:
            with pytest.raises(TimeoutError), fetch.locked(str(tmp_path)):
                pass
        finally:
            fetch.LOCK_WAIT = kept
    with fetch.locked(str(tmp_path)):
        pass


def test_calendar_and_directories_from_pages(spark, site, tmp_path):
    calendar = api.read_calendar(spark, {"RAN3": f"{site}/cal/R3.htm"}, options(tmp_path))
    got = sorted((r.wg, r.meeting_no, r.suffix, str(r.start_date), str(r.end_date), r.meeting_kind) for r in calendar.collect())
    assert got == [("R3", "131", "bis", "2024-04-15", "2024-04-19", "working_group"), ("R3", "7", None, "2024-04-02", "None", "subgroup")]
    directories = api.read_directories(spark, {"RAN3": f"{site}/list/"}, options(tmp_path))
    (row,) = api.resolve(spark, ["RAN3 April 2024"], calendar, directories).collect()
    assert (row.status, row.selected_url) == ("resolved", f"{site}/list/TSGR3_131-bis/")


def test_members_that_are_not_read_say_so():
    deep = {"a.txt": "x"}
    for n in range(5):
        deep = {f"d{n}.zip": archive(deep)}
    (row,) = office.read_file("x.zip", archive(deep))
    assert row["state"] == "too_deep"
    kept, office.MOST_MEMBER_BYTES = office.MOST_MEMBER_BYTES, 10
    try:
        assert [r["state"] for r in office.read_file("x.zip", archive({"a.txt": "y" * 50, "b.txt": "z"}))] == ["too_large", "parsed"]
    finally:
        office.MOST_MEMBER_BYTES = kept
