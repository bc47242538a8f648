"""Office files as located text: one row per paragraph, table row, slide, sheet row or whole text.

Files come from the binaryFile source; archives are opened in place. A file that cannot be
read is a row with a state, never a failed job. Parsing is Python over Arrow batches; the
rest of the engine sees a table. Rows carry an ordinal within their file and, for table
rows, their cells as an array, so a bar inside a cell shifts nothing.
"""

from __future__ import annotations

import csv
import hashlib
import io
import os
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from docketlake.functions.ids import identifiers
from docketlake.functions.text import text_hash
from docketlake.operators.agenda import is_heading
from docketlake.operators.ordered import carry_last

SCHEMA = (
    "path string, inner_file string, state string, ordinal int, kind string, locator string, text string, "
    "change_state string, style string, cells array<string>"
)
MOST_MEMBER_BYTES = 512 << 20
MOST_DEPTH = 3
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


class TooLarge(Exception):
    """A member that unpacks to more than MOST_MEMBER_BYTES."""


def decode_text(raw: bytes) -> str:
    """By byte order mark, else UTF-8, else Windows-1252, else with replacements."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    for codec in ("utf-8-sig", "cp1252"):
        try:
            return raw.decode(codec)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def _squeeze(text: str) -> str:
    return " ".join(text.split())


def _part(archive: zipfile.ZipFile, name: str) -> bytes:
    info = archive.getinfo(name)
    if info.file_size > MOST_MEMBER_BYTES:
        raise TooLarge(name)
    return archive.read(info)


def _runs(node, deleted: bool = False, inserted: bool = False) -> Iterator[tuple[str, bool, bool]]:
    """Text pieces of a paragraph with their tracked state; paragraphs inside it speak for themselves."""
    for child in node:
        tag = child.tag
        if tag == f"{_W}p":
            continue
        if tag in (f"{_W}t", f"{_W}delText"):
            yield child.text or "", deleted or tag == f"{_W}delText", inserted
        elif tag in (f"{_W}tab", f"{_W}br", f"{_W}cr"):
            yield " ", deleted, inserted
        else:
            yield from _runs(child, deleted or tag == f"{_W}del", inserted or tag == f"{_W}ins")


def _cells(row) -> list[str]:
    """Cells of a table row as they stand; deleted text is left out."""
    return [_squeeze("".join(t for p in cell.iter(f"{_W}p") for t, gone, _ in [*_runs(p), (" ", False, False)] if not gone)) for cell in row.findall(f"{_W}tc")]


def _paragraph(n: int, p) -> Iterator[dict]:
    style = p.find(f"{_W}pPr/{_W}pStyle")
    pieces = list(_runs(p))
    kept = _squeeze("".join(t for t, gone, _ in pieces if not gone))
    lost = _squeeze("".join(t for t, gone, _ in pieces if gone))
    base = {"kind": "paragraph", "style": style.get(f"{_W}val") if style is not None else None}
    if kept:
        new = any(ins for t, gone, ins in pieces if t and not gone)
        yield {**base, "locator": f"paragraph:{n}", "text": kept, "change_state": "inserted" if new else "current"}
    if lost:
        yield {**base, "locator": f"paragraph:{n}/deleted", "text": lost, "change_state": "deleted"}


def read_docx(data: bytes) -> Iterator[dict]:
    """Table rows, then paragraphs, numbered in the order in which they begin. The body is read as a stream: what is done is let go."""
    rows: dict[int, list[str]] = {}
    paragraphs: dict[int, list[dict]] = {}
    open_rows: list[int] = []
    open_paragraphs: list[int] = []
    begun = {f"{_W}tr": 0, f"{_W}p": 0}
    with zipfile.ZipFile(io.BytesIO(data)) as archive, archive.open("word/document.xml") as body:
        for event, node in ElementTree.iterparse(body, ("start", "end")):
            if node.tag not in begun:
                continue
            opened = open_rows if node.tag == f"{_W}tr" else open_paragraphs
            if event == "start":
                begun[node.tag] += 1
                opened.append(begun[node.tag])
                continue
            n = opened.pop()
            if node.tag == f"{_W}tr":
                rows[n] = _cells(node)
            else:
                paragraphs[n] = list(_paragraph(n, node))
            if not open_rows and not open_paragraphs:
                node.clear()
    for n, cells in sorted(rows.items()):
        if any(cells):
            yield {"kind": "table-row", "locator": f"table-row:{n}", "text": " | ".join(cells), "cells": cells}
    for _, found in sorted(paragraphs.items()):
        yield from found


def _numbered(archive: zipfile.ZipFile, pattern: str) -> list[tuple[int, str]]:
    return sorted((int(m[1]), name) for name in archive.namelist() if (m := re.fullmatch(pattern, name)))


def read_pptx(data: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for n, name in _numbered(archive, r"ppt/slides/slide(\d+)\.xml"):
            text = _squeeze(" ".join(t.text or "" for t in ElementTree.fromstring(_part(archive, name)).iter(f"{_A}t")))
            if text:
                yield {"kind": "slide", "locator": f"slide:{n}", "text": text}


def _column(ref: str) -> int:
    out = 0
    for c in re.match("[A-Z]*", ref)[0]:
        out = out * 26 + ord(c) - 64
    return out - 1


def read_xlsx(data: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in archive.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(_part(archive, "xl/sharedStrings.xml")).iter(f"{_S}si")]
        for sheet, name in _numbered(archive, r"xl/worksheets/sheet(\d+)\.xml"):
            for k, row in enumerate(ElementTree.fromstring(_part(archive, name)).iter(f"{_S}row"), 1):
                cells: list[str] = []
                for c in row.findall(f"{_S}c"):
                    at = _column(c.get("r", ""))
                    at = len(cells) if at < 0 else at
                    cells += [""] * (at + 1 - len(cells))
                    value = c.find(f"{_S}v")
                    if c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    elif value is not None and value.text:
                        cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
                cells = [x.strip() for x in cells]
                if any(cells):
                    yield {"kind": "sheet-row", "locator": f"sheet:{sheet}/row:{row.get('r') or k}", "text": " | ".join(cells), "cells": cells}


def read_csv(data: bytes) -> Iterator[dict]:
    for n, row in enumerate(csv.reader(io.StringIO(decode_text(data))), 1):
        cells = [c.strip() for c in row]
        if any(cells):
            yield {"kind": "csv-row", "locator": f"row:{n}", "text": " | ".join(cells), "cells": cells}


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def _close(self) -> None:
        if self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(_squeeze("".join(self.cell)))
            self.cell = None

    def handle_starttag(self, tag, attrs):
        if tag in ("td", "th", "tr"):
            self._close()
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()


def read_html(data: bytes) -> Iterator[dict]:
    parser = _Tables()
    parser.feed(decode_text(data))
    parser.close()
    parser._close()
    for n, cells in enumerate((r for r in parser.rows if any(r)), 1):
        yield {"kind": "html-row", "locator": f"row:{n}", "text": " | ".join(cells), "cells": cells}


def read_text(data: bytes) -> Iterator[dict]:
    text = decode_text(data)
    if text.strip():
        yield {"kind": "text", "locator": "text:1", "text": text}


READERS = {"docx": read_docx, "pptx": read_pptx, "xlsx": read_xlsx, "csv": read_csv, "htm": read_html, "html": read_html, "txt": read_text, "md": read_text}


def safe_members(archive: zipfile.ZipFile) -> Iterator[tuple[zipfile.ZipInfo, str]]:
    """Members that are files with a relative path that stays inside."""
    for info in archive.infolist():
        name = info.filename.replace("\\", "/")
        if not (info.is_dir() or name.startswith("/") or re.match("[A-Za-z]:", name) or ".." in name.split("/")):
            yield info, name


def read_file(path: str, data: bytes, inner: str | None = None, depth: int = 0) -> Iterator[dict]:
    """Rows of one file, of every member of an archive, or one row that says why there are none."""
    inner = inner or path.rsplit("/", 1)[-1]
    suffix = inner.lower().rsplit(".", 1)[-1]
    base = {"path": path, "inner_file": inner}
    if suffix == "zip" and depth >= MOST_DEPTH:
        yield {**base, "state": "too_deep"}
        return
    if suffix == "zip":
        try:
            archive = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            yield {**base, "state": "unsupported"}
            return
        with archive:
            for info, name in safe_members(archive):
                if info.file_size > MOST_MEMBER_BYTES:
                    yield {"path": path, "inner_file": name, "state": "too_large"}
                    continue
                try:
                    content = archive.read(info)
                except Exception as e:  # an encrypted or broken member is its own row
                    yield {"path": path, "inner_file": name, "state": f"parse_error:{e}"[:200]}
                    continue
                yield from read_file(path, content, name, depth + 1)
        return
    reader = READERS.get(suffix)
    if reader is None:
        yield {**base, "state": "unsupported"}
        return
    try:
        rows = list(reader(data))
    except TooLarge:
        yield {**base, "state": "too_large"}
        return
    except Exception as e:  # per-file state instead of a failed job
        yield {**base, "state": f"parse_error:{e}"[:200]}
        return
    if not rows:
        yield {**base, "state": "parsed"}
    for n, row in enumerate(rows, 1):
        yield {**base, "state": "parsed", "ordinal": n, "change_state": "current", **row}


_COLUMNS = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            yield from _frames(read_file(path, bytes(content or b"")))


def _frames(rows: Iterator[dict], **same) -> Iterator[pd.DataFrame]:
    """Rows in frames of some thousand; ``same`` are columns that all of them share."""
    out: list[dict] = []
    for row in rows:
        out.append(row)
        if len(out) >= 5000:
            yield _frame(out, same)
            out = []
    yield _frame(out, same)


def _frame(rows: list[dict], same: dict) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_COLUMNS).astype(object)
    frame["ordinal"] = frame["ordinal"].astype("Int32")
    frame = frame.where(frame.notna(), None)
    for name, value in same.items():
        frame[name] = pd.Series([value] * len(frame), dtype=object)
    return frame


def opened(path: str) -> bytes:
    """A file's content: a path of this machine, or an address of any file system that pyarrow knows."""
    if re.match("(?i)file:", path):
        path = re.sub("(?i)^file:/+", "/", path)
    if "://" in path:
        from pyarrow import fs

        system, inside = fs.FileSystem.from_uri(path)
        with system.open_input_stream(inside) as f:
            return f.read()
    with open(path, "rb") as f:
        return f.read()


def hashed(paths: DataFrame, place: str = "path") -> DataFrame:
    """paths with sha256 and body_bytes of the file at ``place``; null where it cannot be read."""
    names = [f.name for f in paths.schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for at in pdf[place]:
                try:
                    data = opened(at)
                    found.append((hashlib.sha256(data).hexdigest(), len(data)))
                except OSError:
                    found.append((None, None))
            out = pdf[names].copy()
            out["sha256"] = [f[0] for f in found]
            out["body_bytes"] = pd.array([f[1] for f in found], dtype="Int64")
            yield out

    schema = StructType([*paths.schema.fields, StructField("sha256", StringType()), StructField("body_bytes", LongType())])
    return paths.mapInPandas(run, schema)


def parse_paths(paths: DataFrame, place: str = "path") -> DataFrame:
    """Located text of the files at ``place``, under the name ``path``; each row keeps the other columns of its file.

    A file is opened by the task that parses it: no other file is read, and no content is shuffled.
    """
    kept = [f for f in paths.schema.fields if f.name not in ("path", *_COLUMNS)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file in pdf.to_dict("records"):
                same = {n: None if pd.isna(file[n]) else file[n] for n in names}
                try:
                    rows = read_file(file["path"], opened(file[place]))
                except OSError as e:
                    rows = iter([{"path": file["path"], "inner_file": file["path"].rsplit("/", 1)[-1], "state": f"read_error:{type(e).__name__}"}])
                yield from _frames(rows, **same)

    schema = StructType([*_parse_schema(SCHEMA), *kept])
    return paths.mapInPandas(run, schema)


def _parse_schema(text: str) -> list[StructField]:
    kinds = {"string": StringType(), "int": IntegerType(), "array<string>": ArrayType(StringType())}
    return [StructField(n, kinds[k]) for n, k in (c.strip().split(" ") for c in text.split(","))]


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modificationTime) below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).drop("content")


def directory_index(spark: SparkSession, folder: str) -> DataFrame:
    """(name, is_folder, n): what a folder holds, in caseless order, folders with a slash; n counts from 0."""
    depth = F.lit(folder.rstrip("/") + "/")
    below = F.regexp_replace(F.col("path"), r"^file:/+", "/")
    files = list_files(spark, folder).select(F.when(below.startswith(depth), F.substr(below, F.length(depth) + 1)).alias("rel")).where("rel is not null")
    first = F.substring_index("rel", "/", 1)
    names = files.select(F.concat(first, F.when(F.col("rel").contains("/"), "/").otherwise("")).alias("name")).distinct()
    ranked = names.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), "name"))).alias("all"))  # one folder's entries
    return ranked.select(F.posexplode("all").alias("n", "e")).select("e.name", F.col("e.name").endswith("/").alias("is_folder"), F.col("n").cast("bigint").alias("n"))


def save_members(parsed_sources: DataFrame, out: str) -> DataFrame:
    """(path, inner_file, saved_path): members of archives (path, tdoc, and content or place) written below out/tdoc/ under their full inner path.

    out is a folder that all executors share.
    """
    held_by = "content" if "content" in parsed_sources.columns else "place"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            saved = []
            for path, held, tdoc in zip(pdf["path"], pdf[held_by], pdf["tdoc"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(opened(held) if held_by == "place" else bytes(held or b"")))
                except (zipfile.BadZipFile, OSError):
                    continue
                with archive:
                    for info, name in safe_members(archive):
                        target = os.path.join(out, re.sub(r"[^A-Za-z0-9._-]+", "_", tdoc or "item"), *(p for p in name.split("/") if p not in ("", ".")))
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                        with open(f"{target}.part", "wb") as f:
                            f.write(archive.read(info))
                        os.replace(f"{target}.part", target)
                        saved.append((path, name, target))
            yield pd.DataFrame(saved, columns=["path", "inner_file", "saved_path"])

    return parsed_sources.select("path", held_by, "tdoc").mapInPandas(run, "path string, inner_file string, saved_path string")


def read_files(spark: SparkSession, folder: str, paths: DataFrame | None = None, skip: tuple[str, ...] = ("/inbox/", "/_older/")) -> DataFrame:
    """(path, content) below a folder, only of ``paths`` (path) if given; every content is read, see parse_paths for chosen files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    for s in skip:
        files = files.where(~F.lower("path").contains(s))
    return files if paths is None else files.join(paths.select("path").distinct(), "path", "left_semi")


def parse_files(files: DataFrame) -> DataFrame:
    """Located text of files (path, content)."""
    return files.select("path", "content").mapInPandas(_parse, SCHEMA)


def document_index(parsed: DataFrame, tdoc, source) -> DataFrame:
    """Parsed rows as a paragraph index: section carried on, hash, identifiers."""
    rows = parsed.where("text is not null").select(tdoc.alias("tdoc"), source.alias("source"), "inner_file", "ordinal", "kind", "locator", "text", "change_state", "style")
    head = is_heading(F.col("text"), F.col("style"))
    rows = carry_last(rows, ["tdoc", "source", "inner_file"], "ordinal", F.when(head, F.col("text")), "section")
    return rows.drop("style").withColumn("paragraph_hash", text_hash(F.col("text"))).withColumn("identifiers", identifiers(F.col("text")))
