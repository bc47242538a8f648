"""Office files from rows of a table, the counterpart of the readers: what is written here is read back row for row."""

from __future__ import annotations

import csv
import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006/main"
ROWS_A_FILE = 500
_NOT_XML = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


def _xml(text: str) -> str:
    return escape(_NOT_XML.sub(" ", text), {"\r": "&#13;"})


def archive(members: dict[str, bytes | str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _run(text: str, tag: str = "t") -> str:
    return f'<w:r><w:{tag} xml:space="preserve">{_xml(text)}</w:{tag}></w:r>'


def write_docx(rows: list[list[str]]) -> bytes:
    """First cell as a paragraph, second as an inserted, third as a deleted one, all of them as a table row."""
    body = []
    for cells in rows:
        kept, new, gone = [*cells, "", "", ""][:3]
        body.append(f"<w:p>{_run(kept)}</w:p>")
        body.append(f"<w:p><w:ins>{_run(new)}</w:ins><w:del>{_run(gone, 'delText')}</w:del></w:p>")
    table = "".join("<w:tr>" + "".join(f"<w:tc><w:p>{_run(c)}</w:p></w:tc>" for c in cells) + "</w:tr>" for cells in rows)
    return archive({"word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body>{"".join(body)}<w:tbl>{table}</w:tbl></w:body></w:document>'})


def write_pptx(rows: list[list[str]]) -> bytes:
    return archive({f"ppt/slides/slide{n}.xml": f'<p xmlns:a="{DRAWING}">{"".join(f"<a:t>{_xml(c)}</a:t>" for c in cells)}</p>' for n, cells in enumerate(rows, 1)})


def _letters(column: int) -> str:
    return (_letters(column // 26 - 1) if column >= 26 else "") + chr(65 + column % 26)


def write_xlsx(rows: list[list[str]]) -> bytes:
    """Odd columns as shared strings, even ones inline."""
    shared: dict[str, int] = {}
    out = []
    for r, cells in enumerate(rows, 1):
        row = []
        for c, v in enumerate(cells):
            if v and c % 2:
                row.append(f'<c r="{_letters(c)}{r}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>')
            elif v:
                row.append(f'<c r="{_letters(c)}{r}" t="inlineStr"><is><t>{_xml(v)}</t></is></c>')
        out.append(f'<row r="{r}">{"".join(row)}</row>')
    strings = "".join(f"<si><t>{_xml(s)}</t></si>" for s in shared)
    return archive({"xl/worksheets/sheet1.xml": f'<worksheet xmlns="{SHEET}"><sheetData>{"".join(out)}</sheetData></worksheet>', "xl/sharedStrings.xml": f'<sst xmlns="{SHEET}">{strings}</sst>'})


def write_csv(rows: list[list[str]]) -> bytes:
    out = io.StringIO()
    csv.writer(out).writerows(rows)
    return out.getvalue().encode("utf-8-sig")


def write_html(rows: list[list[str]]) -> bytes:
    body = "".join("<tr>" + "".join(f"<td>{html.escape(c)}</td>" for c in cells) + "</tr>\n" for cells in rows)
    return f"<!doctype html><html><head><meta charset=utf-8></head><body><table>{body}</table></body></html>".encode()


def write_text(rows: list[list[str]]) -> bytes:
    return "\n".join(" | ".join(cells) for cells in rows).encode("utf-16")


WRITERS: dict[str, Callable[[list[list[str]]], bytes]] = {"docx": write_docx, "pptx": write_pptx, "xlsx": write_xlsx, "csv": write_csv, "html": write_html, "txt": write_text}


def written_files(rows: DataFrame, kind: str, row_id: str, cells: list[str], zipped: bool = False) -> DataFrame:
    """(path, content): a file of each ROWS_A_FILE ids, its rows in the order of their id; null cells are empty."""
    write = WRITERS[kind]
    r = rows.select(F.col(row_id).cast("bigint").alias("_id"), F.array(*(F.coalesce(F.col(c), F.lit("")) for c in cells)).alias("_cells"))
    files = r.groupBy(F.floor(F.col("_id") / ROWS_A_FILE).alias("_file")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_id", "_cells"))), lambda x: x["_cells"]).alias("_rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths, contents = [], []
            for n, body in zip(pdf["_file"], pdf["_rows"], strict=True):
                data = write([list(c) for c in body])
                if zipped:
                    data = archive({f"in/part{n}.{kind}": data, "in/deep.zip": archive({f"copy{n}.{kind}": data}), "../out.txt": b"never read"})
                paths.append(f"file{n}.{'zip' if zipped else kind}")
                contents.append(data)
            yield pd.DataFrame({"path": paths, "content": contents})

    return files.mapInPandas(run, "path string, content binary")
