"""Office files built in memory for the tests."""

import io
import zipfile
from xml.sax.saxutils import escape

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"


def archive(members: dict[str, bytes | str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def docx(paragraphs: list[str], body: str = "") -> bytes:
    ps = "".join(f"<w:p><w:r><w:t>{escape(p)}</w:t></w:r></w:p>" for p in paragraphs)
    return archive({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{ps}{body}</w:body></w:document>'})


def xlsx(rows: list[list[str | None]]) -> bytes:
    out = []
    for r, row in enumerate(rows, 1):
        cells = "".join(f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for c, v in enumerate(row) if v)
        out.append(f'<row r="{r}">{cells}</row>')
    return archive({"xl/worksheets/sheet1.xml": f'<worksheet xmlns="{S}"><sheetData>{"".join(out)}</sheetData></worksheet>'})


def pptx(slides: list[str]) -> bytes:
    return archive({f"ppt/slides/slide{n}.xml": f'<p xmlns:a="{A}"><a:t>{escape(s)}</a:t></p>' for n, s in enumerate(slides, 1)})
