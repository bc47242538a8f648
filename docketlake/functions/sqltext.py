"""SQL text for the checks in another engine: the character rules as expressions."""

from __future__ import annotations

from docketlake.functions.charforms import skeleton_map


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def mapped_sql(col: str, chars: dict[int, str]) -> str:
    src, dst, gone = [], [], []
    for cp, to in chars.items():
        if not to:
            gone.append(chr(cp))
        elif len(to) == 1:
            src.append(chr(cp))
            dst.append(to)
    out = f"translate({col}, {_quoted(''.join(src) + ''.join(gone))}, {_quoted(''.join(dst))})"
    for cp, to in chars.items():
        if len(to) > 1:
            out = f"replace({out}, {_quoted(chr(cp))}, {_quoted(to)})"
    return out


def tdoc_sql(col: str) -> str:
    """canonical_tdoc as SQL."""
    flat = f"upper({mapped_sql(col, {k: v for k, v in skeleton_map().items() if v == '' or (v.isascii() and (v.isalnum() or v in '- '))})})"
    raw = f"regexp_extract({flat}, '(^|[^A-Z0-9])([A-Z][0-9]-?[0-9]{{7}})([^0-9A-Z]|$)', 2)"
    return f"nullif(regexp_replace({raw}, '^([A-Z][0-9])([0-9]{{7}})$', '\\1-\\2'), '')"
