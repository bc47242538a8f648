"""Characters that look the same, and the canonical form of document numbers.

The tables are the fixed data; everything longer (full-width forms, space-like,
dash and invisible characters) comes from rules over the Unicode categories.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts drawn like a Latin letter.
CYRILLIC_LATIN = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Һ": "h", "Ӏ": "I", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "ү": "y", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
}
GREEK_LATIN = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
}
ARMENIAN_LATIN = {"Լ": "L", "Ս": "U", "Տ": "S", "Օ": "O", "ց": "g", "հ": "h", "յ": "j", "ո": "n", "ս": "u", "օ": "o", "զ": "q"}
CHEROKEE_LATIN = {
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z",
    "Ꮞ": "4", "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
}
# Letters drawn alike that have no twin in another script, small capitals drawn like small letters, and ligatures.
OTHER_TWINS = {"µ": "μ", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
LATIN_OF = {**CYRILLIC_LATIN, **GREEK_LATIN, **ARMENIAN_LATIN, **CHEROKEE_LATIN}
EXTRA_DASHES = "−⁃﹣－"
EXTRA_INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ"
LINE_SPACES = "\t\n\x0b\x0c\r\x85  "


@lru_cache(None)
def form_map() -> dict[int, str]:
    """Code point -> what it becomes before composition; letters of other scripts stay."""
    out: dict[int, str] = {}
    for cp in range(0x80, 0x30000):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat == "Cf" or 0xFE00 <= cp <= 0xFE0F or ch in EXTRA_INVISIBLE:
            out[cp] = ""
        elif cat == "Pd" or ch in EXTRA_DASHES:
            out[cp] = "-"
        elif cat == "Zs":
            out[cp] = " "
        elif unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")):
            out[cp] = unicodedata.normalize("NFKC", ch)
        elif unicodedata.decomposition(ch).startswith("<font>") and (plain := unicodedata.normalize("NFKC", ch)).isascii() and plain.isalnum():
            out[cp] = plain  # letters and digits of mathematical alphabets
    for cp in range(0xE0000, 0xE0080):
        out[cp] = ""
    out.update({ord(c): " " for c in LINE_SPACES})
    out.update({ord(k): v for k, v in OTHER_TWINS.items()})
    # a full-width letter or sign may itself have a twin
    return {k: "".join(out.get(ord(c), c) if len(v) == 1 and ord(c) != k else c for c in v) for k, v in out.items()}


@lru_cache(None)
def skeleton_map() -> dict[int, str]:
    """form_map and, on top, every look-alike letter to its Latin twin."""
    return {**form_map(), **{ord(k): v for k, v in LATIN_OF.items()}}


@lru_cache(None)
def _id_translation() -> tuple[str, str]:
    """Arguments of translate(): what can stand in a document number, in one-to-one form, then what vanishes."""
    src, dst, gone = [], [], []
    for cp, to in skeleton_map().items():
        if to == "":
            gone.append(chr(cp))
        elif len(to) == 1 and (to.isascii() and (to.isalnum() or to in "- ")):
            src.append(chr(cp))
            dst.append(to)
    return "".join(src) + "".join(gone), "".join(dst)


def canonical_tdoc(value: Column) -> Column:
    """The document number in a cell as ``S2-2605845``; null where the cell holds none.

    Look-alike letters, widths, dashes, spaces and invisible characters are resolved,
    letters raised, and one ASCII dash stands after the second character. Runs inside
    the JVM. Null, empty and other text give null.
    """
    src, dst = _id_translation()
    flat = F.upper(F.translate(value, src, dst))
    return F.nullif(
        F.regexp_replace(
            F.regexp_extract(flat, r"(?:^|[^A-Z0-9])([A-Z][0-9]-?[0-9]{7})(?![0-9A-Z])", 1), r"^([A-Z][0-9])([0-9]{7})$", "$1-$2"
        ),
        F.lit(""),
    )
