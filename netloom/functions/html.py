"""HTML expressions: tags, attributes and entities by regular expression.

These stay JVM-side and read one page per row without a shuffle.  Anything
that needs the element tree lives in :mod:`netloom.operators.blocks`.
"""

from __future__ import annotations

import zlib
from html.entities import html5 as NAMED

from pyspark.sql import Column
from pyspark.sql import functions as F

NOISE = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
_VALUE = r"(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"
A_HREF = rf"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*{_VALUE}"
BASE_HREF = rf"(?is)<base\s(?:[^>]*?\s)?href\s*=\s*{_VALUE}"

# Named character references come whole from Python's table of the HTML standard:
# names end with ";", and some old ones are also known without it.
_BARE = sorted((n for n in NAMED if not n.endswith(";")), key=len, reverse=True)
_BARE_NAME = f"^(?:{'|'.join(_BARE)})"
_BARE_IN_ATTRIBUTE = _BARE_NAME + "(?![A-Za-z0-9=])"
_SLOTS = 4096


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % _SLOTS


def _named_table() -> str:
    """The table as text: slot after slot, a slot as ``<name>value<name>value``."""
    slots = [""] * _SLOTS
    for name, value in NAMED.items():
        slots[_slot(name)] += f"\x02{name}\x03{value}"
    return "\x01".join(slots)


_TABLE = _named_table()
# What stands for the references 128 to 159: the characters that these bytes are in windows-1252.
_OLD_BYTES = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_noise(html) -> Column:
    """Page text without comments, scripts and styles."""
    return F.regexp_replace(_col(html), F.lit(NOISE), F.lit(""))


def _named(name: Column) -> Column:
    """Characters of one name, as written after ``&``; NULL when unknown.

    The table is one constant array; a name is looked up in its slot only.
    """
    slots = F.split(F.lit(_TABLE), "\x01")  # folded to a constant
    slot = F.element_at(slots, (F.crc32(name.cast("binary")) % _SLOTS + 1).cast("int"))
    mark = F.concat(F.lit("\x02"), name, F.lit("\x03"))
    at = F.instr(slot, mark)
    return F.when((name != "") & (at > 0),
                  F.substring_index(F.substring(slot, at + F.length(mark), F.length(slot)), "\x02", 1))


def _numbered(reference: Column) -> Column:
    """Character of ``#123`` or ``#x7b``; U+FFFD where there is none."""
    hexed = F.ltrim(F.regexp_extract(reference, "^#[xX]([0-9a-fA-F]+)", 1), F.lit("0"))
    digits = F.ltrim(F.regexp_extract(reference, "^#([0-9]+)", 1), F.lit("0"))
    code = (F.when(hexed != "", F.when(F.length(hexed) <= 6, F.conv(hexed, 16, 10).cast("int")))
            .when(digits != "", F.when(F.length(digits) <= 7, digits.try_cast("int"))))
    known = ~(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF))
    return (F.when(code.between(128, 159), F.substring(F.lit(_OLD_BYTES), code - 127, F.lit(1)))
            .when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
            .otherwise(F.lit("\ufffd")))


def _reference(part: Column, bare: str) -> Column:
    """What follows an ampersand, its reference decoded or the ampersand put back."""
    rest = lambda taken: F.substring(part, F.length(taken) + 1, F.length(part))
    number = F.regexp_extract(part, "^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", 0)
    names = F.array(F.regexp_extract(part, "^[A-Za-z][A-Za-z0-9]*;", 0), F.regexp_extract(part, bare, 0))
    known = F.filter(F.transform(names, lambda n: F.concat(_named(n), rest(n))), lambda x: x.isNotNull())
    return (F.when(part.startswith("amp;"), F.concat(F.lit("&"), F.substring(part, F.lit(5), F.length(part))))
            .when(part.startswith("#") & (number != ""), F.concat(_numbered(number), rest(number)))
            .otherwise(F.coalesce(F.get(known, 0), F.concat(F.lit("&"), part))))


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also inside other lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def unescape(text, attribute: bool = False) -> Column:
    """All character references decoded as browsers do, each once.

    Named ones by their longest known name, old ones also without the semicolon
    (in an attribute only if no letter, digit or ``=`` follows), numbers in either
    base.  Texts without an ampersand are passed on as they are.
    """
    bare = _BARE_IN_ATTRIBUTE if attribute else _BARE_NAME

    def decoded(value: Column) -> Column:
        parts = F.split(value, "&")
        return F.when(value.contains("&"), F.concat(F.get(parts, 0), F.array_join(F.transform(
            F.slice(parts, F.lit(2), F.size(parts)), lambda p: _reference(p, bare)), ""))).otherwise(value)

    return once(_col(text), decoded)


def unquote(value) -> Column:
    return F.regexp_replace(_col(value), r"^[\"']|[\"']$", "")


def attribute(tag, name: str) -> Column:
    """Value of an attribute of one start tag; NULL when absent."""
    return unescape(raw_attribute(tag, name), attribute=True)


def raw_attribute(tag, name: str) -> Column:
    """Value of an attribute as written, for those compared with plain words or decoded later."""
    raw = F.regexp_extract(_col(tag), rf"(?is)[\s\"'/]{name}\s*=\s*{_VALUE}", 1)
    return unquote(F.when(raw != "", raw))


def tags(html, name: str) -> Column:
    """All start tags of one element, as written."""
    return F.regexp_extract_all(_col(html), F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))


def strip_tags(html) -> Column:
    return F.regexp_replace(_col(html), r"(?s)<[^>]*>", "")


def squash(text) -> Column:
    """Runs of white space become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))
