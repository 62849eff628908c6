"""Columns over document bytes and text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_bytes(c: str | Column) -> Column:
    """UTF-8 bytes of a document: a UTF-8 mark goes, UTF-16 of either order becomes UTF-8; bytes that aren't UTF-8 raise an error."""
    b = _c(c)
    head2, head3 = F.hex(F.substring(b, 1, 2)), F.hex(F.substring(b, 1, 3))
    utf16 = lambda order: F.encode(F.decode(F.substring(b, F.lit(3), F.octet_length(b)), order), "UTF-8")
    plain = F.when(head3 == "EFBBBF", F.substring(b, F.lit(4), F.octet_length(b))).otherwise(b)
    checked = F.when(F.is_valid_utf8(plain.cast("string")), plain).otherwise(F.raise_error(F.lit("a document is neither UTF-8 nor marked UTF-16")).cast("binary"))
    return F.when(head2 == "FFFE", utf16("UTF-16LE")).when(head2 == "FEFF", utf16("UTF-16BE")).otherwise(checked)


def content_hash(c: str | Column) -> Column:
    return F.sha2(_c(c), 256)


def version_id(path: str | Column, content: str | Column) -> Column:
    return F.concat_ws(":", _c(path), content_hash(content))


def line_starts(c: str | Column) -> Column:
    """Byte offsets of the lines: 0 and each offset after a line feed that isn't the end of the text."""
    text = _c(c)
    lines = F.split(text, "\n")
    grown = F.aggregate(lines, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + F.octet_length(x).cast("int") + 1))
    return F.filter(F.slice(grown, 1, F.size(lines)), lambda x: (x == 0) | (x < F.octet_length(text)))


def offset_to_line(starts: str | Column, offset: str | Column) -> Column:
    """0-based line of a byte offset: that of the last start that isn't behind it."""
    return F.size(F.filter(_c(starts), lambda x: x <= _c(offset))) - 1


def is_build_output(path: str | Column) -> Column:
    return _c(path).rlike(r"(?i)(^|/)(bin|obj)/")


def is_generated(path: str | Column, content: str | Column) -> Column:
    """By the path's suffix or folder, or by the mark within the first 512 bytes."""
    p = _c(path)
    return p.rlike(r"(?i)\.(g|generated|designer)\.cs$") | p.rlike(r"(?i)(^|/)(obj|generated)/") | F.substring(_c(content), 1, 512).contains("<auto-generated")


def generator_identity(content: str | Column) -> Column:
    """The tool named in a GeneratedCode attribute, else the text after the mark; null without either."""
    c = _c(content)
    tool = F.regexp_extract(c, r'GeneratedCode\("([^"]*)"', 1)
    mark = F.trim(F.regexp_extract(c, r"<auto-generated>([^\n]*)", 1))
    return F.coalesce(F.nullif(tool, F.lit("")), F.nullif(mark, F.lit("")))


def glob_regex(pattern: str) -> str:
    """One ignore pattern as a regular expression over forward-slash paths."""
    p = pattern.removeprefix("!").rstrip()
    anchored = "/" in p.rstrip("/")
    folder = p.endswith("/")
    p = p.strip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("(?i)^" if anchored else "(?i)(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def is_ignored(path: str | Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches a path is one without `!`."""
    out = F.lit(False)
    for p in patterns:
        p = p.strip()
        if p and not p.startswith("#"):
            out = F.when(_c(path).rlike(glob_regex(p)), not p.startswith("!")).otherwise(out)
    return out


def token_estimate(c: str | Column) -> Column:
    """A quarter of the UTF-16 length, rounded down."""
    return F.floor(F.octet_length(F.encode(_c(c), "UTF-16LE")) / 8).cast("int")


def slice_bytes(content: str | Column, start: str | Column, end: str | Column) -> Column:
    """The text between two byte offsets of UTF-8 bytes."""
    return F.decode(F.substring(_c(content), _c(start) + 1, _c(end) - _c(start)), "UTF-8")


def containing_type(symbol_id: str | Column) -> Column:
    """The type id of a member id, by its last dot before the parameters; null for a type."""
    s = _c(symbol_id)
    owner = F.regexp_extract(s, r"^[A-Z]:([^(|]*)\.[^.(|]+(?:\([^|]*\))?\|", 1)
    return F.when(~s.startswith("T:") & (owner != ""), F.concat(F.lit("T:"), owner, F.lit("|"), F.substring_index(s, "|", -1)))


def tokens(c: str | Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(_c(c)), r"[^\p{L}\p{N}]+"), lambda x: x != "")
