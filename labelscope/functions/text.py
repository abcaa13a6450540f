"""Text and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelscope.functions.fixed_values import PY_WHITESPACE_CHARS, PY_WHITESPACE_CLASS

_WS = PY_WHITESPACE_CLASS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """Remove leading and trailing white space the way ``str.strip()`` does.

    Plain ``trim`` removes spaces only; ``trim`` with a character set removes
    any of the Python white-space characters from both ends, natively (no
    regular expression).
    """
    return F.trim(_col(c), F.lit(PY_WHITESPACE_CHARS))


def py_split_first(c: Column | str) -> Column:
    """First token of ``str.split()`` (split on any white-space run)."""
    return F.element_at(F.split(F.regexp_replace(_col(c), f"^{_WS}+", ""), f"{_WS}+"), 1)


def path_parts(c: Column | str) -> Column:
    """Path components, empty ones (leading '/', doubled '/') removed."""
    return F.filter(F.split(_col(c), "/"), lambda p: p != "")


def basename(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), r"([^/]*)$", 1)


def parent_dir(c: Column | str) -> Column:
    """Name of the immediate parent directory ('' at the root)."""
    return F.regexp_extract(_col(c), r"([^/]*)/[^/]*$", 1)


def bind(expr: Column, fn) -> Column:
    """``fn(x)`` with ``x`` bound once to ``expr``.

    When ``fn`` refers to its argument several times, every reference would
    otherwise carry a copy of ``expr`` (and Catalyst substitutes those copies
    again when it pushes a filter down), so generated code grows with each
    layer. A lambda variable is evaluated once.
    """
    return F.element_at(F.transform(F.array(expr), fn), 1)


def stem(c: Column | str) -> Column:
    """File name without its last suffix (``Path.stem``): one regular
    expression, so the name is referenced once."""
    return F.regexp_extract(basename(c), r"^(.+?)(\.[^.]+)?$", 1)


def extension(c: Column | str) -> Column:
    """Last suffix with its dot (``Path.suffix``), '' when there is none."""
    return F.regexp_extract(basename(c), r"^.+(\.[^.]+)$", 1)


def ends_with_any(c: Column | str, suffixes) -> Column:
    """``str.endswith(tuple)`` as one anchored regular expression."""
    alts = "|".join("".join("\\" + ch if not ch.isalnum() else ch for ch in sfx)
                    for sfx in suffixes)
    return F.regexp_like(_col(c), F.lit(f"({alts})\\z"))


def decode_source_bytes(c: Column | str) -> Column:
    """Bytes -> text: UTF-8, invalid bytes dropped, newlines normalised.

    Mirrors a text-mode read with ``errors='ignore'``: invalid sequences are
    removed and ``\\r\\n`` / ``\\r`` become ``\\n``. Valid input is passed
    through unchanged (a genuine U+FFFD is only removed when the same file
    also holds invalid bytes).
    """
    s = _col(c).cast("string")
    cleaned = F.when(F.is_valid_utf8(s), s).otherwise(
        F.regexp_replace(F.make_valid_utf8(s), "�", ""))
    return F.regexp_replace(cleaned, r"\r\n?", "\n")
