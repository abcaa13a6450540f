"""Strict JSON extraction from free-text responses.

A response is tried as a whole, then as the first ```json fenced object,
then as the span from the first '{' to the last '}'. Each candidate must be
exactly one JSON value: ``try_parse_json`` alone accepts trailing text
(``{"a":1} bye``), so the candidate is parsed inside a two-element array
with a sentinel and accepted only if the array has exactly two elements.

Known differences from Python's parser (documented, not emulated): duplicate
keys and ``NaN``/``Infinity`` literals are refused here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelscope.functions.fixed_values import BRACE_PATTERN, FENCE_PATTERN, PY_WHITESPACE_CLASS


def _for_spark(pattern: str) -> str:
    """A pattern with Python semantics for Java regex and RE2: ``\\s`` is
    Python white space and ``.`` also matches new lines."""
    return "(?s)" + pattern.replace(r"\s", PY_WHITESPACE_CLASS)


FENCE_RE = _for_spark(FENCE_PATTERN)
BRACE_RE = _for_spark(BRACE_PATTERN)
_SENTINEL = '"__end_of_text__"'
_JSON_OBJECT_START = r"^[ \t\n\r]*\{"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_json(c: Column | str) -> Column:
    """VARIANT of the text if the whole text is one JSON value, else NULL."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), _col(c), F.lit("," + _SENTINEL + "]")))
    # The second element must be the sentinel itself: in `{..}, 1] tail` it is 1.
    single = ((F.try_variant_get(wrapped, "$[1]", "string") == F.lit(_SENTINEL.strip('"')))
              & F.try_variant_get(wrapped, "$[2]", "variant").isNull())
    return F.when(single, F.try_variant_get(wrapped, "$[0]", "variant"))


def is_json_object_text(c: Column | str) -> Column:
    """The (already valid) JSON text denotes an object."""
    return F.regexp_like(_col(c), F.lit(_JSON_OBJECT_START))
