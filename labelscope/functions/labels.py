"""Label normalisation and origin expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelscope.functions.fixed_values import (
    DEFAULT_SYNONYMS, DEFAULT_TARGETS, NONE_MARKERS, ORIGINS,
)
from labelscope.functions.text import py_strip

# Synonym maps above this size are joined as a table, not inlined (see
# operators.verdicts.normalize_column).
MAX_INLINE_SYNONYMS = 4096


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_label(c: Column | str) -> Column:
    """to text -> strip -> lower; NULL for missing, 'none' and ''."""
    low = F.lower(py_strip(_col(c).cast("string")))
    return F.when(low.isin(*NONE_MARKERS), F.lit(None).cast("string")).otherwise(low)


def synonym_lookup(low: Column, synonyms: Mapping[str, str] | None) -> Column:
    """Map a cleaned label through the synonyms; identity when absent."""
    synonyms = DEFAULT_SYNONYMS if synonyms is None else synonyms
    if not synonyms:
        return low
    m = F.create_map(*[F.lit(x) for kv in sorted(synonyms.items()) for x in kv])
    return F.coalesce(F.try_element_at(m, low), low)


def normalize_label(c: Column | str, synonyms: Mapping[str, str] | None = None,
                    targets: Sequence[str] | None = DEFAULT_TARGETS) -> Column:
    """Canonical target label of a raw detection, or NULL.

    missing -> NULL; to text; strip; lower; 'none'/'' -> NULL; synonym;
    NULL unless the result is a target. ``targets=None`` skips the check.
    """
    mapped = synonym_lookup(clean_label(c), synonyms)
    if targets is None:
        return mapped
    return F.when(mapped.isin(*targets), mapped).otherwise(F.lit(None).cast("string"))


def is_ignored_label(raw: Column | str, norm: Column | str) -> Column:
    """Out-of-scope detection: text, not 'none'/'' (lower-cased, no strip),
    and not normalised to a target."""
    raw = _col(raw)
    return (raw.isNotNull() & ~F.lower(raw).isin(*NONE_MARKERS) & _col(norm).isNull())


def origin_of(filename: Column | str, origins: Iterable[str] = ORIGINS) -> Column:
    """Origin from the '<ORIGIN>-' file-name prefix; NULL when none matches."""
    fn = _col(filename)
    out = None
    for o in origins:
        cond = fn.startswith(f"{o}-")
        out = F.when(cond, F.lit(o)) if out is None else out.when(cond, F.lit(o))
    return out.otherwise(F.lit(None).cast("string"))
