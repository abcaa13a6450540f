"""URL filter: host and path rules, then a list of canonical URLs behind a
blocked Bloom filter.

The listed canonical URLs set bits in blocks of 256 bits (four longs); a URL
tests its bits in one block only. What passes goes to an exact hash join with
the list, which removes the false positives. The filter has a fixed greatest
size (``MAX_BLOCKS`` rows), so it can be broadcast whatever the list's size; a
crowded filter lets more URLs through to the join and changes no verdict.

Nulls and texts without ``://`` have empty host and path, no canonical URL and
the verdict allow. Repeated rows are judged alike. An empty list blocks none.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import blocked_bloom, maybe_in, stored

#: (verdict, host, path): a rule fits its host, all subdomains and the paths
#: that start with its path; the longest fitting rule wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"),
         ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Query parameters that don't name a page.
TRACKING = "utm_[^&=]*|ref|fbclid|gclid"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """host/path?query without www., tracking parameters, fragment, a trailing
    .html and slash; null without ``://``."""
    page = F.regexp_replace(F.regexp_replace(path(url), r"\.html?$", ""), "/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.concat(F.lit("&"), query), f"&({TRACKING})(=[^&]*)?(?=&|$)", "")
    query = F.regexp_replace(query, "^&", "?")
    return F.when(F.contains(url, F.lit("://")),
                  F.concat(F.regexp_replace(host(url), r"^www\.", ""), page,
                           F.when(query == "?", F.lit("")).otherwise(query)))


def rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null without one."""
    name = verdict = F
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host_ == h) | F.endswith(host_, F.lit("." + h))) & F.startswith(path_, F.lit(p))
        name, verdict = name.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(v))
    return name, verdict


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical for each page. ``listed``
    has the canonical URLs to block, in column ``canonical``."""
    listed = stored(listed.select("canonical").filter("canonical is not null").distinct(), "listed")
    u = F.col("url")
    d = pages.select("page_id", host(u).alias("host"), path(u).alias("path"), canonical(u).alias("canonical"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    d = d.select("*", name.alias("rule"), verdict.alias("rule_says"))
    d = d.withColumn("asked", F.when(F.col("rule").isNull(), F.col("canonical")))
    blocks, n = blocked_bloom(listed, "canonical")
    d = maybe_in(d, "asked", blocks, n, "maybe")
    names = ["page_id", "host", "path", "rule"]
    sure = d.filter("not maybe").select(*names, F.coalesce("rule_says", F.lit("allow")).alias("verdict"), "canonical")
    found = d.filter("maybe").join(listed.withColumn("listed", F.lit(True)), "canonical", "left").select(
        *names, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"), "canonical")
    return sure.unionByName(found)


#: For the query: a page with fewer characters of HTML puts its URL on the list.
THIN_HTML = 1200


def thin_pages(pages: DataFrame, chars: int = THIN_HTML) -> DataFrame:
    """Canonical URLs under which a thin page was fetched."""
    return pages.filter(F.length("html") < chars).select(canonical(F.col("url")).alias("canonical"))
