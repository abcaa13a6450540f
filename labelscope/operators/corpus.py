"""Corpus preparation: labelled, stratified, de-duplicated item tables.

Sampling order is ``md5(seed || '-' || key)`` (then the key): reproducible
under any partitioning and in any SQL engine. Top-n per group is a
``row_number() <= n`` filter, which Spark plans as a partial
``WindowGroupLimit`` before the shuffle, so a hot label ships at most n rows
per input partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions.fixed_values import (
    DEFAULT_PROJECT, LABEL_KEYWORDS, ORIGINS, PROJECT_PREFIXES, RAW_LABEL_MAP,
    SAMPLES_PER_LABEL, SEED, SOURCE_EXTENSIONS,
)
from labelscope.functions.text import (
    basename, bind, ends_with_any, extension, parent_dir, py_split_first, stem,
)

def sample_order(key: Column | str, seed: int | str = SEED) -> Column:
    """Pseudo-random but fixed order key for ``key``."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(str(seed)), F.lit("-"), k.cast("string")))


# -- paths -------------------------------------------------------------------

def path_labels(paths: DataFrame, path_col: str = "path",
                extensions: Sequence[str] = SOURCE_EXTENSIONS,
                keep_all: bool = False) -> DataFrame:
    """Add filename, stem, ext, gold_label (immediate parent folder) and
    ``kept`` (file name ends with a kept extension, case-sensitive)."""
    out = (paths.withColumn("filename", basename(path_col))
                .withColumn("stem", stem("filename"))
                .withColumn("ext", extension("filename"))
                .withColumn("gold_label", parent_dir(path_col))
                .withColumn("kept", ends_with_any("filename", extensions)))
    return out if keep_all else out.where("kept").drop("kept")


def keyword_label_expr(stem_col: Column | str,
                       keywords: Sequence[tuple[str, Sequence[str]]] = LABEL_KEYWORDS) -> Column:
    """First label (in the given order) whose keyword occurs in the
    lower-cased stem; NULL when none does. The keywords are part of the
    expression; ``keyword_labels_join`` is for tables of any size."""
    def first_label(s):
        out = None
        for label, kws in keywords:
            cond = None
            for kw in kws:
                c = s.contains(kw.lower())
                cond = c if cond is None else (cond | c)
            out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
        return out

    return bind(F.lower(F.col(stem_col) if isinstance(stem_col, str) else stem_col), first_label)


def keyword_labels(paths: DataFrame, stem_col: str = "stem",
                   keywords: Sequence[tuple[str, Sequence[str]]] = LABEL_KEYWORDS) -> DataFrame:
    """Items labelled by stem keyword; items without a keyword are dropped."""
    return (paths.withColumn("label", keyword_label_expr(stem_col, keywords))
                 .where(F.col("label").isNotNull()))


def _grams(text: Column, length: int) -> Column:
    """Distinct substrings of a length."""
    at = F.when(F.length(text) >= length, F.sequence(F.lit(1), F.length(text) - length + 1)) \
        .otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(length))))


def keyword_labels_join(paths: DataFrame, keywords: DataFrame, stem_col: str = "stem",
                        key_col: str = "path") -> DataFrame:
    """``keyword_labels`` for a keyword table (label, keyword, priority) of
    any size, by equi-joins; the best priority wins, then the first label.

    Each keyword is listed under the one of its three-character pieces that is
    rarest among the stems (under itself, if it is shorter). The distinct stems
    meet, by their pieces, only keywords listed under one of them, which are
    then looked for in the stem. ``key_col`` is not needed any more."""
    del key_col
    kw = keywords.select(F.col("label").alias("__label"), F.lower("keyword").alias("__kw"),
                         F.col("priority").alias("__prio")).where("__kw <> ''").distinct()
    stems = paths.select(F.lower(F.col(stem_col)).alias("__stem")).distinct()
    pieces = stems.select("__stem", F.explode(_grams(F.col("__stem"), 3)).alias("__piece"))
    seen = pieces.groupBy("__piece").agg(F.count(F.lit(1)).alias("__n"))
    # A piece that no stem has rules its keyword out: the inner join drops it,
    # and the keyword is listed under another, where it is not found.
    listed = (kw.where(F.length("__kw") >= 3)
              .select("__label", "__kw", "__prio", F.explode(_grams(F.col("__kw"), 3)).alias("__piece"))
              .join(seen, "__piece")
              .groupBy("__label", "__kw", "__prio").agg(F.min_by("__piece", F.struct("__n", "__piece")).alias("__piece")))
    found = pieces.join(listed, "__piece").where(F.col("__stem").contains(F.col("__kw")))
    short = stems.select("__stem", F.explode(F.concat(_grams(F.col("__stem"), 1), _grams(F.col("__stem"), 2))).alias("__kw")) \
        .join(kw.where(F.length("__kw") < 3), "__kw")
    cols = ["__stem", "__label", "__prio"]
    best = found.select(*cols).unionByName(short.select(*cols)).groupBy("__stem").agg(
        F.min_by("__label", F.struct("__prio", "__label")).alias("label"))
    return paths.join(best, F.lower(F.col(stem_col)) == F.col("__stem")).drop("__stem")


def project_names(paths: DataFrame, path_col: str = "path", root: str = "",
                  prefixes: Sequence[str] = PROJECT_PREFIXES,
                  default: str = DEFAULT_PROJECT, origin: str = "PMART",
                  stem_col: str = "stem", ext: str = ".java") -> DataFrame:
    """Project = first directory below ``root`` whose name starts with one of
    ``prefixes``, cut at the first white space (else ``default``); item name
    = '<origin>-<project>-<stem><ext>'."""
    rel = F.col(path_col)
    if root:
        r = root.rstrip("/") + "/"
        rel = F.when(rel.startswith(r), F.substring(rel, len(r) + 1, 1 << 30)).otherwise(rel)
    parts = F.filter(F.split(rel, "/"), lambda p: p != "")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    def any_prefix(x):
        cond = None
        for p in prefixes:
            cond = x.startswith(p) if cond is None else (cond | x.startswith(p))
        return cond

    first = F.try_element_at(F.filter(dirs, any_prefix), F.lit(1))
    project = F.coalesce(F.regexp_replace(py_split_first(first), " ", "-"), F.lit(default))
    return paths.withColumn("project", project).withColumn(
        "item_name", F.concat_ws("-", F.lit(origin), F.col("project"),
                                 F.concat(F.col(stem_col), F.lit(ext))))


# -- labels from an index ------------------------------------------------------

def label_map_join(index: DataFrame, label_map: Mapping[str, str] | DataFrame = RAW_LABEL_MAP,
                   raw_col: str = "raw_label", out_col: str = "label") -> DataFrame:
    """Keep index rows whose raw label maps, adding ``out_col`` (inner join
    to the map; Spark broadcasts the map from its measured size). Column
    names are case-insensitive: rename a raw 'Label' column first."""
    if not isinstance(label_map, DataFrame):
        label_map = index.sparkSession.createDataFrame(
            list(label_map.items()), "raw string, label string")
    m = label_map.select(F.col("raw").alias("__raw"), F.col("label").alias(out_col))
    return index.join(m, F.col(raw_col) == F.col("__raw"), "inner").drop("__raw")


# -- sampling ----------------------------------------------------------------

def stratified_sample(df: DataFrame, label_col: str | Sequence[str], key_col: str,
                      n: int = SAMPLES_PER_LABEL, seed: int = SEED,
                      rank_col: str = "sample_rank") -> DataFrame:
    """min(n, group size) rows per label (or per combination of columns,
    e.g. origin and label) without replacement, in a fixed order."""
    groups = [label_col] if isinstance(label_col, str) else list(label_col)
    w = Window.partitionBy(*groups).orderBy(sample_order(key_col, seed), F.col(key_col))
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def sample_then_exists(df: DataFrame, existing: DataFrame, label_col: str, key_col: str,
                       n: int = SAMPLES_PER_LABEL, seed: int = SEED,
                       exists_first: bool = False) -> DataFrame:
    """Sample, then keep sampled rows whose key exists in ``existing`` (a
    label can end under-filled, as in the reference). ``exists_first``
    filters before sampling instead."""
    ex = existing.select(key_col)
    if exists_first:
        return stratified_sample(df.join(ex, key_col, "left_semi"), label_col, key_col, n, seed)
    return stratified_sample(df, label_col, key_col, n, seed).join(ex, key_col, "left_semi")


def dedup_keep_first(df: DataFrame, label_col: str, name_col: str, key_col: str,
                     n: int = SAMPLES_PER_LABEL, seed: int = SEED,
                     existing: DataFrame | None = None) -> DataFrame:
    """Shuffle each label's items, keep the first item of every name, drop
    names already present (``existing``: label_col, name_col), then cap at n
    per label. A name already present does not use up the cap."""
    order = [sample_order(key_col, seed), F.col(key_col)]
    w1 = Window.partitionBy(label_col, name_col).orderBy(*order)
    firsts = df.withColumn("__r1", F.row_number().over(w1)).where("__r1 = 1").drop("__r1")
    if existing is not None:
        firsts = firsts.join(existing.select(label_col, name_col).distinct(),
                             [label_col, name_col], "left_anti")
    w2 = Window.partitionBy(label_col).orderBy(*order)
    return firsts.withColumn("sample_rank", F.row_number().over(w2)).where(F.col("sample_rank") <= n)


def corpus_summary(corpus: DataFrame, label_col: str = "gold_label",
                   origin_col: str = "origin", origins: Sequence[str] = ORIGINS,
                   total_label: str = "TOTAL") -> DataFrame:
    """Items per (label, origin) as one column per origin plus a total column,
    and a total row (rollup)."""
    aggs = [F.count_if(F.col(origin_col) == o).alias(o.lower()) for o in origins]
    out = corpus.rollup(label_col).agg(*aggs, F.count(F.lit(1)).alias("total"),
                                       F.grouping(label_col).alias("__g"))
    return out.select(F.when(F.col("__g") == 1, F.lit(total_label))
                       .otherwise(F.col(label_col)).alias(label_col),
                      *[o.lower() for o in origins], "total")


# -- building a corpus from collections -------------------------------------------------

CORPUS_COLUMNS = ("gold_label", "filename", "origin", "path")


def index_collection(index: DataFrame, files: DataFrame, label_map: Mapping[str, str] | DataFrame = RAW_LABEL_MAP,
                     n: int = SAMPLES_PER_LABEL, seed: int = SEED, origin: str = "DPD", ext: str = ".java",
                     exists_first: bool = False) -> DataFrame:
    """Items of a collection with an index (raw_label, Project, Class): index
    rows whose label maps, at most ``n`` sampled for each label, of which those
    whose file ``<Project>-<Class><ext>`` is listed in ``files`` (path,
    filename) stay. Columns ``CORPUS_COLUMNS``; the name gets the origin."""
    named = label_map_join(index, label_map, "raw_label", "gold_label").withColumn(
        "name", F.concat("Project", F.lit("-"), "Class", F.lit(ext)))
    listed = files.select(F.col("filename").alias("name"), "path")
    sample = sample_then_exists(named.select("gold_label", "name").distinct(), listed, "gold_label", "name", n, seed,
                                exists_first)
    return sample.join(listed, "name").select(
        "gold_label", F.concat(F.lit(f"{origin}-"), "name").alias("filename"), F.lit(origin).alias("origin"), "path")


def tree_collection(files: DataFrame, n: int = SAMPLES_PER_LABEL, seed: int = SEED,
                    origin: str = "PMART", keywords: Sequence[tuple[str, Sequence[str]]] | DataFrame = LABEL_KEYWORDS,
                    existing: DataFrame | None = None) -> DataFrame:
    """Items of a collection without an index (``files``: path, below,
    filename): the label is the first whose keyword is in the file's stem, the
    name is composed of origin, project (a folder below the root) and stem; of
    equal names the first of the pseudo-random order stays, at most ``n`` for
    each label. ``existing`` (gold_label, filename) is left out. The order goes
    by the path below the root, so it is the same wherever the collection
    lies. Columns ``CORPUS_COLUMNS``."""
    found = files.select("path", "below", stem("filename").alias("stem"))
    found = (keyword_labels_join(found, keywords) if isinstance(keywords, DataFrame)
             else keyword_labels(found, keywords=keywords))
    named = project_names(found, path_col="below", origin=origin).select(
        F.col("label").alias("gold_label"), F.col("item_name").alias("filename"), "path", "below")
    kept = dedup_keep_first(named, "gold_label", "filename", "below", n, seed, existing)
    return kept.select("gold_label", "filename", F.lit(origin).alias("origin"), "path")


def build_corpus(parts: Sequence[DataFrame], contents: Sequence[DataFrame], out: str, clear: bool = True,
                 label_col: str = "gold_label") -> DataFrame:
    """One call from collections to a corpus: the union of ``parts``
    (``index_collection``, ``tree_collection``) with the texts of ``contents``
    (``sources.corpus.read_texts`` of each collection), written with a folder
    for each label. ``clear`` removes what an earlier build left; without it
    only the labels of this build are replaced. Returns the corpus as written:
    the label, filename, origin, path, content (NULL if unreadable)."""
    items = _union(parts)
    texts = _union([c.select("path", "content") for c in contents])
    # Spark can't tell the size of texts that tasks read, and might broadcast them.
    corpus = items.join(texts.hint("merge"), "path", "left").select(label_col, "filename", "origin", "path", "content")
    materialize_corpus(corpus, out, label_col, clear)
    return corpus.sparkSession.read.parquet(out).select(corpus.columns)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def materialize_corpus(corpus: DataFrame, path: str, label_col: str = "gold_label", clear: bool = True) -> None:
    """Write the corpus, one folder per label, replacing any earlier build
    (``clear=False``: only the labels of this one)."""
    (corpus.write.mode("overwrite").option("partitionOverwriteMode", "static" if clear else "dynamic")
        .partitionBy(label_col).parquet(path))
