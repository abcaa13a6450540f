"""MinHash near-dedup with odd sketches.

Words are lower-cased (A-Z) runs without white space; a document's set is its
distinct ``k``-word shingles, the whole sequence if it has fewer words. Two
documents are linked if their sets' Jaccard similarity is at least
``PERCENT`` / 100; a group is a connected component of links.

1. Documents with equal sets are one node from the start.
2. ``BANDS`` x ``ROWS`` MinHash samples a node; equal bands put nodes in one
   bucket. All samples are also folded into an odd sketch: sample j with value
   v flips bit hash(j, v). The XOR of two sketches has about
   n/2 (1 - (1 - 2/n) ** (2 * samples * (1 - J))) bits set, which tells high
   similarities J apart precisely; pairs clearly below the threshold go there.
3. What stays is confirmed on the full sets, from the whole texts.

Buckets are never expanded into all pairs. First each member meets its
bucket's least node, then, where a bucket still holds several components, the
least node outside the first one; last, members of *different* components of
a bucket meet pair by pair. There a second bitmap, the parities of the whole
sets, comes before the texts: each shingle in one set only flips one bit, so
more bits apart than shingles may differ rules a pair out for certain, and
documents that share a passage but are no copies go without a look at their
texts. Pairs inside a component need no test: they change no component. A pair at the threshold shares no band with probability
(1 - 0.8 ** ROWS) ** BANDS, 3e-6.

Nulls and texts without words have empty sets and are linked with nothing.
Repeated rows, and rows that share an id, have nodes by their sets. A null id
is never a group's id unless all its ids are null. Empty tables give no rows.
Other columns are ignored; ``drop_copies`` returns the input's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import (blocked_bloom, components, likely, maybe_in, mix, names_of, shingles, stored,
                                   text_key)

BANDS, ROWS = 32, 5
BITS = 1024                          # of an odd sketch
PARITY_BITS = 4096                   # of a whole set's parities
PERCENT = 80
#: Pairs whose sketches say less than this (6 standard deviations below the
#: threshold) aren't confirmed.
LEAST_ESTIMATE = 0.62

_rng = np.random.default_rng(20240)
_MUL = _rng.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted names of the distinct shingles of each lower-cased text."""
    names, counts = names_of([(t or b"").lower() for t in texts])
    return [np.unique(shingles(part, k)) for part in np.split(names, np.cumsum(counts)[:-1])]


def samples(names: np.ndarray, step: int = 2048) -> np.ndarray:
    """The MinHash samples of a set."""
    low = np.full(len(_MUL), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(names), step):
        np.minimum(low, (_MUL[:, None] * names[None, at:at + step] + _ADD[:, None]).min(1), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        out = mix(out + low.reshape(BANDS, ROWS)[:, j])
    return out


def odd_sketch(low: np.ndarray) -> np.ndarray:
    bit = mix(low + np.arange(len(low), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BITS)
    odd = np.bincount(bit.astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def features(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, row, n, node, bands, sketch; node is the name of the set."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    text_key(F.col("doc_id"), F.col("text")).alias("row"), F.col("text").cast("binary").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("node", pa.int64()),
                        ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                out: list[list] = [[], [], [], []]
                for names in shingle_sets(part.column(2).to_pylist(), k):
                    row = [len(names), None, None, None]
                    if len(names):
                        low = samples(names)
                        row[1:] = (np.uint64(xxhash.xxh64_intdigest(names.tobytes())).astype(np.int64).item(),
                                   bands(low).view(np.int64), odd_sketch(low).view(np.int64))
                    for c, v in zip(out, row):
                        c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1),
                     *(pa.array(c, f.type) for c, f in zip(out, list(schema)[2:]))], schema=schema)

    return d.mapInArrow(run, "doc_id long, row long, n long, node long, bands array<long>, sketch array<long>")


def _plausible(na: Column, nb: Column, a: Column, b: Column, percent: int) -> Column:
    """By the sizes and the odd sketches, the pair may reach the threshold."""
    differ = _differ(a, b, BITS)
    most = BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * BANDS * ROWS * (1 - LEAST_ESTIMATE * percent / PERCENT)))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (differ <= F.lit(float(most)))


def _differ(a: Column, b: Column, bits: int) -> Column:
    return sum((F.bit_count(a[j].bitwiseXOR(b[j])) for j in range(bits // 64)), F.lit(0))


def parities(texts: DataFrame, k: int) -> DataFrame:
    """node, parity (of how many of its shingles fall on each of the bits)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for names in (shingle_sets([t], k)[0] for t in batch.column(1).to_pylist()):
                odd = np.bincount((mix(names) % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
                out.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["node", "parity"])

    return texts.select("node", "text").mapInArrow(run, "node long, parity array<long>")


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) of the pairs that reach the threshold on their full sets."""
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b") \
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:                     # rows come sorted by a after the join
                    last, known = a, shingle_sets([ta.as_py()], k)[0]
                other = shingle_sets([tb.as_py()], k)[0]
                common = len(np.intersect1d(known, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(known) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]) \
                .filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, row, node, component_id, kept for each document."""
    rows = stored(features(docs, k), "minhash")
    nodes = stored(rows.filter("node is not null").select("node", "row", "n", "bands", "sketch")
                   .dropDuplicates(["node"]), "minhash_nodes")
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    least = members.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")) \
        .filter("first < last").select("bucket", "first")
    members = stored(members.join(least, "bucket"), "minhash_buckets")     # of two nodes or more

    shape = nodes.select("node", "n", "sketch")
    side = lambda s: shape.select(*(F.col(c).alias(f"{c}_{s}") for c in shape.columns))

    def plausible(pairs: DataFrame) -> DataFrame:
        return pairs.join(side("a"), F.col("a") == F.col("node_a")).join(side("b"), F.col("b") == F.col("node_b")) \
            .filter(_plausible(F.col("n_a"), F.col("n_b"), F.col("sketch_a"), F.col("sketch_b"), percent)) \
            .select("a", "b")

    first = stored(plausible(members.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
                             .distinct()), "minhash_pairs")
    # Texts of the nodes that share a bucket; nothing else is confirmed.
    wanted = stored(nodes.join(members.select("node").distinct(), "node").select("node", "row"), "minhash_wanted")
    texts = stored(likely(docs.select(text_key(F.col("doc_id"), F.col("text")).alias("row"),
                                      F.col("text").cast("binary").alias("text")), "row", wanted)
                   .join(wanted, "row").dropDuplicates(["node"]).select("node", "text"), "minhash_texts")
    links = stored(_confirm(first, texts, k, percent), "minhash_links")
    tested = first

    def with_components() -> DataFrame:
        """Members of the buckets that hold several components."""
        comp = components(links)
        m = members.select("bucket", "node").join(comp, "node", "left") \
            .withColumn("comp", F.coalesce("comp", "node"))
        mixed = m.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
        return stored(m.join(mixed.select("bucket", "low"), "bucket"), "minhash_mixed")

    mixed = with_components()
    second = mixed.filter("comp <> low").groupBy("bucket").agg(F.min(F.struct("node", "comp")).alias("lead"))
    pairs = mixed.join(second, "bucket").filter("comp <> lead.comp") \
        .select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()
    pairs = stored(plausible(pairs.join(tested, ["a", "b"], "left_anti")), "minhash_pairs")
    links = stored(links.unionByName(_confirm(pairs, texts, k, percent)), "minhash_links")
    tested = tested.unionByName(pairs)

    mixed = with_components()
    parity = stored(parities(texts.join(mixed.select("node").distinct(), "node"), k), "minhash_parities")
    mixed = mixed.join(shape, "node").join(parity, "node")
    half = lambda s: mixed.select("bucket", *(F.col(c).alias(f"{c}_{s}")
                                              for c in ("node", "comp", "n", "sketch", "parity")))
    pairs = half("a").join(half("b"), "bucket").filter(
        (F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b"))
        & _plausible(F.col("n_a"), F.col("n_b"), F.col("sketch_a"), F.col("sketch_b"), percent)
        & ((100 + percent) * _differ(F.col("parity_a"), F.col("parity_b"), PARITY_BITS)
           <= (100 - percent) * (F.col("n_a") + F.col("n_b")))) \
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    links = stored(links.unionByName(_confirm(stored(pairs, "minhash_pairs"), texts, k, percent)), "minhash_links")

    comp = components(links)
    per_node = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"),
                                                                   F.min("row").alias("row"))
    heads = per_node.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    ids = heads.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("h"))
    named = heads.join(ids, "comp").select("node", F.col("h.doc_id").alias("component_id"),
                                           F.col("h.row").alias("head_row"))
    return rows.select("doc_id", "row", F.col("n").alias("n_shingles"), "node").join(named, "node", "left").select(
        "doc_id", "n_shingles", "row", "node", "head_row",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def drop_copies(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of each group stays: that with the least id, one row of
    it. Documents without words stay, one row of each. The input's columns."""
    row, may = "__llm_row", "__llm_may"
    g = groups(docs.select("doc_id", "text"), k, percent)
    suspects = stored(g.groupBy(F.col("row").alias(row)).agg(
        F.count(F.lit(1)).alias("k"), F.max(F.coalesce(F.col("row") != F.col("head_row"), F.lit(False))).alias("gone"))
        .filter("k > 1 or gone"), "minhash_gone")
    blocks, n = blocked_bloom(suspects, row)
    d = maybe_in(docs.withColumn(row, text_key(F.col("doc_id"), F.col("text"))), row, blocks, n, may)
    # Only rows that may be copies move.
    rest = d.filter(may).join(suspects.filter("gone").select(row), row, "left_anti").dropDuplicates([row])
    return d.filter(~F.col(may)).select(*docs.columns).unionByName(rest.select(*docs.columns))
