"""Line dedup by an exact set-similarity join.

A line's set is its distinct words (A-Z as a-z). A line is removed if an
earlier one, by (doc_id, line number), has a Jaccard similarity of at least
``PERCENT`` / 100; all lines are judged on the input. Lines without words are
never removed.

1. Tokens are ordered by rarity: counts over all lines in ``CELLS`` hash
   cells (bounded, so they can go to every task), then by name. Any total
   order gives exact results; rarity keeps candidates few.
2. Lines with equal sets are one node; all but the first are removed.
3. Prefix filter: similar sets share one of the rarest
   n - ceil(t n) + 1 tokens of each. Spark brings the rows of a prefix token
   together, ordered by size. The rarest shared token of a pair leaves no more
   in common than what follows it in either set, so each row meets only the
   larger sets of its token up to the size that this allows (``candidates``).
   Pairs must then pass a parity bitmap of
   64 ``WORDS`` bits: each token in one set only flips one bit, so more bits apart than tokens may
   differ rules a pair out. Few pairs pass that aren't similar, also where
   many lines share a passage.
4. What passes is verified on the lines' words.

Many variants of one line would all pair with each other, so a round before
the join tests each line only against one line of the first document in
three small buckets (its least tokens by three hashes). The join then leaves
out pairs of lines that are both removed already: they decide nothing.

Null texts have no lines. Repeated rows (equal id and text) are one document.
A null id comes before all others. Empty tables give no rows. Extra columns
stay as they are in ``drop_lines``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import blocked_bloom, likely, maybe_in, mix, names_of, stored, text_key

PERCENT = 80
CELLS = 1 << 18                      # a cell is the low 18 bits of a name
BLOCK = 1 << 10                      # cells whose counts move as one row
BUCKETS = 3
WORDS = 2                            # of 64 bits, of a bitmap
ROWS, PAIRS = 1 << 17, 1 << 18       # of prefix tokens, and pairs of them, that a task looks at together
_SALT = np.array([0x3C79AC492BA7B653, 0x1C69B3F74AC4AE35, 0x5851F42D4C957F2D], np.uint64)


def _cells(ids: np.ndarray) -> np.ndarray:
    return (ids % np.uint64(CELLS)).astype(np.int64)


def _need(size: np.ndarray, percent: int) -> np.ndarray:
    """ceil(t size)"""
    return -(-size * percent // 100)


def _block_rows(count: np.ndarray) -> pa.RecordBatch:
    """The counts of all cells, a row for each block that has any."""
    rows = count.reshape(-1, BLOCK)
    block = np.flatnonzero(rows.any(1))
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array([rows[b].tobytes() for b in block], pa.binary())],
                                      names=["block", "counts"])


def _blocks_added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros((CELLS // BLOCK, BLOCK), np.int64)
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            count[block] += np.frombuffer(counts, np.int64)
    yield _block_rows(count)


def rarity(docs: DataFrame) -> np.ndarray:
    """The place of each hash cell when they are ordered by their counts of
    the words of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(CELLS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, _ = names_of([(t or b"").lower() for t in batch.column(0).slice(at, 500).to_pylist()])
                count += np.bincount(_cells(ids), minlength=CELLS)
        yield _block_rows(count)

    schema = "block int, counts binary"
    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, schema) \
        .repartition("block").mapInArrow(_blocks_added, schema)
    out = np.zeros((CELLS // BLOCK, BLOCK), np.int64)
    for block, counts in counted.collect():       # CELLS counts
        out[block] = np.frombuffer(counts, np.int64)
    place = np.zeros(CELLS, np.uint64)
    place[np.argsort(out.reshape(-1), kind="stable")] = np.arange(CELLS, dtype=np.uint64)
    return place


def line_sets(counts: np.ndarray, ids: np.ndarray, rank: np.ndarray, percent: int) -> tuple:
    """For each line that has words: (line, node, size, the words of its
    bitmap, three bucket tokens, prefix tokens, where each line's prefix ends). ``counts`` are the
    words of each line, ``ids`` all their names."""
    line = np.repeat(np.arange(len(counts)), counts)
    # The cell's place in the order of rarity, then the rest of the name. The
    # line and its first bits are one key, unless two names of a line share it.
    rare = rank[_cells(ids)] << np.uint64(46) | ids >> np.uint64(18)
    bits = len(counts).bit_length()
    key = line.astype(np.uint64) << np.uint64(64 - bits) | rare >> np.uint64(bits)
    order = np.argsort(key)
    key, sorted_ids = key[order], ids[order]
    if ((key[1:] == key[:-1]) & (sorted_ids[1:] != sorted_ids[:-1])).any():
        order = np.lexsort((rare, line))
        sorted_ids = ids[order]
    ids, line = sorted_ids, line[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (line[1:] != line[:-1])
    ids, line = ids[new], line[new]
    begin = np.flatnonzero(np.diff(line, prepend=-1))
    lines, size = line[begin], np.diff(begin, append=len(line))
    mixed = mix(ids)
    node = mix(np.add.reduceat(mixed, begin) + size.astype(np.uint64))
    at = mixed >> np.uint64(48) & np.uint64(64 * WORDS - 1)
    bit = np.uint64(1) << (at & np.uint64(63))
    bitmap = [np.bitwise_xor.reduceat(np.where(at >> np.uint64(6) == w, bit, np.uint64(0)), begin).view(np.int64)
              for w in range(WORDS)]
    short = (ids >> np.uint64(16)).astype(np.uint32).view(np.int32)
    buckets = [np.minimum.reduceat(mixed * s, begin).view(np.int64) for s in _SALT]
    width = size - _need(size, percent) + 1
    inside = np.arange(len(ids)) - np.repeat(begin, size) < np.repeat(width, size)
    return lines, node.view(np.int64), size, bitmap, buckets, short[inside], np.cumsum(width)


_BITS = [f"w{j}" for j in range(WORDS)]
_KEYS = [f"b{j}" for j in range(BUCKETS)]
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("line", pa.int32()), ("node", pa.int64()),
                     ("n", pa.int32()), *((c, pa.int64()) for c in _BITS + _KEYS), ("prefix", pa.list_(pa.int32()))])


def lines(docs: DataFrame, rank: np.ndarray, percent: int) -> DataFrame:
    """A row for each line with words; bitmap (w0, w1), buckets (b0 to b2) and
    prefix are null where the worker has given the node before."""
    where = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                texts = [(t or b"").lower().split(b"\n") for t in part.column(2).to_pylist()]
                ids, counts = names_of([x for t in texts for x in t])
                if not len(ids):
                    continue
                got, node, n, bitmap, buckets, prefix, ends = line_sets(counts, ids, where.value, percent)
                per_doc = np.array([len(t) for t in texts])
                doc = np.repeat(np.arange(len(texts)), per_doc)[got]
                number = got - (np.cumsum(per_doc) - per_doc)[doc]
                if len(given) > 500_000:
                    given.clear()
                fresh = np.zeros(len(node), bool)
                for i, x in enumerate(node.tolist()):
                    if x not in given:
                        given.add(x)
                        fresh[i] = True
                first = np.concatenate([[0], ends[:-1]])
                take = np.repeat(fresh, ends - first)
                edges = np.concatenate([[0], np.cumsum(np.where(fresh, ends - first, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(prefix[take], pa.int32()),
                                                 mask=pa.array(~fresh))
                known = [pa.array(x, mask=~fresh) for x in (*bitmap, *buckets)]
                doc = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(doc), part.column(1).take(doc), pa.array(number, pa.int32()),
                     pa.array(node, pa.int64()), pa.array(n, pa.int32()), *known, lists],
                    schema=_SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       text_key(F.col("doc_id"), F.col("text")).alias("row"), F.col("text").cast("binary").alias("text")) \
        .mapInArrow(run, "doc_id long, row long, line int, node long, n int, "
                    + "".join(f"{c} long, " for c in _BITS + _KEYS) + "prefix array<int>")


def _met(rows: dict[str, np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node, node) of the pairs of rows of one token that may be similar.
    ``rows`` are whole tokens, ordered by ``key`` (the token, then the size)."""
    key, node, m, bitmap = rows["key"], rows["node"], rows["m"], [rows[w].view(np.uint64) for w in _BITS]
    token, size, place, done = key >> 32, key & 0xFFFFFFFF, m >> 1, (m & 1).astype(bool)
    at = np.arange(len(key))
    most = (100 + percent) * (size - place) // percent - size           # words of the larger set
    ends = np.searchsorted(key, token << 32 | np.clip(most, 0, (1 << 31) - 1), "right")
    open_ = np.flatnonzero(~done)
    # A row of a node that is removed already meets only those that aren't.
    low = np.where(done, np.searchsorted(open_, at + 1), at + 1)
    count = np.maximum(np.where(done, np.searchsorted(open_, ends), ends) - low, 0)
    total = np.cumsum(count)
    for begin in range(0, int(total[-1]), PAIRS):                       # a row's pairs may be cut here
        pair = np.arange(begin, min(begin + PAIRS, int(total[-1])))
        i = np.searchsorted(total, pair, "right")
        j = low[i] + pair - (total[i] - count[i])
        d = done[i]
        j[d] = open_[j[d]]
        both = size[i] + size[j]
        may = ((100 + percent) * (size[j] - place[j]) >= percent * both) & (node[i] != node[j])
        i, j, both = i[may], j[may], both[may]
        apart = sum(np.bitwise_count(bits[i] ^ bits[j]).astype(np.int64) for bits in bitmap)
        may = (100 + percent) * apart <= (100 - percent) * both
        yield node[i[may]], node[j[may]]


def candidates(p: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the nodes that may be similar, from a row for each prefix
    token: token, n, node, w0, w1, m (twice its place, plus 1 if the node is
    removed already). A task reads its tokens as a stream and holds one of
    them, or ``ROWS`` rows, at a time."""
    names = ["key", "node", *_BITS, "m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out(parts: list[dict]) -> Iterator[pa.RecordBatch]:
            for x, y in _met({c: np.concatenate([h[c] for h in parts]) for c in names}, percent):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        for batch in batches:
            part = {c: batch.column(c).to_numpy() for c in names}
            if n >= ROWS:
                token = part["key"] >> 32
                cut = int(np.searchsorted(token, held[-1]["key"][-1] >> 32, "right"))
                if cut < batch.num_rows:
                    yield from out([*held, {c: x[:cut] for c, x in part.items()}])
                    held, n, part = [], 0, {c: x[cut:] for c, x in part.items()}
            if len(part["key"]):
                held.append(part)
                n += len(part["key"])
        if held:
            yield from out(held)

    key = F.call_function("shiftleft", F.col("token").cast("long"), F.lit(32)).bitwiseOR(F.col("n").cast("long"))
    return p.select(key.alias("key"), "node", *_BITS, F.col("m").cast("long").alias("m")) \
        .repartition(F.shiftright("key", 32)).sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _may_match(na: Column, nb: Column, a: Sequence[Column], b: Sequence[Column], percent: int) -> Column:
    """Length filter, and no more bits apart than tokens may differ; the
    bitmaps are a and b."""
    apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)), F.lit(0))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) \
        & ((100 + percent) * apart <= (100 - percent) * (na + nb))


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose words are similar enough."""
    side = lambda s: texts.select(*(F.col(c).alias(c if c == "node" else c + s) for c in texts.columns)) \
        .withColumnRenamed("node", s)
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    common = F.size(F.array_intersect(F.split("wordsa", " "), F.split("wordsb", " ")))
    return both.filter((100 + percent) * common >= percent * (F.col("ka") + F.col("kb"))).select("a", "b")


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, row, line, node of each line to remove."""
    docs = docs.select("doc_id", "text")
    all_lines = stored(lines(docs, rarity(docs), percent), "lines")
    at = F.struct(F.col("doc_id"), F.col("line"), F.col("row"))
    nodes = stored(all_lines.groupBy("node").agg(
        F.min(at).alias("at"), *(F.first(c, ignorenulls=True).alias(c) for c in ("n", *_BITS, *_KEYS, "prefix"))), "lines_nodes")
    first = nodes.select("node", "at")

    # Each line against one line of the first document in its buckets.
    rows = nodes.select("node", "n", *_BITS, F.coalesce("at.doc_id", F.lit(-(1 << 63))).alias("doc"),
                        F.explode(F.array(*_KEYS)).alias("bucket"))
    lead = rows.groupBy("bucket").agg(*(F.min_by(c, "doc").alias(f"{c}_a") for c in ("node", "n", *_BITS)),
                                      F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k").hint("shuffle_hash")       # a row for each bucket
    star = rows.drop("doc").join(lead, "bucket").filter(
        (F.col("node_a") != F.col("node")) & _may_match(
            F.col("n_a"), F.col("n"), [F.col(f"{c}_a") for c in _BITS], [F.col(c) for c in _BITS], percent)) \
        .select(F.least("node_a", "node").alias("a"), F.greatest("node_a", "node").alias("b")).distinct()
    star = stored(star, "lines_star")
    texts, at_of = _texts(docs, first, star)
    done = stored(_later(_verified(star, texts, percent), at_of).distinct(), "lines_done")

    # All pairs that share a prefix token, but for those both removed already.
    d = maybe_in(nodes.select("node", "n", *_BITS, "prefix"), "node", *blocked_bloom(done, "node"), "may")
    d = d.filter(~F.col("may")).withColumn("done", F.lit(0)).unionByName(      # only nodes that may be removed move
        d.filter("may").join(done.withColumn("done", F.lit(1)), "node", "left").withColumn("done", F.coalesce("done", F.lit(0))))
    p = d.select("node", "n", *_BITS, "done", F.posexplode("prefix").alias("p", "token"))
    met = candidates(p.withColumn("m", F.col("p") * 2 + F.col("done")), percent).distinct()
    met = stored(met.join(star, ["a", "b"], "left_anti"), "lines_pairs")
    texts, at_of = _texts(docs, first, met)
    more = _later(_verified(met, texts, percent), at_of)
    similar = done.unionByName(more.select("node")).distinct().withColumn("similar", F.lit(True))
    return all_lines.select("doc_id", "row", "line", "node").join(first, "node").join(similar, "node", "left") \
        .filter(F.col("similar") | (at != F.col("at"))).select("doc_id", "row", "line", "node")


def _later(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """node: the later of each pair; ``first`` has node, at."""
    side = lambda s: first.select(F.col("node").alias(s), F.col("at").alias(f"at_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b") \
        .select(F.when(F.col("at_a") < F.col("at_b"), F.col("b")).otherwise(F.col("a")).alias("node"))


def _texts(docs: DataFrame, first: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the nodes in the pairs: node, words (distinct, joined by spaces: a
    shuffle moves them for each pair), k (how many), from their first line;
    and node, at."""
    asked = stored(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(),
                   "lines_asked")
    at_of = stored(likely(first, "node", asked).join(asked, "node"), "lines_wanted")
    wanted = at_of.select("node", "at.row", "at.line")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = likely(docs.select(text_key(F.col("doc_id"), F.col("text")).alias("row"), "text"), "row", wanted)
    line = F.get(F.split("text", "\n"), F.col("line"))
    words = F.array_distinct(F.array_remove(F.split(F.translate(line, upper + "\t\x0b\x0c\r", lower + "    "), " "), ""))
    return stored(found.join(wanted, "row").select("node", words.alias("words")).dropDuplicates(["node"])
                  .select("node", F.array_join("words", " ").alias("words"), F.size("words").alias("k")), "lines_texts"), at_of


def drop_lines(docs: DataFrame, percent: int = PERCENT, empty: bool = False) -> DataFrame:
    """The documents without the removed lines, with the input's columns;
    ``n_chars`` follows the text if there is one. Documents that lose their
    last word go, unless ``empty``; those that had none stay."""
    row, out, may = "__llm_row", "__llm_lines", "__llm_may"
    gone = stored(removed_lines(docs, percent).groupBy(F.col("row").alias(row))
                  .agg(F.collect_set("line").alias(out)), "lines_gone")               # of one document
    blocks, n = blocked_bloom(gone, row)
    d = maybe_in(docs.withColumn(row, text_key(F.col("doc_id"), F.col("text"))), row, blocks, n, may)
    same = d.filter(~F.col(may)).select(*docs.columns)       # only texts that may change move
    d = d.filter(may).join(gone, row, "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col(out), i)), "\n")
    d = d.withColumn("text", F.when(F.col(out).isNull(), F.col("text")).otherwise(left))
    if not empty:
        d = d.filter(F.col(out).isNull() | F.regexp_like("text", F.lit("[^ \t-\r]")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col(out).isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(docs.schema["n_chars"].dataType)))
    return same.unionByName(d.select(*docs.columns))


def line_counts(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, row, n_lines (with words), removed (their numbers from 0)."""
    d = docs.select("doc_id", text_key(F.col("doc_id"), F.col("text")).alias("row"), F.size(F.filter(
        F.split(F.coalesce("text", F.lit("")), "\n"),
        lambda x: F.regexp_like(x, F.lit("[^ \t-\r]")))).cast("long").alias("n_lines"))
    gone = removed_lines(docs, percent).select("row", "line").distinct() \
        .groupBy("row").agg(F.array_sort(F.collect_list("line")).alias("removed"))
    return d.join(gone, "row", "left").select("doc_id", "row", "n_lines", F.coalesce(
        "removed", F.array().cast("array<int>")).alias("removed"))
