"""Helpers shared by the operators: words, 64-bit names of words and windows,
row keys, intermediate tables in the shared folder, connected components."""

from __future__ import annotations

import sys
import types

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.session import scratch_path

SPACES = " \t\n\x0b\x0c\r"          # the white space that separates words
#: Entries after which the older half of a worker's dictionary is forgotten.
CACHE_WORDS = 300_000


class Remembered(dict):
    """What ``make`` gave for a key, for at most about twice ``limit`` keys:
    call ``trim`` now and then; keys not used since the last trim go."""

    def __init__(self, make=None, limit: int = CACHE_WORDS):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        v = self.old.pop(key, None)
        if v is None:
            v = self.make(key)
        self[key] = v
        return v

    def trim(self) -> None:
        if len(self) > self.limit:
            self.old.clear()                  # before the copy: two halves are held, not three
            self.old = dict(self)
            self.clear()


def in_worker(name: str, make):
    """``make()``, kept while the Python worker lives: it serves many tasks."""
    home = sys.modules.setdefault("labelscope_llm_worker", types.ModuleType("labelscope_llm_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BYTE = np.random.default_rng(64).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
#: Bytes that are named at once, unless one word has more.
NAMED_BYTES = 1 << 17


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept in the worker
    where n is the usual one. (A function wrapped by functools.lru_cache would
    be pickled by reference, which a worker without this folder can't load.)"""
    return in_worker("powers", lambda: _make_powers(n)) if n == NAMED_BYTES else _make_powers(n)


def _make_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = (np.full(n, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    base[0] = inverse[0] = 1
    return np.cumprod(base), np.cumprod(inverse)


def word_names(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit name of each word of a text, and where each begins. A name is a
    polynomial in the word's bytes, so all words are named at once."""
    data = np.frombuffer(text, np.uint8)
    space = np.ones(len(data) + 2, bool)
    np.logical_or(data == 32, data - np.uint8(9) < 5, out=space[1:-1])       # SPACES
    edges = np.flatnonzero(space[1:] != space[:-1])
    begin, end = edges[::2].copy(), edges[1::2].copy()
    out, at = np.zeros(len(begin), np.uint64), 0
    while at < len(begin):
        low = begin[at]
        to = max(at + 1, int(np.searchsorted(end, low + NAMED_BYTES, "right")))
        size = int(end[to - 1] - low)
        power, inverse = _powers(max(NAMED_BYTES, 1 << size.bit_length()))
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(np.take(_BYTE, data[low:low + size]) * power[:size], out=total[1:])
        a, b = begin[at:to] - low, end[at:to] - low
        out[at:to] = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
        at = to
    return out, begin


def names_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of all texts, and how many words each text has."""
    names, begin = word_names(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return names, np.diff(np.searchsorted(begin, ends), prepend=0)


def shingles(ids: np.ndarray, k: int) -> np.ndarray:
    """Names of the k-word shingles in order; fewer words: the sequence as one."""
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(k, n)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out = mix(out + ids[j:n - width + 1 + j])
    return out


def text_key(doc_id: Column, text: Column) -> Column:
    """Name of a row by its id and text; repeated rows share it."""
    return F.xxhash64(doc_id, text)


def word_array(text: Column) -> Column:
    """array<string> of the words; null text has none."""
    one = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        one = F.replace(one, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(one, " "), "")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, and a
    lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components: (node, comp) for every node with an edge in
    ``edges`` (columns a, b); comp is the smallest node. Alternating large and
    small star rounds; each round is one shuffle job whose result is stored.
    Nodes are longs. A hub node is one key with a small pre-aggregated
    minimum, joined back (AQE splits its skew)."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")) \
        .filter("u <> v").distinct()
    e, seen = stored(e, "edges"), None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")) \
        .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


#: Greatest size of a filter of ``likely``: blocks of 256 bits (8 MB of bits).
MAX_BLOCKS = 1 << 18


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), key), F.lit(blocks))


def _mask(key: Column) -> list[Column]:
    """One bit in each of a block's four longs."""
    one, bits = F.lit(1).cast("long"), F.xxhash64(F.lit(7), key)
    return [F.call_function("shiftleft", one, F.shiftright(bits, 6 * j).bitwiseAND(F.lit(63)).cast("int"))
            for j in range(4)]


def blocked_bloom(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(block, w0..w3) of a blocked Bloom filter of the keys, and the number
    of blocks: 16 bits for each row of ``keys``, up to MAX_BLOCKS blocks."""
    n = max(1, min(MAX_BLOCKS, -(-keys.count() * 16 // 256)))
    words = [m.alias(f"w{j}") for j, m in enumerate(_mask(F.col(key)))]
    return keys.select(_block(F.col(key), n).alias("block"), *words) \
        .groupBy("block").agg(*(F.bit_or(f"w{j}").alias(f"w{j}") for j in range(4))), n


def maybe_in(df: DataFrame, key: str, blocks: DataFrame, n: int, out: str) -> DataFrame:
    """``df`` with the boolean ``out``: ``key`` may be in the filter."""
    b = "__llm_block"
    hit = F.lit(True)
    for j, m in enumerate(_mask(F.col(key))):
        hit = hit & (F.col(f"{b}_w{j}").bitwiseAND(m) != 0)
    blocks = blocks.select(F.col("block").alias(b), *(F.col(f"w{j}").alias(f"{b}_w{j}") for j in range(4)))
    return df.withColumn(b, _block(F.col(key), n)).join(F.broadcast(blocks), b, "left") \
        .select(*df.columns, (F.col(key).isNotNull() & F.coalesce(hit, F.lit(False))).alias(out))


def likely(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be in the column ``key`` of
    ``keys``, told before any shuffle by a broadcast Bloom filter. Its size is
    bounded; when it is crowded more rows pass, none that is in ``keys`` ever
    fails, and the join that follows is exact."""
    blocks, n = blocked_bloom(keys, key)
    return maybe_in(df, key, blocks, n, "__llm_maybe").filter("__llm_maybe").select(*df.columns)
