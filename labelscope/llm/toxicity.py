"""Toxicity: Levenshtein automata intersected with a lexicon trie.

The lexicon is learned from labelled rows: words, and stems with several
endings, whose occurrences are significantly toxic. Occurrences count once
for each distinct neighbourhood (word before, word after), so copies of one
text prove nothing by their number. The trie of the entries is walked together
with the Levenshtein automaton of the text's word, as one automaton that is
built as it is used: its states are sets of (trie node, edits), and the walk
ends at the first character that no entry allows. Stems match as prefixes,
without edits.

A match's weight is how often matches of that entry at that distance were
toxic in training. The window around it tells quotation (between quotation
marks on its line) from abuse; quotations weigh what training shows, half
without evidence. A text's score is the probability that at least one of its
distinct matches is abuse.

Training takes at most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled
documents, those whose ids hash lowest; every whole text is scored. Null and
empty texts score ``BASE``. Rows with null label or id don't train; without
training rows all score ``BASE``. Repeated rows score alike, empty tables give
no rows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope.llm.common import Remembered, in_worker, stored
from labelscope.llm.ppm_language import held_out

SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 6000
LEXICON = 4000                       # entries at most: the most significant
G2, PRECISION, STEM_ENDINGS = 25.0, 0.9, 5
STEMS = (4, 5, 6, 7, 8)
BASE, FLAG = 0.01, 0.3
#: Matches that were abuse less often than this in training count for nothing:
#: many chance matches in a long text are no evidence.
PLAUSIBLE = 0.5
WORD = r"[^\W_]+"
WINDOW = 80                          # characters on each side that are searched for quotation marks
OPEN, CLOSE = "\"“„«‹‘'", "\"”“»›’'"


class Entry(NamedTuple):
    term: str
    stem: bool


def edits(entry: Entry) -> int:
    """Edits that a match may have."""
    n = len(entry.term)
    return 0 if entry.stem or n < 5 else 1 if n < 9 else 2


class Automaton:
    """Trie of the lexicon times Levenshtein automaton, determinised lazily."""

    def __init__(self, lexicon: list[Entry], limit: int = 200_000):
        self.lexicon, self.limit = lexicon, limit
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most = [0]                              # edits that some entry below allows
        for i, entry in enumerate(lexicon):
            node = 0
            self.most[0] = max(self.most[0], edits(entry))
            for c in entry.term:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.child[node][c]
                self.most[node] = max(self.most[node], edits(entry))
            self.ends[node].append(i)
        self.reset()

    def reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: dict[tuple[int, str], int] = {}
        self.start = self._id({(0, 0)}, None)

    def _id(self, states: set, stem: int | None) -> int:
        """Name of the state; states reached by skipping entry characters are
        added, and of each node the fewest edits stay."""
        best: dict[int, int] = {}
        todo = list(states)
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            todo += [(n, e + 1) for n in self.child[node].values()]
        if stem is None:
            stem = next((i for n, e in best.items() if e == 0 for i in self.ends[n] if self.lexicon[i].stem), None)
        key = frozenset(best.items()) | {("stem", stem)}
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        after, stem = set(), None
        for node, e in self.sets[state]:
            if node == "stem":
                stem = e
                continue
            for x, n in self.child[node].items():
                after.add((n, e if x == c else e + 1))
            after.add((node, e + 1))
        return self._id(after, stem)

    def match(self, word: str) -> tuple[int, int] | None:
        """(entry, edits) with the fewest edits, then the first entry."""
        if len(self.next) > self.limit:
            self.reset()
        state, step = self.start, self.next
        for c in word:
            at = step.get((state, c))
            if at is None:
                at = step[state, c] = self._step(state, c)
            state = at
            if len(self.sets[state]) == 1 and ("stem", None) in self.sets[state]:
                return None
        found = []
        for node, e in self.sets[state]:
            if node != "stem":
                found += [(e, i) for i in self.ends[node] if not self.lexicon[i].stem and e <= edits(self.lexicon[i])]
            elif e is not None:
                found.append((0, e))
        return min(found)[::-1] if found else None


class Model:
    """Lexicon with weights: (entry, edits) -> probability of abuse."""

    def __init__(self, lexicon: list[Entry], weight: dict[tuple[int, int], float], quoted: float):
        self.lexicon, self.weight, self.quoted = lexicon, weight, quoted
        self.name = hashlib.sha256(json.dumps([lexicon, sorted(weight.items()), quoted]).encode()).hexdigest()

    def matcher(self) -> Remembered:
        return Remembered(Automaton(self.lexicon).match)

    def findings(self, text: str, known: Remembered) -> list[tuple[int, int, bool]]:
        """(entry, edits, quoted) of the matches in the text."""
        text = text.lower()
        known.trim()
        hits = {w: m for w in set(re.findall(WORD, text)) if (m := known[w])}
        if not hits:
            return []
        out = []
        for line in text.split("\n"):
            for m in re.finditer(WORD, line):
                if m[0] in hits:
                    before, after = line[max(0, m.start() - WINDOW):m.start()], line[m.end():m.end() + WINDOW]
                    out.append((*hits[m[0]], _inside(before, after)))
        return out

    def score(self, text: str, known: Remembered) -> float:
        clean, abuse = 1 - BASE, {}
        for entry, e, quoted in self.findings(text, known):
            w = self.weight[entry, e] * (self.quoted if quoted else 1)
            abuse[entry, e] = max(abuse.get((entry, e), 0), w)
        for w in abuse.values():
            clean *= 1 - w
        return 1 - clean if abuse else BASE


def _inside(before: str, after: str) -> bool:
    """An opening mark stands before without its closing one, which follows."""
    for o, c in zip(OPEN, CLOSE):
        if o == c:
            edge = rf"(?<!\w){re.escape(o)}" if o == "'" else re.escape(o)
            if len(re.findall(edge, before)) % 2 and c in after:
                return True
        elif before.rfind(o) > before.rfind(c) and c in after:
            return True
    return False


def _lowest(known: DataFrame) -> DataFrame:
    """The rows whose hash lies in the lowest ranges that hold each label
    value's sample, so that ranking never sorts all rows of a label in one
    task: it gets the sample and what else lies in its last range."""
    part = F.shiftright(F.xxhash64("doc_id"), 52)             # 4,096 ranges in the order of the hash
    counts = known.groupBy("toxic", part.alias("part")).count().collect()     # two rows a range at most
    keep = F.lit(False)
    for toxic, most in ((0, SAMPLE_CLEAN), (1, SAMPLE_TOXIC)):
        found = 0
        for last, n in sorted((r["part"], r["count"]) for r in counts if r["toxic"] == toxic):
            found += n
            if found >= most:
                keep = keep | ((F.col("toxic") == toxic) & (part <= last))
                break
        else:
            keep = keep | (F.col("toxic") == toxic)
    return known.filter(keep)


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of the sampled training rows, one for each distinct text."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic") \
        .filter(~held_out(F.col("doc_id"))).distinct()
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = _lowest(known).withColumn("r", F.row_number().over(order)) \
        .filter((F.col("r") <= SAMPLE_CLEAN) & ((F.col("toxic") == 0) | (F.col("r") <= SAMPLE_TOXIC))) \
        .select("doc_id", "toxic")
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN rows.
    return docs.select("doc_id", "text").filter("text is not null") \
        .join(F.broadcast(chosen), "doc_id").select("text", "toxic").dropDuplicates(["text"])


def _vocabulary(sample: DataFrame) -> DataFrame:
    """word, t, n: distinct neighbourhoods in toxic and in clean texts."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    one = sample.select("toxic", words.alias("w")).select("toxic", F.expr(
        "explode(transform(w, (x, i) -> struct(x as word, xxhash64(get(w, i - 1), x, get(w, i + 1)) as near)))"
    ).alias("x")).select("toxic", "x.word", "x.near").distinct()
    return one.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("n"))


def _significant(terms: DataFrame, all_t: float, all_n: float) -> DataFrame:
    """Terms with their G2 against equal shares of toxic occurrences."""
    share = all_t / (all_t + all_n)
    part = lambda x, e: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / ((F.col("t") + F.col("n")) * e))) \
        .otherwise(0.0)
    return terms.withColumn("g2", 2 * (part("t", share) + part("n", 1 - share))) \
        .filter((F.col("g2") >= G2) & (F.col("t") >= PRECISION * (F.col("t") + F.col("n"))))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    sample = stored(training_sample(docs, labels), "toxic_sample")
    vocabulary = stored(_vocabulary(sample), "toxic_words")
    all_t, all_n = vocabulary.agg(F.sum("t"), F.sum("n")).first()
    if not all_t or not all_n:
        return None
    stems = [vocabulary.filter(F.length("word") >= k).groupBy(F.substring("word", 1, k).alias("word")).agg(
        F.sum("t").alias("t"), F.sum("n").alias("n"), F.max("t").alias("top"),
        F.sum((F.col("t") > 0).cast("int")).alias("endings")) for k in STEMS]
    whole = vocabulary.filter(F.length("word") >= 3).withColumns({"top": F.lit(0).cast("long"),
                                                                  "endings": F.lit(0).cast("long")})
    terms = whole.withColumn("stem", F.lit(False))
    for s in stems:
        terms = terms.unionByName(s.filter((F.col("endings") >= STEM_ENDINGS) & (2 * F.col("top") < F.col("t")))
                                  .withColumn("stem", F.lit(True)))
    found = _significant(terms, all_t, all_n).orderBy(F.desc("g2"), "word", "stem").limit(LEXICON).collect()
    stems_, lexicon = [], []
    for r in sorted(found, key=lambda r: (not r.stem, len(r.word), r.word)):
        if not any(r.word.startswith(s) for s in stems_):     # a shorter stem says it already
            lexicon.append(Entry(r.word, r.stem))
            stems_ += [r.word] * r.stem
    weights = {(i, e): 0.0 for i, entry in enumerate(lexicon) for e in range(edits(entry) + 1)}

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Automaton(lexicon).match
        for b in batches:
            rows = [(*m, t, n) for w, t, n in zip(*(c.to_pylist() for c in b.columns)) if (m := match(w))]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)],
                                             names=["entry", "e", "t", "n"])

    # Clean texts are sampled more thinly or thickly than toxic ones: weigh them back.
    count = {r[0]: r[1] for r in labels.filter("toxic in (0, 1)").groupBy("toxic").count().collect()}
    used = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    scale = (count[0] / used[0]) / (count[1] / used[1])
    evidence = vocabulary.select("word", "t", "n").mapInArrow(matched, "entry long, e long, t long, n long") \
        .groupBy("entry", "e").agg(F.sum("t"), F.sum("n")).collect()      # at most three rows an entry
    for key in weights:
        weights[key] = 0.8 - 0.1 * key[1]                    # no such match in training
    for i, e, t, n in evidence:
        weights[i, e] = (t + 2 * (0.8 - 0.1 * e)) / (t + scale * n + 2)
    weights = {k: w if w >= PLAUSIBLE else 0.0 for k, w in weights.items()}
    model = Model(lexicon, weights, 0.5)

    def quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.matcher()
        for b in batches:
            rows = []
            for text, toxic in zip(*(c.to_pylist() for c in b.columns)):
                found = model.findings(text, known)
                if found and all(q for _, _, q in found):
                    rows.append(toxic)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64())], names=["toxic"])

    t, k = sample.select("text", "toxic").mapInArrow(quotes, "toxic long").agg(F.sum("toxic"), F.count("toxic")).first()
    return Model(lexicon, weights, ((t or 0) + 1) / (k + 2))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = in_worker(f"terms of {model.name}", model.matcher)
        for batch in batches:
            scores = [model.score(t.as_py(), known) if t.is_valid else BASE for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())],
                                             names=["doc_id", "held_out", "score"])

    out = d.withColumn("score", F.lit(BASE)).drop("text") if model is None \
        else d.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= FLAG).cast("int"))
