"""Quality rules by weak supervision, in DataFrame expressions only.

Each rule votes good (1), bad (-1) or abstains (0). The documents' vote
patterns (at most 3 to the number of rules) are counted; expectation
maximisation over those counts estimates how often each rule is right and how
common good documents are, and gives every pattern its posterior probability
of a good document. A document is kept if that is at least ``KEEP`` and the
base limits hold.

Nulls: a null text has no words, fails the base limits and is not kept. Empty
tables give empty results. Repeated rows are judged alike. Other columns are
ignored; ``filter_quality`` returns the input's columns unchanged.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import stored, word_array

SYMBOLS = "#*$%&|<>"
KEEP = 0.5
EM_ROUNDS = 30
#: Where the estimation starts: the share of good documents, and how often a
#: rule votes bad, abstains or votes good on good and on bad documents.
PRIOR, VOTES_GOOD, VOTES_BAD = 0.8, (0.02, 0.18, 0.8), (0.3, 0.3, 0.4)
_P = "__llm_q_"                      # prefix of working columns


def _c(name: str) -> Column:
    return F.col(_P + name)


def _rule(good: str, bad: str) -> Column:
    text = lambda s: s.replace("@", _P)
    return F.when(F.expr(text(bad)), F.lit(-1)).when(F.expr(text(good)), F.lit(1)).otherwise(F.lit(0))


#: name -> (votes good if, votes bad if), else it abstains; @x is the working
#: column x. Rules that look for one kind of junk never vote good.
RULES = {
    "length": ("@n_words >= 80", "@n_words < 20"),
    "word_length": ("@word_chars between 3 * @n_words and 9 * @n_words",
                    "@word_chars < 2 * @n_words or @word_chars > 14 * @n_words"),
    "prose": ("100 * @n_symbols <= 3 * @n_words and 10 * @n_upper <= 2 * @word_chars"
              " and 100 * @n_repeat_words <= 30 * @n_words and @n_marks > 0", "@n_words = 0"),
    "symbols": ("false", "100 * @n_symbols > 10 * @n_words"),
    "dup_lines": ("false", "2 * @n_dup_lines > @n_lines"),
    "repeats": ("false", "100 * @n_repeat_words > 30 * @n_words"),
    "capitals": ("false", "10 * @n_upper > 4 * @word_chars"),
    "marks": ("false", "100 * @n_marks > 80 * @n_words"),
}


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def with_measures(docs: DataFrame) -> DataFrame:
    """Working columns of counts for every row; other columns stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    has_word = lambda line: F.size(word_array(line)) > 0
    d = docs.withColumns({_P + "w": word_array(F.col("text")),
                          _P + "lines": F.filter(F.split(text, "\n"), has_word),
                          _P + "n_symbols": _count(text, "[" + re.escape(SYMBOLS) + "]"),
                          _P + "n_upper": _count(text, r"\p{Lu}"),
                          _P + "n_marks": _count(text, "[.,;:!?]")})
    d = d.withColumns({_P + "n_words": F.size(_P + "w").cast("long"),
                       _P + "word_chars": F.length(F.array_join(_P + "w", "")).cast("long"),
                       _P + "n_lines": F.size(_P + "lines").cast("long"),
                       _P + "n_dup_lines": (F.size(_P + "lines")
                                            - F.size(F.array_distinct(_P + "lines"))).cast("long"),
                       _P + "g": F.transform(_P + "w", lambda x: F.xxhash64(x))})
    # Names of the 3-word windows in order; if some are equal, each name with
    # its position in the low bits, sorted: equal ones are then neighbours.
    g = F.col(_P + "g")
    d = d.withColumn(_P + "h", F.when(F.size(g) >= 3, F.transform(
        F.slice(g, 1, F.size(g) - 2), lambda x, i: F.xxhash64(x, F.get(g, i + 1), F.get(g, i + 2)))))
    h, bits = F.col(_P + "h"), F.col(_P + "bits")
    d = d.withColumn(_P + "bits", F.ceil(F.log2(F.size(h) + 1.0)).cast("int"))
    d = d.withColumn(_P + "s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(
        h, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long"))))))
    s = F.col(_P + "s")
    top = lambda x: F.call_function("shiftright", x, bits)
    at = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")
    twin = lambda x, y: (top(x) == top(y)) & (F.get(h, at(x)) == F.get(h, at(y)))
    d = d.withColumn(_P + "at", F.sort_array(F.transform(F.filter(
        s, lambda x, k: F.coalesce(twin(x, F.get(s, k - 1)), F.lit(False))
        | F.coalesce(twin(x, F.get(s, k + 1)), F.lit(False))), at)))
    p = F.col(_P + "at")
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(
        F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    d = d.withColumn(_P + "n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    d = d.withColumn(_P + "base_failed", (_c("n_words") < 50)
                     | (100 * _c("n_repeat_words") > 50 * _c("n_words")))
    votes = F.lit(0)
    for good, bad in RULES.values():
        votes = votes * 3 + _rule(good, bad) + 1
    return d.withColumn(_P + "votes", votes).drop(
        *(_P + x for x in ("w", "g", "lines", "h", "bits", "s", "at")))


def posteriors(counts: DataFrame, rounds: int = EM_ROUNDS) -> DataFrame:
    """(votes, posterior) from (votes, n) by expectation maximisation.

    Each rule has one distribution of its vote (bad, abstains, good) on good
    documents and another on bad ones. ``counts`` are at most
    3 ** len(RULES) patterns; they are one row here, and the rounds run in one
    expression over it."""
    k = len(RULES)
    digits = ", ".join(f"cast(pmod(floor(votes / {3 ** (k - 1 - j)}), 3) - 1 as int)" for j in range(k))
    one = counts.groupBy().agg(F.expr(
        f"array_sort(collect_list(struct(votes, cast(n as double) as n, array({digits}) as v)))").alias("p"))
    post = """1 / (1 + exp(-(s.prior + aggregate(
        zip_with(x.v, s.says, (v, a) -> a[v + 1]), 0D, (t, y) -> t + y))))"""
    # says: log of how much likelier each vote is on a good than on a bad document.
    says = ", ".join(f"ln({g} / {b})" for g, b in zip(VOTES_GOOD, VOTES_BAD))
    start = (f"named_struct('prior', ln({PRIOR} / (1 - {PRIOR})), "
             f"'says', array_repeat(array({says}), {k}))")
    total = lambda start, e: f"aggregate(q, {start}, (t, x) -> t + x.n * {e})"
    share = lambda g: f"{total('1D', f'if(x.v[j] = u, {g}, 0D)')} / {total('3D', g)}"
    step = f"""(s, i) -> transform(array(transform(p, x -> named_struct('n', x.n, 'v', x.v, 'g', {post}))),
        q -> named_struct(
          'prior', ln({total('1D', 'x.g')} / {total('1D', '(1 - x.g)')}),
          'says', transform(sequence(0, {k - 1}), j -> transform(sequence(-1, 1),
              u -> ln(({share('x.g')}) / ({share('(1 - x.g)')}))))))[0]"""
    fitted = one.select("p", F.expr(f"aggregate(sequence(1, {rounds}), {start}, {step})").alias("s"))
    return fitted.select("s", F.explode("p").alias("x")).select(
        F.expr("x.votes").alias("votes"), F.expr(post).alias("posterior"))


def _counted(d: DataFrame) -> DataFrame:
    return d.groupBy(F.col(_P + "votes").alias("votes")).agg(F.count(F.lit(1)).alias("n"))


def _verdict(d: DataFrame, counts: DataFrame) -> DataFrame:
    post = posteriors(counts).select(F.col("votes").alias(_P + "votes"),
                                     F.col("posterior").alias(_P + "posterior"))
    d = d.join(F.broadcast(post), _P + "votes")   # at most 3 ** len(RULES) rows
    return d.withColumn(_P + "kept", ~_c("base_failed") & (_c("posterior") >= KEEP))


def quality(docs: DataFrame) -> DataFrame:
    """A row for each document: measures, verdict and posterior. The measures
    are stored, so the texts are read once."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
             "kept", "posterior")
    d = stored(with_measures(docs.select("doc_id", "text")).drop("text"), "measures")
    return _verdict(d, _counted(d)).select("doc_id", *(_c(x).alias(x) for x in names))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the input's columns. The texts are
    measured twice, once for the counts, rather than stored or shuffled."""
    counts = _counted(with_measures(docs.select("text")))
    # The row number keeps the optimizer from pushing the filter below the
    # measures, which would write their expressions out again and again.
    d = with_measures(docs).withColumn(_P + "id", F.monotonically_increasing_id())
    return _verdict(d, counts).filter(_c("kept") & (_c("id") >= 0)).select(*docs.columns)
