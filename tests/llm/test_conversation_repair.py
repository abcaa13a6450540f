"""op12 against exhaustive edits, and whole tables against a row-by-row search."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from labelscope.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, mark string, no long, at long"
LEGAL = re.compile(r"(s?(ua)+)?")


def exhaustive(symbols):
    """Least (cost, audit) over every choice of edits with at most two inserts a gap."""
    gaps, best = ["", "u", "a", "ua", "au"], None
    options = [[("D", "", 4)] if x == "d" else
               [("D", "", 4), ("K", x.lower(), 3 * x.isupper()), ("R", "u", 3 + 3 * x.isupper()),
                ("R", "a", 3 + 3 * x.isupper())] for x in symbols]
    for edits in itertools.product(*options):
        for put in itertools.product(gaps, repeat=len(symbols) + 1):
            roles = put[0] + "".join(e[1] + p for e, p in zip(edits, put[1:]))
            if LEGAL.fullmatch(roles):
                audit = "I" * len(put[0]) + "".join(e[0] + "I" * len(p) for e, p in zip(edits, put[1:]))
                found = (sum(e[2] for e in edits) + 3 * audit.count("I"), audit)
                best = found if best is None else min(best, found)
    return best


def search(rows):
    """Least (cost, audit) and its lines by best-first search over (rows used, last letter)."""
    todo, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, lines = heapq.heappop(todo)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, lines
        if (i, last) in done:
            continue
        done.add((i, last))

        def add(c, letter, used, role, text=""):
            first = role[:1]
            if first == {"": "u", "s": "u", "u": "a", "a": "u"}[last] or (first == "s" and last == ""):
                heapq.heappush(todo, (cost + c, audit + letter, i + used, first, (*lines, f"{role}:{text}")))

        for name in ("user", "assistant"):
            add(3, "I", 0, name)
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(todo, (cost + 4, audit + "D", i + 1, last, lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                add(more, "K", 1, role, text)
                for name in ("user", "assistant"):
                    add(3 + more, "R", 1, name, text)


def by_hand(table):
    """conv_id -> result, row by row."""
    of = {}
    for conv_id, turn, role, text in table:
        rows = of.setdefault(conv_id, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind:
            row = (turn, "user" if kind == 4 else role,
                   "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            rows += [row] * (2 if kind == 3 else 1)
    out = {}
    for conv_id, rows in of.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged = set(), []
        for _, role, text in rows:
            kept = text.rstrip("\t\n\x0b\x0c\r ")
            fault = ("blank" if not kept else "duplicate" if (role, text) in seen
                     else "truncated" if kept[-1] not in ".!?" else None)
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = {t for t, _, _ in rows if t is not None}
        cost, audit, lines = search(judged)
        n = [sum(f == x for _, _, f in judged) for x in ("blank", "duplicate", "truncated")]
        bad = sum((a[0][:1], b[0][:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(judged, judged[1:]))
        out[conv_id] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n, bad, cost, audit,
                        hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(seed, conversations=60, long=()):
    r = random.Random(seed)
    rows = []
    for c in range(conversations):
        n = dict(long).get(c, r.randrange(1, 7))
        for t in range(n):
            role = r.choice(["user", "assistant"] if t or r.random() < .6 else ["system"]) if r.random() < .85 else r.choice(
                ["system", "tool", "", None, "User", "admin"])
            text = r.choice([f"Words {c} {t}.", "Same.", "Same.", "cut off", " \t", None, "Line\nline?", "x!", "é ü…"])
            turn = t if r.random() < .9 else r.choice([None, t - 1, t + 3, -2])
            rows.append((c, turn, role, text))
    rows += [(None, 0, "user", "a."), (None, None, "assistant", "b."), (None, 2, "user", "a.")]
    rows += [(1000, t, "user", "dropped.") for t in range(2000) if zlib.crc32(f"1000:{t}".encode()) % 20 == 0][:3]
    rows += [rows[0]] * 2                                    # repeated rows
    r.shuffle(rows)
    return rows


def results(spark, rows, grammar=None):
    conv = spark.createDataFrame([(*x, "clash", 1, 2) for x in rows], SCHEMA)
    got = R.repair(conv, grammar).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r[1:]) for r in got}


def test_matrices_against_exhaustive_edits():
    g = R.Grammar([("1", "u", "a"), ("2", "1", "1"), ("3", "d", "U"), ("4", "a", "a")])
    for n in range(4):
        for symbols in itertools.product("dsuaxSUAX", repeat=n):
            if n < 3 or hash(symbols) % 9 == 0:
                assert g.cheapest("".join(symbols)) == exhaustive("".join(symbols)), symbols
    r = random.Random(1)
    plain = R.Grammar([])
    for _ in range(60):
        s = "".join(r.choice("dsuaxSUAXuaua") for _ in range(40))
        assert g.cheapest(s) == plain.cheapest(s) == R.best_end(
            R.product(plain.of(s[:17]), g.of(s[17:])))


def test_table_against_search(spark):
    rows = made(3)
    assert results(spark, rows) == by_hand(rows)


def test_long_conversations_in_chunks(spark, monkeypatch):
    # Turns beyond 1,024 lie in other blocks; many equal turns make several chunks of a block.
    rows = made(5, 12, long=((3, 2500), (7, 1300)))
    rows += [(500, 0, r, f"t {i}.") for i, r in enumerate(["user", "assistant"] * 700)]
    rows += [(501, 5 * 10 ** 9, "user", "far."), (501, -7, "assistant", "near.")]
    rows += [(502, 0, "user", "x" * 300_000 + "."), (502, 1, "assistant", "y " * 100_000)]
    assert results(spark, rows) == by_hand(rows)


def test_grammar_and_empty(spark):
    rows = made(8)
    conv = spark.createDataFrame([(*x, "clash", 1, 2) for x in rows], SCHEMA)
    g = R.learn(R.chunks(conv), rules=12, per_round=5)
    assert 0 < len(g.rules) <= 12
    seqs = [r.symbols for r in R.chunks(conv).collect()]
    assert sum(len(g.parse(s)) for s in seqs) < sum(map(len, seqs))
    assert results(spark, rows, g) == results(spark, rows, R.Grammar([]))
    assert R.repair(conv.limit(0)).count() == 0


@pytest.mark.parametrize("rule", ["ua", "aa", "dd"])
def test_rule_matrix_is_the_product(rule):
    g = R.Grammar([("1", *rule)])
    spelled = lambda m: {k: (c, str(r)) for k, (c, r) in m.items()}
    assert spelled(g.matrix["1"]) == spelled(R.product(g.matrix[rule[0]], g.matrix[rule[1]]))


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    got = R.repair(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").withColumn("no", F.lit(1))).collect()
    assert {r.conv_id: tuple(r[1:]) for r in got} == by_hand(rows)
