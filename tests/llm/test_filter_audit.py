"""op11 against a brute-force audit: every order applied filter by filter."""

import itertools
import re


from labelscope.llm import filter_audit

DOCS = "doc_id long, text string, lang string, source string, part string, mask int, n long, step int"
LABELS = "doc_id long, quality int, toxic int, part string"

LONG = " ".join(f"w{i}" for i in range(30_000))
TEXTS = [
    (1, "a b c", "en"), (2, "a b c", "en"), (3, "a b c", "fr"), (4, None, "en"), (5, "", "de"), (6, "HELLO WORLD #1", None),
    (7, " ".join(f"w{i}" for i in range(250)), "en"), (8, "same " * 300, "en"), (9, "same " * 300, None), (10, LONG, "fr"),
    (11, LONG, "fr"), (12, "x|y " * 210, "de"), (None, "a b c", "en"), (None, LONG, "xx"), (2, "a b c", "en"),
    (13, "\x0b\x0c \r\n", "en"), (14, "É À Ü", "en"), (15, " ".join(f"Aa{i}" for i in range(220)), "en"),
]
MARKS = [(1, 1, 0), (1, 0, 1), (3, 0, 1), (7, 1, 0), (10, 1, 1), (11, 1, None), (12, None, 1), (None, 1, 1), (99, 1, 1),
         (11, 1, None)]


def brute(texts, marks):
    good = {d for d, q, _ in marks if q == 1 and d is not None}
    toxic = {d for d, _, t in marks if t == 1 and d is not None}
    rows = []
    for d, text, lang in texts:
        text, w = text or "", [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
        first = min((e for e, t, _ in texts if (t or "") == text and e is not None), default=None)
        fails = {x for x, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            bool(re.search(r"[#$%&*|]", text)), d is not None and d > first)) if bad}
        rows.append((lang or "", fails, d in good, d in toxic))
    out, removed = {}, {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            for step, x in enumerate(order, 1):
                out_now = [r for r in left if x in r[1]]
                mine = [r for r in rows if r[0] == part and x in r[1]]
                left = [r for r in left if x not in r[1]]
                removed[part, x] = removed.get((part, x), 0) + len(out_now)
                out[part, order, step] = (len(left), len(out_now), len(mine) - len(out_now),
                                          sum(r[1] == {x} for r in mine), sum(r[2] for r in out_now),
                                          sum(r[3] for r in out_now))
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_every_order(spark):
    docs = spark.createDataFrame([(d, t, x, "s", "clash", 7, 7, 7) for d, t, x in TEXTS], DOCS)
    labels = spark.createDataFrame([(*m, "clash") for m in MARKS], LABELS)
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in filter_audit.audit(docs, labels).collect()}
    assert got == brute(TEXTS, MARKS)


def test_empty_tables_and_other_filters(spark):
    docs = spark.createDataFrame([(d, t, x, "s", "clash", 7, 7, 7) for d, t, x in TEXTS], DOCS)
    labels = spark.createDataFrame([(*m, "clash") for m in MARKS], LABELS)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    none = filter_audit.audit(docs, labels.limit(0)).collect()
    assert len(none) == 120 * 5 * 5 and not any(r.good_lost or r.toxic_lost for r in none)
    two = filter_audit.audit(docs, labels, {"X": "words = 0", "Y": "repeated"}, part="source").collect()
    assert sorted((r.filter_order, r.step, r.kept, r.removed) for r in two) == [
        ("XY", 1, 15, 3), ("XY", 2, 10, 5), ("YX", 1, 12, 6), ("YX", 2, 10, 2)]
