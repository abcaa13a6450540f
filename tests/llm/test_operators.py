"""The operators on small tables: brute force, edge cases, invariants."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from labelscope.llm import (binary_packing, common, edit_leaks, line_join, odd_minhash, ppm_language, queries,
                            recompression, token_counts, toxicity, url_filter, weak_rules)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row long, node string"


def words(n, seed, vocabulary=40):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    base = " ".join(words(120, 1, 500))
    near = base.split()
    near[60] = "other"
    run = " ".join(["same"] * 90)
    return {
        1: base, 2: base, 3: " ".join(near), 4: "", 5: None, 6: " \n\t ", 7: "one", 8: "one", 9: run,
        10: run + " tail", 11: " ".join(words(80, 2, 500)) + "\n" + base, 12: "a b\n" * 60,
        13: " ".join(words(40, 3, 500)) + " " + " ".join(words(40, 3, 500)),
        14: "line one is here today now ok\nline one is here today now ok yes\nshort", 15: "x" * 5000,
        16: " ".join(words(3000, 4)), 17: base.upper(), 18: "é ü ß \x1c ünd ﬁ ΑΣ 12ab can't!! <|endoftext|> 字字",
    }


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "kept", 1, "x") for i, t in texts.items()]
    rows += [rows[0], (None, "nobody owns this", None, None, None, None, None, None)]     # a repeated row, null id
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return (t or "").encode().split()


def test_near_dedup_against_all_pairs(docs, none, texts):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = []
    for _, t in rows:
        w = split(t and "".join(c.lower() if c.isascii() else c for c in t))
        sets.append({tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    comp = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    want = sorted((str(rows[a][0]), len(sets[a]), str(min((rows[b][0] for b in range(len(rows))
                   if comp[b] == comp[a] and rows[b][0] is not None), default=None))) for a in range(len(rows)))
    got = odd_minhash.groups(docs, 4).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert odd_minhash.groups(none).count() == 0
    left = odd_minhash.drop_copies(docs, 4)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(1) == 1 and not {2, 3, 17, 8} & set(ids) and {4, 5, 6, 7, None} <= set(ids)


def test_odd_sketch_estimates():
    rng = np.random.default_rng(0)
    names = common.mix(rng.integers(0, 1 << 62, 1000, np.uint64))
    for shared in (950, 800):
        a, b = names[:shared + (1000 - shared) // 2], np.concatenate([names[:shared], names[-((1000 - shared) // 2):]])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x = np.bitwise_xor(*(odd_minhash.odd_sketch(odd_minhash.samples(s)) for s in (a, b)))
        k, n = odd_minhash.BANDS * odd_minhash.ROWS, odd_minhash.BITS
        bits = int(np.unpackbits(x.view(np.uint8)).sum())
        assert abs(1 + np.log(1 - 2 * bits / n) * n / (4 * k) - j) < 0.12


def test_packing(docs, none, texts):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(binary_packing.tokenizer_path())
    out = binary_packing.pieces(docs).collect()
    assert len({r.sequence_id for r in out}) == len(out)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 for r in out)
    for i, t in texts.items():
        ids = tk.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)[::2 if i == 1 else 1]
        got = np.concatenate([np.frombuffer(r.ids, "<u4") for r in mine])
        assert got.tolist() == ids, i
        assert all(zlib.crc32(r.ids) == r.ids_crc32 and r.doc_tokens == len(ids) for r in mine)
        assert [r.start for r in mine] == np.cumsum([0] + [r.length for r in mine])[:-1].tolist()
    assert binary_packing.pieces(none).count() == 0
    assert binary_packing.piece_lengths(5000) == [2048, 2048, 512, 256, 128, 8]


def test_packing_shortcut_letters():
    from tokenizers import Tokenizer
    path = binary_packing.tokenizer_path()
    tk, known = Tokenizer.from_file(path), binary_packing.WordTokens(path)
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    assert "\u0130" in letters
    for c in letters:
        for word in (c, f"{c}stanbul,", f"D{c}YARB{c}", f"ab{c}!?"):
            assert np.frombuffer(known[word.encode()], "<u4").tolist() == tk.encode(word, add_special_tokens=False).ids, word



def test_packing_holds_a_bounded_number_of_words():
    """A worker's memory does not grow with the words that it has read."""
    from tokenizers import Tokenizer
    path = binary_packing.tokenizer_path()
    tk, known = Tokenizer.from_file(path), binary_packing.WordTokens(path)
    want = lambda w: tk.encode(w.decode(), add_special_tokens=False).ids
    assert 2 * (known.limit + known.parts.limit) <= 500_000
    rare = [f"Q{chr(97 + i // 676 % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}xw,".encode() for i in range(3000)]
    for word in rare:
        known[word]
    assert len(known) == 0                             # words that came once
    known = binary_packing.WordTokens(path)
    known.limit = known.parts.limit = 200
    for _ in range(2):
        for i, word in enumerate([*rare, *(w[:-1] for w in rare), *(b"%d" % i for i in range(3000))]):
            assert i % 7 or np.frombuffer(known[word], "<u4").tolist() == want(word)
            known[word]
            if i % 100 == 0:
                known.trim()
                assert sum(map(len, (known, known.old, known.parts, known.parts.old))) <= 4 * 300
    for long in (b"a" * 5000, b"7#" * 3000, b"b" * 5000 + b"!"):
        for _ in range(3):
            assert np.frombuffer(known[long], "<u4").tolist() == want(long)
        assert long not in known and not any(len(p) > binary_packing.LONGEST for p in known.parts)


def test_url_filter(spark):
    urls = ["http://A.Example.com/en/1?b=2&utm_source=x#f", "https://example.com/en/", "http://www.example.com/en/q",
            "http://x.net/es/1", "http://x.org/p.html", "http://www.x.org/p/?ref=1", "http://x.org/q", None, "nothing",
            "http://example.com", "ftp://b.org?x=1", "http://notexample.com/en/"]
    pages = spark.createDataFrame([(i, u, "", 1, True) for i, u in enumerate(urls)] + [(0, urls[0], "", 1, True)],
                                  "page_id long, url string, host string, block int, maybe boolean")
    listed = spark.createDataFrame([("x.org/p",), ("a.example.com/en/1?b=2",), (None,), ("x.org/p",)], "canonical string")
    got = {r.page_id: r for r in url_filter.judge(pages, listed).collect()}
    assert [got[i].verdict for i in range(12)] == ["block", "block", "allow", "block", "block", "block", "allow",
                                                   "allow", "allow", "allow", "allow", "allow"]
    assert [got[i].rule for i in (0, 2, 3, 4, 11)] == ["example.com/en/", "www.example.com/en/", "net/es/", None, "com/"]
    assert (got[0].host, got[0].path, got[9].path, got[10].host) == ("a.example.com", "/en/1", "", "b.org")
    assert url_filter.judge(pages, listed).count() == 13
    assert url_filter.judge(pages.limit(0), listed).count() == 0
    assert url_filter.judge(pages, listed.limit(0)).filter("verdict = 'block' and rule is null").count() == 0


def test_bloom_never_loses(spark):
    keys = spark.range(0, 5000, 7).select(F.col("id").alias("k"))
    all_ = spark.range(5000).select(F.col("id").alias("k"))
    got = common.likely(all_, "k", keys)
    assert got.join(keys, "k").count() == keys.count() and got.count() < 1200


def test_edit_leaks(spark, none):
    rnd = random.Random(5)
    item = "".join(rnd.choice("abcdefgh ") for _ in range(200)).strip()
    k = edit_leaks.budget(edit_leaks.normal(item))

    def edited(n):
        t = list(edit_leaks.normal(item))
        for at in rnd.sample(range(len(t)), n):
            t[at] = rnd.choice(["", "z", t[at] + "q"])
        return "before it " + "".join(t) + " and after"
    rows = [(1, "x " + item.upper() + " y"), (2, edited(k)), (3, edited(4 * k)), (4, None), (5, ""), (6, item[:90]),
            (7, item.replace(" ", "\n  ")), (None, item)]
    d = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, item_id string, edits int")
    b = spark.createDataFrame([(10, item), (11, item), (12, None), (None, item), (13, "short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in edit_leaks.leaks(d, b).collect()}
    assert {x for x, _ in got} == {1, 2, 7, None} and got[1, 10] == got[1, 11] == 0 and 0 < got[2, 10] <= k
    assert sorted(str(r.doc_id) for r in edit_leaks.clean(d, b).collect()) == ["3", "4", "5", "6"]
    assert edit_leaks.clean(d, b).columns == d.columns
    assert edit_leaks.leaks(none, b).count() == 0 and edit_leaks.leaks(d, b.limit(0)).count() == 0
    assert len(list(edit_leaks.blocks(b, 250))) == 2

    for _ in range(300):
        p, t = ("".join(rnd.choice("abc") for _ in range(rnd.randint(lo, 14))) for lo in (1, 0))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, e in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
            row = new
        assert edit_leaks.least_edits(p, t)[0] == min(row)


def test_edit_leaks_short_items(spark):
    b = spark.createDataFrame([(1, "Capital of  Peru"), (2, "lima"), (3, "1,024"), (4, " \n"), (5, "リマ"), (6, "exactly 23 characters x")],
                              "item_id long, text string")
    rows = ["the capital\nof peru is", "a capital of perugia, then the capital of peru", "Lima", "limas, colima, lima\u0301",
            "(lima)", "it is 1,024.", "11,024 1,0240", "", "首都はリマです", "xx exactly 23 characters x", "exactly 23 character x"]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.edits, r.allowed, r.found_to) for r in edit_leaks.leaks(d, b).collect()}
    assert set(got) == {(0, 1), (1, 1), (2, 2), (4, 2), (5, 3), (8, 5), (9, 6)}
    assert got[1, 1] == (0, 0, len(rows[1])) and got[4, 2] == (0, 0, 5)
    assert sorted(r.doc_id for r in edit_leaks.clean(d, b).collect()) == [3, 6, 7, 10]


def test_edit_leaks_block_after_block(spark, monkeypatch):
    rnd = random.Random(8)
    items = [(i, " ".join(words(12, 50 + i, 900))) for i in range(5)]
    d = spark.createDataFrame([(i, f"so {' '.join(t for _, t in rnd.sample(items, i % 4))} it is") for i in range(16)]
                              + [(99, None)], "doc_id long, text string").repartition(1)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, j) for i, t in d.collect() for j, x in items if t and x in t}
    written = []

    def stored(df, name):
        written.append((name, common.stored(df, name)))
        return written[-1][1]
    monkeypatch.setattr(edit_leaks, "stored", stored)
    assert len(list(edit_leaks.blocks(b, 60))) == 5
    found = edit_leaks.leaks(d, b, most=60)
    assert [n for n, _ in written] == ["leaks"] * 4 and all(x.count() for _, x in written)
    assert str(found._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1      # one block is left to search
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and found.count() == len(want)
    kept = edit_leaks.clean(d, b, most=60)
    assert str(kept._jdf.queryExecution().executedPlan()).count("ArrowEvalPython") == 1
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in d.collect()} - {i for i, _ in want}
    for name in "ab":
        edit_leaks._latest(name, lambda: edit_leaks.Block(items))
    assert list(common.in_worker("leaks", dict)) == ["b"]


def test_language_codes_and_accuracy(spark, docs, none):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    trees = ppm_language.train(d)
    got = ppm_language.predict(d, trees).join(d.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang_pred = lang").count() >= 0.9 * got.count()
    # The code length, symbol by symbol with explicit escapes.
    tables, text = trees.tables(), "Das üb %% nicht the qué".encode()
    symbols = [int(trees.symbol[32])] * 3 + [int(x) for x in trees.symbol[ppm_language._folded(text)]]
    for j, lang in enumerate(trees.langs):
        seen = {}
        for code, n in zip(*trees.runs[lang]):
            run = [int(code) >> 6 * i & 63 for i in (3, 2, 1, 0)]
            for order in range(4):
                follow = seen.setdefault(tuple(run[3 - order:3]), {})
                follow[run[3]] = follow.get(run[3], 0) + int(n)
        bits = 0.0
        for at in range(3, len(symbols)):
            for order in (3, 2, 1, 0, -1):
                if order < 0:
                    bits += 6
                    break
                follow = seen.get(tuple(symbols[at - order:at]), {})
                total = sum(follow.values()) + len(follow)
                if symbols[at] in follow:
                    bits -= np.log2(follow[symbols[at]] / total)
                    break
                bits -= np.log2(len(follow) / total) if follow else 0
        assert abs(trees.lengths(text, tables)[j] - bits) < 1e-2
    out = {r.doc_id: r for r in ppm_language.predict(docs, trees).collect()}
    assert out[5].lang_pred == out[4].lang_pred == out[6].lang_pred == "und" and out[1].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in out.values())
    assert ppm_language.predict(none, trees).count() == 0 and ppm_language.train(none) is None
    assert {r.lang_pred for r in ppm_language.predict(docs, None).collect()} == {"und"}


def test_language_of_long_texts_only(spark):
    speak = lambda letters, n: " ".join(random.Random(n).choices([a + b for a in letters for b in letters], k=n))
    rows = [(i, "long" if i % 2 else "short", speak("abcde" if i % 2 else "vwxyz", 9000 + i if i % 2 else 50 + i))
            for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert min(len(t) for _, k, t in rows if k == "long") > ppm_language.SAMPLE_CHARS
    sample = ppm_language.training_sample(d).collect()
    assert max(len(r.text) for r in sample) == ppm_language.SAMPLE_CHARS
    trees = ppm_language.train(d)
    assert trees.langs == ["long", "short"]
    assert ppm_language.predict(d, trees).join(d, "doc_id").filter("lang_pred <> lang").count() == 0


def test_language_bytes_beyond_the_common_ones():
    rnd = random.Random(4)
    speak = lambda letters, n: " ".join("".join(rnd.choices(letters, k=5)) for _ in range(n)).encode()
    letters = {"a": "абвгд", "b": "ежзик", "c": "शषसहळ", "d": "रलवयम"}
    ascii_ = bytes(c for c in range(32, 127) if not 65 <= c <= 90)           # 69 bytes, the commonest
    trees = ppm_language.Trees({"_": [ascii_ * 5000], **{k: [speak(v, 200)] for k, v in letters.items()}})
    assert all(trees.symbol[x] == 63 for v in letters.values() for x in v.encode())
    tables = trees.tables()
    for k, v in letters.items():
        for _ in range(5):
            assert trees.langs[int(np.argmin(trees.lengths(speak(v, 3), tables)))] == k
    # The bits of the bytes without a symbol, one by one with explicit escapes.
    text = ppm_language._folded("абж ख ह~ é".encode())
    plain = [32] * 3 + [int(x) for x in text]
    code = trees.other_codes(text)
    assert len(code) == sum(trees.symbol[x] == 63 for x in text)
    for j, lang in enumerate(trees.langs):
        seen, bits = {}, 0.0
        for run, n in zip(*trees.others[lang]):
            run = int(run).to_bytes(4, "big")
            for order in range(4):
                follow = seen.setdefault(run[3 - order:3], {})
                follow[run[3]] = follow.get(run[3], 0) + int(n)
        for at in range(3, len(plain)):
            if trees.symbol[plain[at]] != 63:
                continue
            for order in (3, 2, 1, 0, -1):
                if order < 0:
                    bits += np.log2(193)
                    break
                follow = seen.get(bytes(plain[at - order:at]), {})
                total = sum(follow.values()) + len(follow)
                if plain[at] in follow:
                    bits -= np.log2(follow[plain[at]] / total)
                    break
                bits -= np.log2(len(follow) / total) if follow else 0
        assert abs(trees.other_bits(code, tables[4][j]).sum() - bits) < 1e-6


def test_automaton_against_distances():
    rnd = random.Random(3)
    lexicon = [toxicity.Entry(t, s) for t, s in (("abc", False), ("abcab", False), ("bacab", False), ("cabcabcab", False),
                                                 ("cca", True))]
    machine = toxicity.Automaton(lexicon, limit=50)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, e in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
            row = new
        return row[-1]
    for _ in range(3000):
        w = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 11)))
        want = [(0, i) for i, e in enumerate(lexicon) if e.stem and w.startswith(e.term)]
        want += [(distance(e.term, w), i) for i, e in enumerate(lexicon)
                 if not e.stem and distance(e.term, w) <= toxicity.edits(e)]
        assert machine.match(w) == (min(want)[::-1] if want else None), w


def test_toxicity(spark, none):
    model = toxicity.Model([toxicity.Entry("stupid", False), toxicity.Entry("vequ", True)],
                           {(0, 0): 0.9, (0, 1): 0.7, (1, 0): 0.8}, 0.2)
    rows = [(1, "You Stupid thing"), (2, "so stuppid"), (3, 'he said "stupid idea" then'), (4, "study stupendous"),
            (5, "un vequille"), (6, None), (7, ""), (1, "You Stupid thing")]
    d = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, score double, predicted string")
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert [got[i].predicted for i in range(1, 8)] == [1, 1, 0, 0, 1, 0, 0]
    assert got[3].score > got[4].score == got[6].score == toxicity.BASE
    assert toxicity.score(none, model).count() == 0 and toxicity.score(d, None).count() == 8
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    assert toxicity.train(docs.limit(0), labels) is None and toxicity.train(docs, labels.limit(0)) is None


def test_toxicity_sample_ranks_few_rows(spark):
    labels = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 == 0, 1)
                                         .when(F.col("id") % 50_000 == 1, None).otherwise(0).alias("toxic"))
    docs = labels.select("doc_id", F.col("doc_id").cast("string").alias("text"))
    used = labels.filter(~toxicity.held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    rows = used.select("toxic", F.xxhash64("doc_id"), "doc_id").collect()
    want = {(str(i), x) for x, most in ((0, toxicity.SAMPLE_CLEAN), (1, toxicity.SAMPLE_TOXIC))
            for _, _, i in sorted(r for r in rows if r[0] == x)[:most]}
    got = toxicity.training_sample(docs, labels.unionByName(labels.limit(1000))).collect()
    assert len(got) == len(want) and {(r.text, r.toxic) for r in got} == want
    ranked = toxicity._lowest(used)
    assert len(rows) > 100_000 and ranked.count() < 1.1 * len(want)
    assert toxicity._lowest(used.filter("doc_id < 500")).count() == sum(r[2] < 500 for r in rows)


def test_line_join_against_all_pairs(spark, docs, none):
    more = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 100)
    d = docs.select("doc_id", "text").unionByName(more)
    want, seen = {}, []
    rows = {(r.doc_id, r.text) for r in d.collect()}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        want[i] = []
        for n, line in enumerate((t or "").encode().lower().split(b"\n")):
            s = frozenset(line.split())
            if s:
                if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                    want[i].append(n)
                seen.append(s)
    got = line_join.line_counts(d).collect()
    assert len(got) == d.count() and all(r.removed == want[r.doc_id] for r in got)
    left = line_join.drop_lines(docs)
    assert left.columns == docs.columns
    kept = {r.doc_id: r for r in left.collect()}
    assert 2 not in kept and {4, 5, 6} <= set(kept) and kept[12].text == "a b\n" and kept[12].n_chars == 4
    assert line_join.drop_lines(docs, empty=True).count() == docs.count()
    assert line_join.line_counts(none).count() == 0


def test_token_counts(docs, none, texts):
    scores, byte = token_counts.piece_scores(token_counts.vocabulary_path())

    def best(word):
        at = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            k = len(word[end - 1].encode())
            choices = [(at[b][0] + scores[word[b:end]], at[b][1] - 1) for b in range(end) if word[b:end] in scores]
            if word[end - 1] not in scores:
                choices.append((at[end - 1][0] + k * byte, at[end - 1][1] - k))
            at.append(max(choices))
        return -at[-1][1]
    got = {r.doc_id: r for r in token_counts.token_counts(docs).collect()}
    for i, t in texts.items():
        if i != 15:
            assert got[i].n_tokens == sum(best("▁" + w.decode()) for w in split(t)), i
            assert got[i].n_words == len(split(t))
    assert got[5].n_tokens == 0 and token_counts.token_counts(none).count() == 0


def test_quality_measures(docs, none, texts):
    got = {r.doc_id: r for r in weak_rules.quality(docs).collect()}
    for i, t in texts.items():
        w = [x.decode() for x in split(t)]
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        windows = [tuple(w[j:j + 3]) for j in range(len(w) - 2)]
        twice = {x for x in windows if windows.count(x) > 1} if len(w) < 500 else None
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        if twice is not None:
            covered = {j + o for j, x in enumerate(windows) if x in twice for o in range(3)}
            assert r.n_repeat_words == len(covered), i
            assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept) and 0 <= r.posterior <= 1
    assert weak_rules.quality(none).count() == 0 and weak_rules.filter_quality(none).count() == 0
    assert weak_rules.filter_quality(docs).columns == docs.columns
    assert sorted(str(r.doc_id) for r in weak_rules.filter_quality(docs).collect()) == sorted(
        str(r.doc_id) for r in weak_rules.quality(docs).filter("kept").collect())


def test_quality_estimation_matches_numpy(spark):
    k = len(weak_rules.RULES)
    rnd = np.random.default_rng(1)
    votes = rnd.integers(-1, 2, (60, k))
    n = rnd.integers(1, 50, 60).astype(float)
    code = [int(sum((v + 1) * 3 ** (k - 1 - j) for j, v in enumerate(row))) for row in votes]
    got = {r.votes: r.posterior for r in weak_rules.posteriors(
        spark.createDataFrame(list(zip(code, n.astype(int).tolist())), "votes int, n long")).collect()}
    prior = np.log(weak_rules.PRIOR / (1 - weak_rules.PRIOR))
    says = np.tile(np.log(np.divide(weak_rules.VOTES_GOOD, weak_rules.VOTES_BAD)), (k, 1))
    for step in range(weak_rules.EM_ROUNDS + 1):
        g = 1 / (1 + np.exp(-(prior + says[np.arange(k), votes + 1].sum(1))))
        prior = np.log((1 + n @ g) / (1 + n @ (1 - g)))
        hit = votes[:, :, None] == np.array([-1, 0, 1])
        says = np.log((1 + np.einsum("p,pjv->jv", n * g, hit)) / (3 + n @ g)) - np.log(
            (1 + np.einsum("p,pjv->jv", n * (1 - g), hit)) / (3 + n @ (1 - g)))
    assert all(abs(got[c] - x) < 1e-9 for c, x in zip(code, g))


def test_substring_dedup_against_all_windows(docs, none):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    count = {}
    for _, t in rows:
        w = split(t)
        for j in range(len(w) - 34):
            key = tuple(w[j:j + 35])
            count[key] = count.get(key, 0) + 1
    want = []
    for i, t in rows:
        w = split(t)
        gone = {j + o for j in range(len(w) - 34) if count[tuple(w[j:j + 35])] > 1 for o in range(35)}
        left = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((str(i), len(w), len(gone), hashlib.sha256(left).hexdigest()))
    got = recompression.remove_repeats(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    assert any(n for _, _, n, _ in want) and recompression.remove_repeats(none).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(9)
    for vocabulary in (2, 5, 50):
        a = common.mix(rng.integers(0, vocabulary, 400).astype(np.uint64))
        piece = a[100:220]
        b = np.concatenate([common.mix(rng.integers(0, vocabulary, 77).astype(np.uint64)), piece, a[:50]])
        pa_, wa, na = recompression.anchors(a, np.arange(100, 220 - 34))
        pb, wb, nb = recompression.anchors(b, np.arange(77, 77 + 120 - 34))
        assert (pa_ - 100 == pb - 77).all() and (wa == wb).all() and (na == nb).all()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLE_SQL[name])
    assert [d[0] for d in cur.description] == df.columns
    assert sorted(map(tuple, df.collect()), key=str) == sorted(cur.fetchall(), key=str)


def test_pipeline(spark):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    leaked = {r.doc_id for r in queries.op4_edit_leaks(spark, SF).collect()}
    bad = {r.doc_id for r in queries.op9_weak_rules(spark, SF).filter("not kept").collect()}
    for name, stage in P.STAGES:
        docs = common.stored(stage(spark, docs, SF), name)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and now
        if name != "packing":
            assert docs.columns == columns
        if name == "quality_rules":
            assert now == ids - bad
        if name == "line_dedup":
            texts = [(r.doc_id, x) for r in docs.collect() for x in r.text.lower().split("\n") if x.split()]
            assert len({frozenset(x.split()) for _, x in texts}) == len(texts)
        if name == "near_dedup":
            assert odd_minhash.groups(docs).filter("not kept").count() == 0
        if name == "decontamination":
            from labelscope.llm.edit_leaks import leaks
            assert leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0 and not now & leaked & bad
        ids = now
    assert docs.agg(F.sum("length"), F.countDistinct("sequence_id"), F.count(F.lit(1))).first()[1] == docs.count()


def test_documents_that_share_a_passage_are_not_paired(spark, monkeypatch):
    """Unlinked documents with one passage in common: hardly a pair's texts
    are compared, however many documents there are; the links among them stay."""
    passage = " ".join(words(60, 77, 5000))
    tested, real = [], odd_minhash._confirm

    def counted(pairs, *rest):
        tested.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(odd_minhash, "_confirm", counted)
    for n in (100, 300):
        own = [f"{passage} {' '.join(words(30, 1000 + i, 5000))}" for i in range(n)]
        near = [own[i] + " more" for i in range(0, n, 50)]
        docs = spark.createDataFrame(list(enumerate(own + near)), "doc_id long, text string")
        tested.clear()
        got = {r.doc_id: r.component_id for r in odd_minhash.groups(docs).collect()}
        assert all(got[i] == i for i in range(n)) and all(got[n + j] == 50 * j for j in range(len(near)))
        assert sum(tested) <= 12 * n, tested


def test_parities_never_lose_a_link():
    rng = np.random.default_rng(4)
    for n in (3, 40, 400, 9000):
        a = np.unique(common.mix(rng.integers(0, 1 << 62, n, np.uint64)))
        b = np.unique(np.concatenate([a[: n * 9 // 10], common.mix(rng.integers(0, 1 << 62, max(1, n // 12), np.uint64))]))
        bits = [np.bincount((common.mix(x) % np.uint64(odd_minhash.PARITY_BITS)).astype(np.int64),
                            minlength=odd_minhash.PARITY_BITS) & 1 for x in (a, b)]
        assert (bits[0] != bits[1]).sum() <= len(np.setxor1d(a, b))


def test_variants_below_the_threshold_are_not_verified(spark, monkeypatch):
    """Lines made from one template that are no copies: hardly a pair's words
    are compared, however many lines there are; the copies among them go."""
    template, tested, real = words(60, 5, 4000), [], line_join._verified

    def counted(pairs, *rest):
        tested.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(line_join, "_verified", counted)
    for n in (100, 300):
        r, rows = random.Random(n), []
        for i in range(n):
            line = list(template)
            for at in r.sample(range(60), 14):
                line[at] = f"own{i}x{at}"
            rows.append((i, " ".join(line)))
        rows += [(n + i, rows[i][1] + " more") for i in range(0, n, 50)]
        tested.clear()
        got = line_join.line_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {x.doc_id for x in got if x.removed} == {n + i for i in range(0, n, 50)}
        assert sum(tested) <= 3 * n, tested


def test_bitmaps_never_lose_a_pair():
    r = np.random.default_rng(8)
    rank = np.arange(line_join.CELLS, dtype=np.uint64)
    for n in (5, 47, 400):
        a = common.mix(r.integers(0, 1 << 62, n, np.uint64))
        b = np.concatenate([a[n // 6:], common.mix(r.integers(0, 1 << 62, n // 8, np.uint64))])
        *_, bitmap, _, _, _ = line_join.line_sets(np.array([len(a), len(b)]), np.concatenate([a, b]), rank, 80)
        apart = sum(bin(int(w[0] ^ w[1]) & (1 << 64) - 1).count("1") for w in bitmap)
        assert apart <= len(np.setxor1d(a, b))


def test_candidates_hold_every_similar_pair(spark, monkeypatch):
    """Rows of a token that come in many batches, pairs cut in many parts:
    each pair of similar sets is among the candidates, few others are."""
    monkeypatch.setattr(line_join, "ROWS", 30)
    monkeypatch.setattr(line_join, "PAIRS", 11)
    r, sets = np.random.default_rng(9), []
    rank = r.permutation(line_join.CELLS).astype(np.uint64)
    pool = common.mix(r.integers(0, 1 << 62, 300, np.uint64))
    for _ in range(40):
        base = r.choice(pool, r.integers(1, 60), replace=False)
        sets.append(base)
        for _ in range(5):
            sets.append(np.concatenate([base[r.integers(0, len(base) // 4 + 1):], r.choice(pool, r.integers(0, 5))]))
    sets = [np.unique(s) for s in sets if len(s)]
    _, node, n, bitmap, _, prefix, ends = line_join.line_sets(
        np.array([len(s) for s in sets]), np.concatenate(sets), rank, 80)
    of = {int(x): (set(s.tolist()), i % 3 == 0) for i, (x, s) in enumerate(zip(node, sets))}
    rows = [(int(t), int(n[i]), int(node[i]), int(bitmap[0][i]), int(bitmap[1][i]), 2 * p + of[int(node[i])][1])
            for i, begin in enumerate([0, *ends[:-1]]) for p, t in enumerate(prefix[begin:ends[i]])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = line_join.candidates(spark.createDataFrame(
            sorted(set(rows)), "token int, n int, node long, w0 long, w1 long, m int"), 80).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(a, b) for a, (x, d) in of.items() for b, (y, e) in of.items()
            if a < b and not (d and e) and 100 * len(x & y) >= 80 * len(x | y)}
    assert len(want) > 100 and want <= {(x.a, x.b) for x in got}
    assert not any(of[x.a][1] and of[x.b][1] for x in got)
    assert len({(x.a, x.b) for x in got}) < 2 * len(want)


def test_a_prefix_token_moves_and_is_sorted_once(spark):
    """Each row of a prefix token goes through one shuffle and one sort, and is joined with no others."""
    p = spark.createDataFrame([], "token int, n int, node long, w0 long, w1 long, m int")
    plan = line_join.candidates(p, 80)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1 and "Join" not in plan, plan


def test_names_of_a_line_that_share_their_first_bits_keep_one_order():
    """Names that the short sort key can't tell apart: the order is by the whole name."""
    rank = np.zeros(line_join.CELLS, np.uint64)
    ids = np.array([7 << 18, 5 << 18, 9 << 18], np.uint64)
    one = line_join.line_sets(np.array([3]), ids, rank, 1)
    two = line_join.line_sets(np.array([3, 1]), np.concatenate([ids[::-1], ids[:1]]), rank, 1)
    assert one[1][0] == two[1][0] and one[5][:3].tolist() == two[5][:3].tolist() == [5 << 2, 7 << 2, 9 << 2]
