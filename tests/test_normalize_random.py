"""Label normalisation on hand-made spellings, in every surrounding."""

from labelscope.functions.labels import is_ignored_label, normalize_label

#: Spelling -> (label, ignored).
SPELLINGS = {
    "Singleton": ("singleton", False), "SINGLETON PATTERN": ("singleton", False), "FACTORY": ("factory", False),
    "Factory Method": ("factory", False), "abstract factory": ("factory", False), "factory-method": ("factory", False),
    "Pub-Sub": ("observer", False), "observer": ("observer", False), "Publisher-Subscriber": ("observer", False),
    "wrapper": (None, True), "Strategy Pattern": (None, True), "x": (None, True), "factory  method": (None, True),
    "singletonsingleton": (None, True), "\u0130": (None, True), "\u00df": (None, True), "observer.": (None, True),
}
AROUND = ["", " ", "\t", "\n", "\u00a0", "\u2003", "\u3000", "\x1c"]


def test_spellings(spark):
    cases = [(a + s + b, want) for s, want in SPELLINGS.items() for a in AROUND for b in AROUND]
    cases += [("None", (None, False)), ("none", (None, False)), ("NONE", (None, False)), ("", (None, False)),
              (None, (None, False)), ("\u200bsingleton", (None, True))]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, raw string")
    out = df.select("i", "raw", normalize_label("raw").alias("n"))
    got = {r["i"]: (r["n"], r["ign"]) for r in
           out.select("i", "n", is_ignored_label("raw", "n").alias("ign")).collect()}
    for i, (raw, want) in enumerate(cases):
        assert got[i] == want, repr(raw)
