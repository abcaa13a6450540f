"""Conversation repair: cheapest edits by dynamic programming over a grammar.

A conversation is a sequence of rows with a role and a fault; its cheapest
edits to roles of the form ``(s?(ua)+)?`` are found by a min-plus automaton of
four states. Each role/fault symbol has a transfer matrix: from one state to
another, the least cost and the audit (a letter for each edit) that reaches it.

The symbol sequences of all conversations are compressed by Re-Pair: in rounds
over the distinct sequences with their numbers, Spark counts neighbouring
symbols and the commonest pairs become rules. Every rule's matrix is the
min-plus product of its two parts, found once, bottom-up; audits are ropes
that share their parts. A conversation is then the product over its few
symbols, found once for each distinct sequence in a worker.

Edits of a row: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an
empty user or assistant row anywhere 3; a truncated row that stays adds 3;
blank and duplicate rows must go. Equal costs: the ASCII-least audit. Since
no audit of the same rows, cost and end states is a prefix of another, the
least audit of a product is made of the least audits of its parts.

Rows go once, with their text, to the partitions of (conversation, 1,024
turns), where they are read in order as a stream and written as chunks of
bounded size. Duplicates are found beforehand from digests only. A
conversation of one chunk is repaired where it lies; of longer ones each chunk
gives its matrix, and a stream over the conversation's chunks in order
multiplies them and hashes the repaired text, so memory holds one chunk and
the audit.

Order: by turn, nulls first; rows of the same turn by role, then text. Nulls
in conv_id and turn are one space in the damage's key, null roles and texts
are one space; rows with null conv_id are one conversation. A role counts by
its first letter, ``s``, ``u`` or ``a``, any other is never legal. Repeated
rows are duplicates. Texts of any length are whole. Empty tables give no rows;
other columns are ignored, and columns of any names may be there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.llm.common import Remembered, in_worker, stored

RULES, PER_ROUND = 192, 24           # rules of the grammar at most, and of one round
CHUNK_ROWS, CHUNK_CHARS = 1024, 4_000_000
SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

# -- the automaton -------------------------------------------------------------

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: state -> state after a row of this role.
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
NAME = {"u": "user", "a": "assistant"}


class Rope:
    """A text made of parts; spelled when it is compared or read."""

    __slots__ = ("left", "right", "text")

    def __init__(self, left=None, right=None, text: str | None = None):
        self.left, self.right, self.text = left, right, text

    def __str__(self) -> str:
        if self.text is None:
            parts, todo = [], [self]
            while todo:
                r = todo.pop()
                if r.text is not None:
                    parts.append(r.text)
                else:
                    todo += [r.right, r.left]
            self.text, self.left, self.right = "".join(parts), None, None
        return self.text


#: from state, to state -> (cost, audit); missing: impossible.
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def _better(old: tuple[int, Rope] | None, cost: int, left: Rope, right: Rope) -> tuple[int, Rope]:
    if old is None or cost < old[0]:
        return cost, Rope(left, right)
    if cost == old[0]:
        new = Rope(left, right)
        if str(new) < str(old[1]):
            return cost, new
    return old


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = {}
    for (i, k), (cost, rope) in a.items():
        for j in STATES:
            if (k, j) in b:
                out[i, j] = _better(out.get((i, j)), cost + b[k, j][0], rope, b[k, j][1])
    return out


def _inserts() -> Matrix:
    """Any number of inserted rows; more than two never pay."""
    out = {(i, i): (0, Rope(text="")) for i in STATES}
    for i in STATES:
        at = i
        for n in (1, 2):
            at = MOVES[_NEXT[at]][at]
            if (i, at) not in out:
                out[i, at] = (n * INSERT, Rope(text="I" * n))
    return out


INSERTS = _inserts()


def _row(symbol: str) -> Matrix:
    """Matrix of one row, with what is inserted before it. ``d``: it must go;
    else its role's letter, as a capital if the row is truncated."""
    edit: Matrix = {(i, i): (DELETE, Rope(text="D")) for i in STATES}
    if symbol != "d":
        more = TRUNCATED * symbol.isupper()
        for moves, cost, letter in ((MOVES.get(symbol.lower(), {}), KEEP, "K"), (MOVES["u"], REROLE, "R"),
                                    (MOVES["a"], REROLE, "R")):
            for i, j in moves.items():
                if (i, j) not in edit:
                    edit[i, j] = (cost + more, Rope(text=letter))
    return product(INSERTS, edit)


class Grammar:
    """Rules (symbol, left, right) in the order they were made, and the
    matrices of all symbols."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.rules = rules
        self.name = hashlib.sha256(repr(rules).encode()).hexdigest()
        self.matrix = {x: _row(x) for x in "dsuaxSUAX"}
        for symbol, left, right in rules:
            self.matrix[symbol] = product(self.matrix[left], self.matrix[right])

    def __reduce__(self):
        return Grammar, (self.rules,)

    def parse(self, symbols: str) -> str:
        for symbol, left, right in self.rules:
            symbols = symbols.replace(left + right, symbol)
        return symbols

    def of(self, symbols: str) -> Matrix:
        """The matrix of a whole sequence."""
        out = {(i, i): (0, Rope(text="")) for i in STATES}
        for x in self.parse(symbols):
            out = product(out, self.matrix[x])
        return out

    def cheapest(self, symbols: str) -> tuple[int, str]:
        """Cost and audit of a whole conversation."""
        row = {(START, START): (0, Rope(text=""))}
        for x in self.parse(symbols):
            row = product(row, self.matrix[x])
        return best_end(row)


def best_end(row: Matrix) -> tuple[int, str]:
    """Least cost and audit of a finished conversation: empty, or after an
    assistant row."""
    ends = product(row, INSERTS)
    return min((ends[START, j][0], str(ends[START, j][1])) for j in (START, ASSISTANT) if (START, j) in ends)


class Repair:
    """Applies an audit to rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START
        self.hash, self.lines = hashlib.sha256(), 0

    def _line(self, role: str, text: str) -> None:
        self.hash.update(("\n" * (self.lines > 0) + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.lines += 1
        self.state = MOVES[role[0]][self.state]

    def _inserted(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self._line(NAME[_NEXT[self.state]], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._line(role if edit == "K" else NAME[_NEXT[self.state]], text)

    def digest(self) -> str:
        self._inserted()
        return self.hash.hexdigest()


# -- rows ------------------------------------------------------------------------

def damage(conv: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage of each row, and ``dropped``
    (the row is gone; it stays here so that its conversation is known)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    d = conv.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"),
                    space("text").alias("text"), kind.alias("kind"))
    k = F.col("kind")
    return d.select(
        "conv_id", "turn", F.when(k == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(k == 1, F.lit("")).when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (k == 0).alias("dropped"),
        F.explode(F.when(k == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def _first(col: Column) -> Column:
    """Turns in order, nulls first."""
    return F.coalesce(col, F.lit(-(1 << 63)).cast("long"))


def _judged(rows: DataFrame) -> DataFrame:
    """Rows with their role's letter ``cls`` (or x), the fault ``base`` that a
    row has by itself (b, t or .), digest of role and text, and block."""
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    cls = F.left("role", F.lit(1))
    d = rows.withColumn("end", end)
    return d.select(
        "conv_id", F.shiftright("turn", 10).alias("block"), "turn", _first(F.col("turn")).alias("at"), "role", "text",
        "dropped", F.when(cls.isin("s", "u", "a"), cls).otherwise(F.lit("x")).alias("cls"),
        F.when(F.col("end") == "", F.lit("b")).when(F.col("end").isin(".", "!", "?"), F.lit("."))
         .otherwise(F.lit("t")).alias("base"),
        F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))
         .alias("digest"))


def _marked(rows: DataFrame) -> DataFrame:
    """The rows (mark r), those dropped (g), and before them in the order of
    each conversation's block: w, the conversation has other blocks; d, a
    digest that the conversation has more than once, with its first turn."""
    blocks = rows.select("conv_id", "block").distinct().withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    wide = blocks.filter("n > 1").select("conv_id", "block", F.lit("w").alias("mark"))
    seen = rows.filter("not dropped and base <> 'b'").groupBy("conv_id", "block", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    w = Window.partitionBy("conv_id", "digest")
    twice = seen.withColumns({"n": F.sum("n").over(w), "at": F.min("at").over(w)}).filter("n > 1") \
        .select("conv_id", "block", "digest", "at", F.lit("d").alias("mark"))
    own = rows.withColumn("mark", F.when(F.col("dropped"), F.lit("g")).otherwise(F.lit("r"))).drop("dropped")
    gone = F.col("mark") == "g"
    own = own.withColumns({c: F.when(~gone, F.col(c)) for c in ("role", "text", "cls", "base", "digest")})
    return own.unionByName(wide, allowMissingColumns=True).unionByName(twice, allowMissingColumns=True)


_CHUNK = ("block long, no long, alone boolean, roles string, faults string, symbols string, lo long, hi long, "
          "turns long, names array<string>, texts array<string>")


def chunks(conv: DataFrame) -> DataFrame:
    """The damaged conversations as chunks of rows in order: conv_id, block,
    no; alone (the conversation is this chunk); roles and faults (a letter for
    each row: b, d, t or .); symbols; lo, hi and number of its turns; names
    (the roles) and texts."""
    d = _marked(_judged(damage(conv)))
    kind = d.schema["conv_id"].dataType.simpleString()
    d = d.repartition("conv_id", "block").sortWithinPartitions(
        "conv_id", "block", F.col("mark") == "r", "turn", "role", "text") \
        .select("conv_id", "block", "mark", "turn", "at", "role", "text", "cls", "base", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        of, open_ = None, None

        class Chunk:
            def __init__(self, no=0, last=None):
                self.no, self.last, self.chars = no, last, 0
                self.roles, self.faults, self.names, self.texts = [], [], [], []
                self.lo = self.hi = None
                self.turns = 0

            def close(self, alone):
                symbols = "".join("d" if f in "bd" else r.upper() if f == "t" else r
                                  for r, f in zip(self.roles, self.faults))
                done.append((*of, self.no, alone, "".join(self.roles), "".join(self.faults), symbols, self.lo, self.hi,
                             self.turns, self.names, self.texts))

        for batch in batches:
            kinds = batch.schema
            for conv_id, block, mark, turn, at, role, text, cls, base, digest in zip(
                    *(c.to_pylist() for c in batch.columns)):
                if of != (conv_id, block) or open_ is None:
                    if open_ is not None:
                        open_.close(not wide and open_.no == 0)
                    of, open_, wide, twice = (conv_id, block), Chunk(), False, {}
                if mark == "w":
                    wide = True
                elif mark == "d":
                    twice[digest] = at
                elif mark == "r":
                    if len(open_.texts) >= CHUNK_ROWS or open_.chars >= CHUNK_CHARS:
                        open_.close(False)
                        open_ = Chunk(open_.no + 1, open_.last)
                    if base != "b" and digest in twice:
                        if twice[digest] == at:
                            twice[digest] = None            # its first row; all others are duplicates
                        else:
                            base = "d"
                    open_.roles.append(cls)
                    open_.faults.append(base)
                    open_.names.append(role)
                    open_.texts.append(text)
                    open_.chars += len(text)
                    if turn is not None:
                        open_.lo = turn if open_.lo is None else open_.lo
                        open_.hi = turn
                        open_.turns += turn != open_.last
                        open_.last = turn
            if done:
                yield _batch(done, kinds.field(0).type)
                done = []
        if open_ is not None:
            open_.close(not wide and open_.no == 0)
            yield _batch(done, kinds.field(0).type)

    return d.mapInArrow(run, f"conv_id {kind}, {_CHUNK}")


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    long, text = pa.int64(), pa.string()
    kinds = (id_type, long, long, pa.bool_(), text, text, text, long, long, long, pa.list_(text), pa.list_(text))
    names = ("conv_id", "block", "no", "alone", "roles", "faults", "symbols", "lo", "hi", "turns", "names", "texts")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


# -- grammar ----------------------------------------------------------------------

def learn(chunk: DataFrame, rules: int = RULES, per_round: int = PER_ROUND) -> Grammar:
    """Re-Pair over all chunks. Each round counts the neighbouring symbols of
    the distinct sequences, weighted by how many chunks have them, and makes
    rules of the commonest pairs that share no symbol, until no pair occurs
    twice. The bound on rules bounds the grammar; what it leaves uncompressed
    is multiplied symbol by symbol."""
    seqs = stored(chunk.groupBy(F.col("symbols").alias("s")).agg(F.count(F.lit(1)).alias("n")), "sequences")
    found: list[tuple[str, str, str]] = []
    while len(found) < rules:
        pairs = seqs.filter("length(s) > 1").select("n", F.explode(F.expr(
            "transform(sequence(1, length(s) - 1), i -> substring(s, i, 2))")).alias("pair"))
        counted = pairs.groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1") \
            .orderBy(F.desc("n"), "pair").limit(2 * per_round).collect()     # the commonest pairs: a top list
        used: set[str] = set()
        new = []
        for r in counted:
            if not used & set(r.pair) and len(new) < min(per_round, rules - len(found)):
                used |= set(r.pair)
                new.append((chr(0x4E00 + len(found) + len(new)), r.pair[0], r.pair[1]))
        if not new:
            break
        found += new
        s = F.col("s")
        for symbol, left, right in new:
            s = F.replace(s, F.lit(left + right), F.lit(symbol))
        seqs = stored(seqs.select(s.alias("s"), "n"), "sequences")
    return Grammar(found)


# -- results ------------------------------------------------------------------------

def _illegal(roles: str) -> int:
    return sum(roles[i:i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))


_RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")
_NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _results(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = (id_type, *[pa.int64()] * 6, pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_NAMES)


def _gaps(lo, hi, turns) -> int:
    return 0 if lo is None else hi - lo + 1 - turns


def _whole(chunk: DataFrame, grammar: Grammar) -> DataFrame:
    """Results of the conversations of one chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = in_worker(f"conversations of {grammar.name}", lambda: Remembered(grammar.cheapest))
        for batch in batches:
            out = []
            for conv_id, roles, faults, symbols, lo, hi, turns, names, texts in zip(
                    *(c.to_pylist() for c in batch.columns)):
                cost, audit = known[symbols]
                repair = Repair(audit)
                for role, text in zip(names, texts):
                    repair.row(role, text)
                out.append((conv_id, _gaps(lo, hi, turns), faults.count("b"), faults.count("d"), faults.count("t"),
                            _illegal(roles), cost, audit, repair.digest()))
            known.trim()
            yield _results(out, batch.schema.field(0).type)

    kind = chunk.schema["conv_id"].dataType.simpleString()
    return chunk.filter("alone").select("conv_id", "roles", "faults", "symbols", "lo", "hi", "turns", "names", "texts") \
        .mapInArrow(run, f"conv_id {kind}, {_RESULT}")


def _long(chunk: DataFrame, grammar: Grammar) -> DataFrame:
    """Results of the conversations of several chunks: each chunk's matrix
    where it lies, then one stream over a conversation's matrices and, after
    them, its chunks."""
    kind = chunk.schema["conv_id"].dataType.simpleString()
    part = chunk.filter("not alone")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, audits = [], []
            for symbols in batch.column(3).to_pylist():
                m = grammar.of(symbols)
                costs.append([m[i, j][0] if (i, j) in m else None for i in STATES for j in STATES])
                audits.append([str(m[i, j][1]) if (i, j) in m else None for i in STATES for j in STATES])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))],
                names=[*batch.schema.names, "costs", "audits"])

    cols = "block long, no long, symbols string, roles string, faults string, lo long, hi long, turns long"
    first = part.select("conv_id", "block", "no", "symbols", "roles", "faults", "lo", "hi", "turns").mapInArrow(
        matrices, f"conv_id {kind}, {cols}, costs array<bigint>, audits array<string>").drop("symbols")
    both = first.withColumn("kind", F.lit(0)).unionByName(
        part.select("conv_id", "block", "no", "names", "texts", F.lit(1).alias("kind")), allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "block", "no").select(
        "conv_id", "kind", "roles", "faults", "lo", "hi", "turns", "costs", "audits", "names", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, at = (), None

        def start():
            return {"row": {(START, START): (0, Rope(text=""))}, "b": 0, "d": 0, "t": 0, "illegal": 0, "end": "",
                    "lo": None, "hi": None, "turns": 0, "repair": None}

        def finish():
            return (*of, _gaps(at["lo"], at["hi"], at["turns"]), at["b"], at["d"], at["t"], at["illegal"], at["cost"],
                    at["repair"].audit, at["repair"].digest())

        for batch in batches:
            out, id_type = [], batch.schema.field(0).type
            for conv_id, kind_, roles, faults, lo, hi, turns, costs, audits, names, texts in zip(
                    *(c.to_pylist() for c in batch.columns)):
                if of != (conv_id,):
                    if at is not None:
                        out.append(finish())
                    of, at = (conv_id,), start()
                if kind_ == 0:
                    m = {(i, j): (costs[4 * i + j], Rope(text=audits[4 * i + j])) for i in STATES for j in STATES
                         if costs[4 * i + j] is not None}
                    at["row"] = product(at["row"], m)
                    for f in "bdt":
                        at[f] += faults.count(f)
                    at["illegal"] += _illegal(at["end"] + roles)
                    at["end"] = roles[-1:] or at["end"]
                    at["lo"] = lo if at["lo"] is None else at["lo"]
                    at["hi"] = at["hi"] if hi is None else hi
                    at["turns"] += turns
                else:
                    if at["repair"] is None:
                        at["cost"], audit = best_end(at["row"])
                        at["repair"] = Repair(audit)
                    for role, text in zip(names, texts):
                        at["repair"].row(role, text)
            if out:
                yield _results(out, id_type)
        if at is not None:
            yield _results([finish()], id_type)

    return both.mapInArrow(run, f"conv_id {kind}, {_RESULT}")


def repair(conv: DataFrame, grammar: Grammar | None = None) -> DataFrame:
    """A row for each conversation: faults after the damage, and its cheapest
    repair. ``grammar``: of other conversations; else it is learned here."""
    chunk = stored(chunks(conv), "chunks")
    grammar = learn(chunk) if grammar is None else grammar
    return _whole(chunk, grammar).unionByName(_long(chunk, grammar))
