"""Repair the structure of conversations with the fewest edits, over a shared grammar.

A repaired conversation reads ``(s?(ua)+)?`` in role initials. Every row is one of nine
symbols: its role's class (s, u, a, other), in capitals if its text breaks off, or x if it
must go (blank, or said before). An automaton of four states (nothing yet, after s, after
u, after a) reads the result; a symbol is a 4 x 4 matrix over (cost, audit), multiplied by
adding costs and joining audits, added by taking the cheaper and, of equal cost, the
smaller audit. Insertions stand before the next row, so no audit of a symbol string is the
beginning of another and the smaller part always gives the smaller whole.

1. Rows are sorted by (conv_id, turn, role, digest of text) without their texts; equal rows
   are one with a count. Each run of ``PIECE`` sorted rows of a conversation is a string.
2. Re-Pair over the distinct strings: each of ``ROUNDS`` rounds counts adjacent symbols in
   Spark and replaces the ``PAIRS`` most frequent pairs by new symbols. The numbers bound
   the grammar, not the strings: whatever is left is multiplied out.
3. Each rule gets one matrix, from the two it joins, shared by all conversations; audits are
   ropes that share their parts. Each distinct string is evaluated once.
4. A conversation's strings, then its rows, stream through one task in order: a vector of
   four (cost, audit) goes through the matrices, and the audit is applied to the rows. Memory
   does not grow with the conversation but for its audit, which is part of the result. The
   hash of a conversation is one sequential stream, so its texts are read by one task.

Defined results: a null conv_id is a conversation of its own; a null turn comes first and
counts for no gap; a null role or text is one space. Rows of one turn go by role, then md5
of text. An empty role or another initial than s, u, a can only be rewritten or deleted. An
empty table has no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagecraft.llm.words import batched
from stagecraft.operators.skew import lookup_counted
from stagecraft.scratch import materialise

PIECE, ROUNDS, PAIRS, SALT = 4096, 8, 32, 20
KEEP, REROLE, DELETE, INSERT, OPEN_END = 0, 3, 4, 3, 3
GONE, FIRST_RULE = "x", 0xE000
_SPACE = " \t\n\v\f\r"
# Where a user, an assistant and a system row lead from each state.
_NEXT = {"u": (2, 2, None, 2), "a": (None, None, 3, None), "s": (1, None, None, None)}
_FREE = (2, 2, 3, 2)  # where an inserted or rewritten row leads
_NAMES = {2: "user", 3: "assistant"}


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the drawn damage; repeated rows stand twice."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    drawn = conversations.select(
        "conv_id", F.col("turn").cast("bigint"), parts[2].alias("role"), parts[3].alias("text"),
        (F.crc32(F.concat(parts[0], F.lit(":"), parts[1])) % SALT).alias("_d")).where("_d <> 0")
    d = F.col("_d")
    text = F.when(d == 1, "").when(d == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(d == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return drawn.select("conv_id", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"),
                        text.alias("text"), F.explode(times).alias("_t")).drop("_t")


def _with_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.md5("text"))


def symbols(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, key, n, blank, dup, cut, sign``: equal rows once. ``sign`` is
    the first one's symbol; the others of n are always deleted."""
    last = F.substring(F.rtrim("text", F.lit(_SPACE)), -1, 1)
    narrow = _with_key(rows).select(
        "conv_id", "turn", "role", "key", (last == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("cut"))
    kinds = materialise(narrow.groupBy(*narrow.columns).agg(F.count("*").alias("n")), "turn-kinds")
    said = ["conv_id", "role", "key"]
    when = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    firsts = kinds.groupBy(*said).agg(F.min(when).alias("first"), F.count("*").alias("_n"))
    known = lookup_counted(kinds, firsts, said, count="_n")
    dup = ~F.col("blank") & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    cut = F.col("cut") & ~F.col("blank") & ~F.col("dup")
    return known.withColumn("dup", dup).withColumns({"cut": cut, "kind": kind}).withColumn(
        "sign", F.when(F.col("blank") | F.col("dup"), GONE).when(F.col("cut"), F.upper("kind"))
        .otherwise(F.col("kind"))).drop("first")


def strings(signs: DataFrame) -> DataFrame:
    """One row for each run of sorted rows of a conversation: its symbols and its counts."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]
    placed = materialise(signs.select("conv_id", "turn", "role", "key", "n", "blank", "dup", "cut", "kind", "sign")
                         .orderBy(*order).withColumn("at", F.monotonically_increasing_id())
                         .drop("role", "key"), "turn-order")
    n, one = F.col("n"), F.lit(1).cast("bigint")
    row = F.struct("at", F.concat("sign", F.repeat(F.lit(GONE), (n - 1).cast("int"))).alias("sign"),
                   F.repeat("kind", n.cast("int")).alias("kind"))

    def total(what: Column, other: Column) -> Column:
        return F.sum(F.when(what, n).otherwise(other))

    runs = placed.groupBy("conv_id", F.shiftright("at", PIECE.bit_length() - 1).alias("piece")).agg(
        F.array_sort(F.collect_list(row)).alias("_rows"),
        total(F.col("blank"), F.lit(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("dup"), n).otherwise(n - 1)).alias("duplicate"),
        F.sum(F.when(F.col("cut"), one).otherwise(0)).alias("truncated"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"))
    kinds = F.array_join("_rows.kind", "")
    joined = runs.withColumns({"syms": F.array_join("_rows.sign", ""), "kinds": kinds})
    legal = F.regexp_count("kinds", F.lit("(?=su|ua|au)"))
    return joined.select(
        "conv_id", "piece", "syms", "blank", "duplicate", "truncated", "low", "high", "turns",
        (F.length("kinds") - 1 - legal).cast("bigint").alias("illegal"),
        F.substring("kinds", 1, 1).alias("head"), F.substring("kinds", -1, 1).alias("tail"))


def repair_grammar(texts: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """From ``syms, n``: the same with ``packed``, and the rules (symbol, left, right)."""
    packed, rules = texts.withColumn("packed", F.col("syms")), []
    for _ in range(rounds):
        places = F.when(F.length("packed") > 1, F.sequence(F.lit(1), F.length("packed") - 1))
        found = packed.select("n", F.explode(places).alias("_i"), "packed").groupBy(
            F.expr("substring(packed, _i, 2)").alias("pair")).agg(F.sum("n").alias("n")).where("n > 1")
        # At most `pairs` rows reach the driver.
        chosen = [r.pair for r in found.orderBy(F.desc("n"), "pair").limit(pairs).collect()]
        if not chosen:
            break
        column = F.col("packed")
        for pair in chosen:
            rules.append((chr(FIRST_RULE + len(rules)), pair[0], pair[1]))
            column = F.replace(column, F.lit(pair), F.lit(rules[-1][0]))
        packed = materialise(packed.withColumn("packed", column), "turn-packed")
    return packed, rules


class Rope:
    """A text joined from two ropes; flattened when it is compared or read, once."""

    __slots__ = ("left", "right", "flat")

    def __init__(self, left=None, right=None, flat=None):
        self.left, self.right, self.flat = left, right, flat

    def text(self) -> str:
        if self.flat is None:
            out, stack = [], [self]
            while stack:
                rope = stack.pop()
                if rope.flat is None:
                    stack += (rope.right, rope.left)
                else:
                    out.append(rope.flat)
            self.flat, self.left, self.right = "".join(out), None, None
        return self.flat


def _better(a, b):
    """The cheaper of two (cost, rope), then the one with the smaller audit."""
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if a[1].text() <= b[1].text() else b


def symbol_matrix(sign: str) -> list[list]:
    """Cheapest way through one row from each state to each state."""
    out = [[None] * 4 for _ in range(4)]
    extra = OPEN_END if sign.isupper() else 0
    for start in range(4):
        state, cost, audit = start, 0, ""
        for _ in range(3):
            ways = [(state, DELETE, "D")]
            if sign != GONE:
                ways.append((_FREE[state], REROLE + extra, "R"))
                kept = _NEXT.get(sign.lower(), (None,) * 4)[state]
                if kept is not None:
                    ways.append((kept, KEEP + extra, "K"))
            for to, price, edit in ways:
                out[start][to] = _better(out[start][to], (cost + price, Rope(flat=audit + edit)))
            state, cost, audit = _FREE[state], cost + INSERT, audit + "I"
    return out


def product(a, b):
    out = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for k in range(4):
            if a[i][k] is not None:
                for j in range(4):
                    if b[k][j] is not None:
                        out[i][j] = _better(out[i][j], (
                            a[i][k][0] + b[k][j][0], Rope(a[i][k][1], b[k][j][1])))
    return out


def rule_matrices(rules) -> dict[str, list]:
    """One matrix a symbol, rules from the bottom up."""
    known = {s: symbol_matrix(s) for s in "suaoSUAO" + GONE}
    for name, left, right in rules:
        known[name] = product(known[left], known[right])
    return known


def string_matrix(packed: str, known: dict[str, list]) -> list[list]:
    """The product over a string's symbols, halves first."""
    level = [known[c] for c in packed]
    while len(level) > 1:
        level = [product(*level[i:i + 2]) if i + 1 < len(level) else level[i]
                 for i in range(0, len(level), 2)]
    return level[0]


def evaluated(packed: DataFrame, rules) -> DataFrame:
    """``syms, n, costs, audits``: the matrix of each distinct string, row by row; a cost of
    -1 where there is no way."""
    schema = pa.schema([("syms", pa.string()), ("n", pa.int64()), ("costs", pa.list_(pa.int32())),
                        ("audits", pa.list_(pa.string()))])

    def fill(batch):
        known = rule_matrices(rules)
        for syms, n, text in zip(*(batch[c].to_pylist() for c in ("syms", "n", "packed"))):
            cells = [c for row in string_matrix(text, known) for c in row]
            yield syms, n, [-1 if c is None else c[0] for c in cells], [
                "" if c is None else c[1].text() for c in cells]

    return packed.select("syms", "n", "packed").mapInArrow(
        batched(schema, fill), "syms string, n bigint, costs array<int>, audits array<string>")


class Conversation:
    """The strings and then the rows of one conversation, in order."""

    def __init__(self, conv_id):
        self.conv_id, self.vector, self.done = conv_id, [(0, ""), None, None, None], []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.tail = None
        self.turns = self.at = self.state = 0
        self.audit = None

    def string(self, row) -> None:
        new = [None] * 4
        for cell, (cost, audit) in enumerate(zip(row["costs"], row["audits"])):
            start, to = divmod(cell, 4)
            if cost >= 0 and self.vector[start] is not None:
                was = self.vector[start]
                way = (was[0] + cost, was[1] + audit)
                new[to] = way if new[to] is None else min(new[to], way)
        # What all ways share is settled, so only their differences are carried on.
        shared = commonprefix([w[1] for w in new if w])
        self.done.append(shared)
        self.vector = [w and (w[0], w[1][len(shared):]) for w in new]
        for name in self.counts:
            self.counts[name] += row[name]
        if self.tail is not None:
            self.counts["illegal"] += self.tail + row["head"] not in ("su", "ua", "au")
        self.tail = row["tail"]
        if row["low"] is not None:
            self.turns += row["turns"] - (row["low"] == self.high)
            self.low, self.high = row["low"] if self.low is None else self.low, row["high"]

    def finish(self) -> None:
        """Choose the cheapest way to an end after a or to nothing at all."""
        ends = [(w[0] + INSERT * more, w[1] + "I" * more)
                for w, more in zip(self.vector, (0, 2, 1, 0)) if w]
        self.cost, rest = min(ends)
        self.audit = "".join(self.done) + rest

    def _inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, _FREE[self.state]
            yield _NAMES[self.state], ""

    def row(self, role: str, text: str):
        """What stands in the repaired conversation for the next row."""
        if self.audit is None:
            self.finish()
        yield from self._inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = _NEXT[role[:1]][self.state]
            yield role, text
        elif edit == "R":
            self.state = _FREE[self.state]
            yield _NAMES[self.state], text

    def end(self):
        if self.audit is None:
            self.finish()
        yield from self._inserted()

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _streams(conversations: DataFrame) -> DataFrame:
    """For every conversation a mark, its evaluated strings and its rows, in this order in one
    partition."""
    rows = damage(conversations)
    runs = materialise(strings(symbols(rows)), "turn-strings")
    packed, rules = repair_grammar(materialise(
        runs.groupBy("syms").agg(F.count("*").alias("n")), "turn-distinct"))
    runs = lookup_counted(runs, evaluated(packed, rules), ["syms"]).drop("syms")
    marks = conversations.select("conv_id").distinct().withColumn("kind", F.lit(0))
    wide = _with_key(rows).withColumn("kind", F.lit(2))
    all_ = marks.unionByName(runs.withColumn("kind", F.lit(1)), allowMissingColumns=True).unionByName(
        wide, allowMissingColumns=True)
    return all_.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id"), F.col("kind"), F.col("piece"), F.col("turn").asc_nulls_first(),
        F.col("role"), F.col("key")).drop("key", "piece", "turn")


def _each(batches, start, take, end):
    """Walk through sorted batches; yields what ``take`` and ``end`` yield."""
    now = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                if now is not None:
                    yield from end(now)
                now = start(row["conv_id"])
            elif row["kind"] == 1:
                now.string(row)
            else:
                yield from take(now, row)
    if now is not None:
        yield from end(now)


def _mapped(streams: DataFrame, fields: list, start, take, end) -> DataFrame:
    kind = streams.schema["conv_id"].dataType
    spark_schema = f"conv_id {kind.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in fields)
    types = {"bigint": pa.int64(), "string": pa.string()}

    def run(batches):
        first, held, schema = next(batches, None), [], None
        if first is None:
            return
        schema = pa.schema([first.schema.field("conv_id"), *[(n, types[t]) for n, t in fields]])

        def rest():
            yield first
            yield from batches

        def packed(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for row in _each(rest(), start, take, end):
            held.append(row)
            if len(held) >= 1000:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    return streams.mapInArrow(run, spark_schema)


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of
    every conversation of the undamaged input."""
    def start(conv_id):
        now = Conversation(conv_id)
        now.hash, now.lines = hashlib.sha256(), 0
        return now

    def add(now, lines):
        for role, text in lines:
            now.hash.update((("\n" if now.lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            now.lines += 1

    def take(now, row):
        add(now, now.row(row["role"], row["text"]))
        return ()

    def end(now):
        add(now, now.end())
        yield (now.conv_id, now.gaps, *now.counts.values(), now.cost, now.audit, now.hash.hexdigest())

    counts = [(n, "bigint") for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return _mapped(_streams(conversations), [*counts, ("audit", "string"), ("repaired_sha256", "string")],
                   start, take, end)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, place from 0, role, text."""
    def start(conv_id):
        now = Conversation(conv_id)
        now.lines = 0
        return now

    def numbered(now, lines):
        for role, text in lines:
            yield now.conv_id, now.lines, role, text
            now.lines += 1

    return _mapped(_streams(conversations), [("place", "bigint"), ("role", "string"), ("text", "string")],
                   start, lambda now, row: numbered(now, now.row(row["role"], row["text"])),
                   lambda now: numbered(now, now.end()))
