"""Operator 12: cheapest repair of conversations as a shortest path over integers.

Every turn is kept (K, cost 0), given another role (R, 1) or deleted (D, 2, the only
choice for a blank or repeated turn); turns may be inserted anywhere (I, 5), and a
truncated turn that stays costs 5 more. What remains must read ``(s?(ua)+)?`` in role
initials. A path goes through the states of that pattern, one step a turn.

The weight of a path is one integer. Its high digits are the cost; below them every turn
has a block of three digits at a fixed place, its edits' letters from the left and zeros
after them. At most two insertions before a turn can be of use, and each block ends with
the turn's own letter, so no block's letters begin another's and the order of the digits
is the order of the audits; insertions at the end come last, where zero sorts the shorter
audit first. The smallest integer is therefore the cheapest path with the least audit,
and equal integers are equal audits, which fix the roles as well.

A conversation may be longer than a task should hold. Turns without their texts are
sorted over all tasks by range, and each task sums up runs of ``RUN`` turns: the smallest
weight from every state to every state. For each conversation the runs are joined by the
same path search, in which a run's letters are replaced by their rank among the run's own
(at most 16), again one digit at a fixed place. Texts are streamed once, in order, when
the repaired turns are made.

Turns are ordered by number, nulls first; equal numbers by a digest of role and text.
Null roles and texts count as one space. Null conversation ids are one conversation.
Texts may have any length; other columns are not read. Empty tables give an empty result.
"""

import hashlib
from itertools import product

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditweir.llm.scratch import cut, tidy
from creditweir.llm.words import slices

#: Turns summed up in one run.
RUN = 512
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of (s?(ua)+)?: nothing yet, after s, after u, after a.
STATES = range(4)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLES = {"u": "user", "a": "assistant"}
#: Insertions that complete a conversation, and what they cost.
CLOSING = {0: (0, ""), 3: (0, ""), 2: (INSERT, "I"), 1: (2 * INSERT, "II")}
#: Letters as digits in their ASCII order; 0 is padding.
LETTERS = "\0DIKR"
DIGIT, BLOCK = 3, 9
SOUND, CUT_OFF, GONE = 0, 1, 2
LEGAL = {"su", "ua", "au"}


def inserted(state: int) -> tuple[int, str]:
    """The state after an inserted turn, and its initial."""
    initial = "a" if state == 2 else "u"
    return NEXT[state, initial], initial


def _block(letters: str) -> int:
    code = 0
    for letter in letters.ljust(BLOCK // DIGIT, "\0"):
        code = code << DIGIT | LETTERS.index(letter)
    return code


def _steps(initial: str, fate: int) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, block) of the best way over one turn."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for start, added in product(STATES, range(BLOCK // DIGIT)):
        state = start
        for _ in range(added):
            state, _ = inserted(state)
        ways = [("D", state, DELETE)]
        if fate != GONE:
            stays = TRUNCATED if fate == CUT_OFF else 0
            ways.append(("K", NEXT.get((state, initial)), KEEP + stays))
            ways += [("R", NEXT.get((state, other)), REROLE + stays) for other in ROLES if other != initial]
        for letter, to, cost in ways:
            if to is not None:
                way = cost + added * INSERT, _block("I" * added + letter)
                best[start, to] = min(way, best.get((start, to), way))
    return [(start, to, *way) for (start, to), way in best.items()]


STEPS = {(initial, fate): _steps(initial, fate) for initial in ("s", "u", "a", "") for fate in (SOUND, CUT_OFF, GONE)}


def shortest(turns: list[tuple[str, int]], start: int) -> dict[int, tuple[int, int]]:
    """(cost, digits) of the smallest path over the turns, from ``start`` to every state it reaches."""
    width = BLOCK * len(turns)
    weights = {start: 0}
    for place, turn in enumerate(turns, 1):
        low = width - BLOCK * place
        reached: dict[int, int] = {}
        for state, to, cost, block in STEPS[turn]:
            if state in weights:
                weight = weights[state] + (cost << width) + (block << low)
                if to not in reached or weight < reached[to]:
                    reached[to] = weight
        weights = reached
    return {state: (weight >> width, weight & ((1 << width) - 1)) for state, weight in weights.items()}


def letters(digits: int, turns: int) -> str:
    """The audit that the digits of ``turns`` blocks spell."""
    octal = f"{digits:0{BLOCK // DIGIT * turns}o}" if turns else ""
    return octal.replace("0", "").translate({ord(str(i)): letter for i, letter in enumerate(LETTERS)})


def joined(runs: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """Cost and audit of the smallest path through the runs of one conversation.

    A run is a list of (from, to, cost, audit); the rank of an audit stands for it. Audits of
    one run rank as their blocks do, since blocks are not the beginnings of others.
    """
    digit = 5
    width = digit * (len(runs) + 1)
    weights, ways = {0: 0}, []
    for place, run in enumerate(runs, 1):
        ranks = {audit: rank for rank, audit in enumerate(sorted({audit for *_, audit in run}))}
        reached: dict[int, int] = {}
        came: dict[int, tuple[int, str]] = {}
        for state, to, cost, audit in run:
            if state in weights:
                weight = weights[state] + (cost << width) + (ranks[audit] << (width - digit * place))
                if to not in reached or weight < reached[to]:
                    reached[to], came[to] = weight, (state, audit)
        weights = reached
        ways.append(came)
    closed = {state: weight + (CLOSING[state][0] << width) + len(CLOSING[state][1]) for state, weight in weights.items()}
    state = min(closed, key=closed.__getitem__)
    cost, parts = closed[state] >> width, [CLOSING[state][1]]
    for came in reversed(ways):
        state, audit = came[state]
        parts.append(audit)
    return cost, "".join(reversed(parts))


def damage(conversations: DataFrame) -> DataFrame:
    """The turns of (conv_id, turn, role, text) after faults that a checksum of their place deals out."""
    blank = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault = F.crc32(place.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    turns = conversations.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("times"),
    )
    return turns.where("times > 0").withColumn("time", F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("times", "time")


def _named(turns: DataFrame) -> DataFrame:
    """Roles and texts without nulls, and the digest that orders and compares them."""
    turns = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    )
    content = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return turns.withColumn("digest", F.unhex(F.md5(content.cast("binary"))))


_RUNS = [
    ("part", "int"), ("run", "int"), ("turns", "int"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"),
    ("first", "string"), ("last", "string"), ("low", "long"), ("high", "long"), ("numbers", "long"), ("ways", "array<struct<start:int,to:int,cost:long,audit:string>>"),
]
_REPORT = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string")]
#: Of turns alike the first sorts before its repetitions.
BLANK, UNENDED, REPEATED = 1, 2, 3


def _schema(id_type: T.DataType, columns: list[tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField("conv_id", id_type), *T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in columns))])


class _Batch:
    """Rows on their way out, as one Arrow batch at a time."""

    def __init__(self, schema: T.StructType, limit: int = 2048):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema, self.rows, self.limit = to_arrow_schema(schema), [], limit

    def add(self, row: tuple):
        self.rows.append(row)
        if len(self.rows) >= self.limit:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(self.schema)]
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)


def _summed(conv_id, part: int, number: int, known: bool, rows: list[tuple]) -> tuple:
    """The row that stands for a run of (turn, initial, fault) rows of one conversation."""
    turns = [(i if i in "sua" else "", GONE if fault in (BLANK, REPEATED) else CUT_OFF if fault else SOUND) for _, i, fault in rows]
    ways = []
    for start in [0] if known else STATES:
        ways += [(start, to, cost, letters(digits, len(turns))) for to, (cost, digits) in shortest(turns, start).items()]
    numbers = [t for t, _, _ in rows if t is not None]
    faults = [f for _, _, f in rows]
    initials = [i for _, i, _ in rows]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    ends = (initials[0], initials[-1]) if rows else (None, None)
    low, high = (numbers[0], numbers[-1]) if numbers else (None, None)
    counts = faults.count(BLANK), faults.count(REPEATED), faults.count(UNENDED)
    return (conv_id, part, number, len(rows), *counts, illegal, *ends, low, high, len(set(numbers)), ways)


def _runs(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each run of turns that lie together in a task."""
    space = r"[\x20\x09-\x0D]"
    earlier = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first()))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when(F.col("earlier") > 1, REPEATED)
        .when(~F.col("ended"), UNENDED)
        .otherwise(0)
    )
    # Texts are judged before the shuffle and stay behind.
    short = turns.select(
        "conv_id", "turn", "digest", F.substring("role", 1, 1).alias("initial"),
        F.col("text").rlike(r"[.!?]" + space + r"*\z").alias("ended"),
        F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), "x").otherwise("").alias("text"),
    )
    judged = short.withColumn("earlier", earlier).select("conv_id", "turn", "digest", "initial", fault.cast("int").alias("fault"))
    id_type = turns.schema["conv_id"].dataType
    named = conversations.select(F.col("conv_id").cast(id_type).alias("conv_id")).distinct()
    markers = named.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit("").alias("initial"), F.lit(-1).alias("fault"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "fault"]
    placed = judged.unionByName(markers).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = _schema(id_type, _RUNS)

    def run(batches):
        part = TaskContext.get().partitionId()
        out = _Batch(schema)
        held, current, number, known, begun = [], None, 0, False, False
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault"))
            for conv_id, turn, initial, fault in zip(*columns):
                other = begun and conv_id != current
                if begun and (other or len(held) == RUN):
                    yield from out.add(_summed(current, part, number, known and number == 0, held))
                    held, number = [], 0 if other else number + 1
                # The first conversation of a task may have begun in another one.
                known = known or other
                begun, current = True, conv_id
                if fault >= 0:
                    held.append((turn, initial, fault))
        if begun:
            yield from out.add(_summed(current, part, number, known and number == 0, held))
        yield out.flush()

    return placed.select("conv_id", "turn", "initial", "fault").mapInArrow(run, schema)


@tidy
def audit(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for every id of ``conversations`` and ``turns``."""
    turns = _named(turns)
    runs = _runs(turns, conversations)
    schema = _schema(turns.schema["conv_id"].dataType, _REPORT)
    names = [f.name for f in runs.schema]

    def close(rows: list[dict]) -> tuple:
        filled = [r for r in rows if r["turns"]]
        sums = {c: sum(r[c] for r in filled) for c in ("blank", "duplicate", "truncated", "illegal", "numbers")}
        sums["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(filled, filled[1:]))
        numbered = [r for r in filled if r["low"] is not None]
        sums["numbers"] -= sum(a["high"] == b["low"] for a, b in zip(numbered, numbered[1:]))
        gaps = numbered[-1]["high"] - numbered[0]["low"] + 1 - sums["numbers"] if numbered else 0
        cost, text = joined([[(w["start"], w["to"], w["cost"], w["audit"]) for w in r["ways"]] for r in filled])
        return (rows[0]["conv_id"], gaps, sums["blank"], sums["duplicate"], sums["truncated"], sums["illegal"], cost, text)

    def run(batches):
        out, held = _Batch(schema), []
        for batch in batches:
            for row in batch.select(names).to_pylist():
                if held and row["conv_id"] != held[0]["conv_id"]:
                    yield from out.add(close(held))
                    held = []
                held.append(row)
        if held:
            yield from out.add(close(held))
        yield out.flush()

    return runs.repartition("conv_id").sortWithinPartitions("conv_id", "part", "run").mapInArrow(run, schema)


def repaired(turns: DataFrame, report: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of what the audits leave, each conversation in order in one task."""
    turns = _named(turns)
    texts = turns.select("conv_id", F.lit(1).alias("side"), "turn", "digest", "role", "text")
    audits = report.select(
        "conv_id", F.lit(0).alias("side"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"),
        F.lit("").alias("role"), F.col("audit").alias("text"),
    )
    order = ["conv_id", "side", F.col("turn").asc_nulls_first(), "digest"]
    placed = texts.unionByName(audits).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "side", "role", "text")
    schema = _schema(turns.schema["conv_id"].dataType, [("place", "long"), ("role", "string"), ("text", "string")])

    def run(batches):
        out = _Batch(schema)
        conv_id, edits, at, state, place = None, "", 0, 0, 0

        def add_inserted():
            nonlocal at, state, place
            while at < len(edits) and edits[at] == "I":
                state, initial = inserted(state)
                yield from out.add((conv_id, place, ROLES[initial], ""))
                at, place = at + 1, place + 1

        for batch in batches:
            for piece in slices(batch, "text"):
                for row in piece.to_pylist():
                    if row["side"] == 0:
                        yield from add_inserted()
                        conv_id, edits, at, state, place = row["conv_id"], row["text"], 0, 0, 0
                        continue
                    yield from add_inserted()
                    edit, at = edits[at], at + 1
                    if edit == "D":
                        continue
                    role = row["role"]
                    if edit == "R":
                        role = ROLES["a" if state == 2 else "u"]
                    state = NEXT[state, role[0]]
                    yield from out.add((conv_id, place, role, row["text"]))
                    place += 1
                if out.rows:
                    yield out.flush()
        yield from add_inserted()
        yield out.flush()

    return placed.mapInArrow(run, schema)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` lines; takes the turns as ``repaired`` hands them on."""
    schema = _schema(turns.schema["conv_id"].dataType, [("repaired_sha256", "string")])

    def run(batches):
        out, current, state = _Batch(schema), None, None
        for batch in batches:
            for piece in slices(batch, "text"):
                for row in piece.to_pylist():
                    if row["place"] == 0:
                        if state:
                            yield from out.add((current, state.hexdigest()))
                        current, state = row["conv_id"], hashlib.sha256()
                    else:
                        state.update(b"\n")
                    state.update(f"{row['role']}:{row['text']}".encode())
        if state:
            yield from out.add((current, state.hexdigest()))
        yield out.flush()

    return turns.mapInArrow(run, schema)


@tidy
def report(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The audit of every conversation with the digest of its repaired turns."""
    audits = cut(audit(turns, conversations))
    found = digests(repaired(turns, audits)).withColumnRenamed("conv_id", "of")
    nothing = hashlib.sha256().hexdigest()
    joined_ = audits.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    return joined_.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(nothing)))
