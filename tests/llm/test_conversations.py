"""Conversation repair against a search over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

from creditweir.llm import conversations
from creditweir.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]")
FOLLOWS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def plain(rows):
    """The report of one conversation's damaged (turn, role, text) rows in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        found = WORD.findall(text)
        faults.append("b" if not found else "d" if (role, text) in seen else "t" if found[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, last, spare):
        ways = [(0, "")] if i == len(rows) and last in ("", "a") else []
        steps = [(5, "I", i, FOLLOWS.get((last, r)), spare - 1) for r in "ua"] if spare else []
        if i < len(rows):
            steps.append((2, "D", i + 1, last, 3))
            if faults[i] not in ("b", "d"):
                stays = 5 if faults[i] == "t" else 0
                steps.append((stays, "K", i + 1, FOLLOWS.get((last, rows[i][1][:1])), 3))
                steps += [(stays + 1, "R", i + 1, FOLLOWS.get((last, r)), 3) for r in "ua"]
        for cost, letter, j, state, left in steps:
            rest = best(j, state, left) if state is not None else None
            if rest:
                ways.append((cost + rest[0], letter + rest[1]))
        return min(ways, default=None)

    cost, audit = best(0, "", 3)
    lines, last, i = [], "", 0
    for letter in audit:
        initial = "a" if last == "u" else "u"
        role, text = {"a": "assistant", "u": "user"}[initial], ""
        if letter != "I":
            _, own, text = rows[i]
            i += 1
            role = own if letter == "K" else role
        if letter != "D":
            last = FOLLOWS[last, role[0]]
            lines.append(f"{role}:{text}")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_given_conversations(spark):
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect():
        rows[r["conv_id"]].append(tuple(r))
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, FOLDER).collect()}
    assert got == {k: plain(sorted(damaged(v), key=lambda r: (r[0] is not None, r[0] or 0))) for k, v in rows.items()}


def hard(seed, conversations_, turns):
    random.seed(seed)
    roles, texts = ["system", "user", "assistant", "", "tool", None, "umpire"], ["Yes.", "No", "", " \t", "Why?", "x y.", None, "a.\n"]
    out = []
    for conv in conversations_:
        numbers = random.sample(range(-3, 3 * turns), random.randint(1, turns))
        out += [(conv, n, random.choice(roles), random.choice(texts)) for n in numbers]
    return out


def test_hard_conversations_in_short_runs(spark, monkeypatch):
    """Runs of three turns are joined by rank; any other length gives the same."""
    rows = hard(1, [None, *range(40)], 14)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    of = defaultdict(list)
    for r in rows:
        of[r[0]].append(r)
    expected = {k: plain(sorted(((t, ro or (" " if ro is None else ""), " " if x is None else x) for _, t, ro, x in v), key=lambda r: r[0])) for k, v in of.items()}
    for run in (3, 512):
        monkeypatch.setattr(conversations, "RUN", run)
        got = {r["conv_id"]: tuple(r)[1:] for r in conversations.report(df, df).collect()}
        assert got == expected


def test_weights_order_audits_as_strings():
    """Digits of fixed blocks compare as the letters they spell."""
    words = ["D", "ID", "IID", "IK", "IIK", "K", "R", "IR", "IIR"]
    pairs = [(a + b, conversations._block(a) << conversations.BLOCK | conversations._block(b)) for a in words for b in words]
    assert [x for x, _ in sorted(pairs)] == [x for x, _ in sorted(pairs, key=lambda p: p[1])]
    assert all(conversations.letters(digits, 2) == text for text, digits in pairs)


def test_long_conversation_over_several_tasks(spark):
    """One conversation holds most rows; its report and repaired turns are whole."""
    random.seed(3)
    n = 4000
    rows = [(1, i, random.choice(["user", "assistant"]), random.choice([f"text {i}.", f"cut {i}", "", "same."])) for i in range(n)]
    df = spark.createDataFrame(rows + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in conversations.audit(df.repartition(8), df).collect()}
    assert got[2]["audit"] == "KK" and got[2]["cost"] == 0
    audit = got[1]["audit"]
    assert len(audit.replace("I", "")) == n
    left = [(r["role"], r["text"]) for r in conversations.repaired(df, conversations.audit(df, df)).where("conv_id = 1").orderBy("place").collect()]
    assert "".join(r[0] for r, _ in left) == "ua" * (len(left) // 2)
    stays = sum(x == "K" or x == "R" for x in audit)
    assert len(left) == stays + audit.count("I")
    kept_cut = sum(5 for (_, _, _, text), edit in zip(rows, audit.replace("I", "")) if edit != "D" and text.startswith("cut"))
    assert got[1]["cost"] == 2 * audit.count("D") + audit.count("R") + 5 * audit.count("I") + kept_cut


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string, side int, digest string, audit string"
    empty = spark.createDataFrame([], schema)
    assert conversations.report(empty, empty).collect() == []
    rows = [(None, None, None, None), (5, None, "user", "A."), (5, None, "user", "A."), (5, 1, "assistant", "x" * 300_000 + "."), (6, 2, "user", "Q?")]
    df = spark.createDataFrame([(*r, 1, "d", "a") for r in rows], schema)
    lost = spark.createDataFrame([(9,), (9,), (None,)], "conv_id long")
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.report(df, df.select("conv_id").unionByName(lost)).collect()}
    nothing = hashlib.sha256().hexdigest()
    assert got[9] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert got[None] == (0, 1, 0, 0, 0, 2, "D", nothing)
    assert got[5][:7] == (0, 0, 1, 0, 1, 2, "KDK")
    assert got[6][:7] == (0, 0, 0, 0, 0, 2, "D", )
