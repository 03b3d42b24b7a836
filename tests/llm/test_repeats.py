"""Repeated passages against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from creditweir.llm import repeats
from creditweir.llm.suffixes import suffix_array

FOLDER = "/root/testdata/sf0.001"


def plain(texts, length):
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


def compare(spark, texts, length):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = repeats.digest(repeats.remove(df, length)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == plain([(t or "").encode() for t in texts], length)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_array_equals_sorting(symbols):
    symbols = [*symbols, 0]
    assert suffix_array(np.array(symbols)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_given_documents(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = repeats.digest(repeats.remove(df)).orderBy("doc_id").collect()
    rows = df.orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(r["doc_id"], *x) for r, x in zip(rows, plain([(r["text"] or "").encode() for r in rows], 200))]
    assert sum(r["n_removed"] for r in got) > 0


@pytest.mark.parametrize("group", [repeats.GROUP, 40])
def test_small_alphabet_periods_copies_and_crowded_grams(spark, monkeypatch, group):
    """Crowded grams (any, with 40 bytes) are counted over all tasks and give the same."""
    monkeypatch.setattr(repeats, "GROUP", group)
    random.seed(5)
    texts = ["".join(random.choice("ab") for _ in range(random.randint(0, 60))) for _ in range(120)]
    texts += ["a" * 100, "ab" * 40, None, "", "é" * 30, "é" * 7, "0123456789", "x0123456789y"]
    compare(spark, texts + texts[:15], 10)


def test_small_packs_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PACK", 64)
    monkeypatch.setattr(repeats, "CHUNK", 50)
    random.seed(6)
    line = "".join(random.choice("abcdefgh ") for _ in range(90))
    texts = [f"{random.random()} {line} {random.random()}" for _ in range(40)] + [line * 3, line[:30], line[5:50]]
    compare(spark, texts, 25)


def test_segments_that_follow_each_other_are_sorted_as_one():
    """Joined or alone, the same windows are found."""
    random.seed(8)
    texts = [bytes(random.choice(b"ab") for _ in range(70)) for _ in range(6)]
    rows = []
    for u, text in enumerate(texts):
        for first in (0, 5, 20, 21, 50):
            n = {0: 5, 5: 15, 20: 1, 21: 20, 50: 14}[first]  # a gap before 50
            rows.append({"u": u, "v": 0, "first": first, "windows": n, "times": 1, "content": text[first : first + n + 6]})
    random.shuffle(rows)
    alone = repeats.repeated([r["content"] for r in rows], [np.full(r["windows"], r["times"]) for r in rows], 7)
    assert [x.tolist() for x in repeats.joined(rows, 7)] == [x.tolist() for x in alone]


def test_chunks_hold_every_window_once():
    random.seed(7)
    sizes = [0, 3, 10, 11, 250, 9, 64]
    data = np.frombuffer(bytes(random.randrange(256) for _ in range(sum(sizes))), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    text, first, count, _, _ = repeats.segments(offsets, data, 10)
    windows = Counter((t, f + k) for t, f, n in zip(text.tolist(), first.tolist(), count.tolist()) for k in range(n))
    assert windows == Counter((t, i) for t, n in enumerate(sizes) for i in range(n - 9))


def test_clashing_columns_null_ids_and_no_rows(spark):
    schema = "doc_id long, text string, key long, u string, spans int, removed int, kept int"
    rows = [(None, "same text here", 1, "u", 2, 3, 4), (None, "same text here", 1, "u", 2, 3, 4), (7, "other", None, None, None, None, None)]
    got = repeats.remove(spark.createDataFrame(rows, schema), 5).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in got] == [(None, 14, b""), (None, 14, b""), (7, 5, b"other")]
    assert [tuple(s) for s in got[0]["removed"]] == [(0, 14)]
    assert repeats.digest(repeats.remove(spark.createDataFrame([], schema))).collect() == []
