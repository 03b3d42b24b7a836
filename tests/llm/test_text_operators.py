"""The text operators against brute force, and their edge cases."""

import html
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from creditweir.llm import decontamination, language, licences, near_copies, packing, pages, quality, queries, shards, token_files, urls
from creditweir.llm.components import components
from creditweir.llm.scratch import cut, small_batches
from creditweir.llm.tokens import default_vocabulary, encoder

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash long, uid string"
LONG = "the quick brown fox jumps over the lazy dog again and again until evening comes " * 400


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing columns."""
    rows = [
        (1, "A plain text of some ordinary words that nobody would want to lose here.", "en", "s"),
        (1, "A plain text of some ordinary words that nobody would want to lose here.", "en", "s"),
        (2, "A plain text of some ordinary words that nobody would want to lose here!", "en", None),
        (3, None, None, None),
        (4, "", "en", "s"),
        (None, "word", "en", "s"),
        (None, None, None, None),
        (5, LONG, "en", "s"),
        (6, "\n\t  \x0b", "fr", "s"),
        (7, "don't 's <|endoftext|> x́ ÀÉ ß １２ \x01 #$ <|startoftext|>", "fr", "s"),
        (8, "Ὀδυσσεύς ΣΑΣ İstanbul Å éclair, naïve?! 3rd a.b.c 日本語 text", "fr", "s"),
    ]
    return spark.createDataFrame([(*r, None, 7, "x") for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def plain_ids(texts, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*e.ids, end] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4"))


@pytest.mark.parametrize("table", ["odd", "given", "none"])
def test_token_files(spark, request, tmp_path, table):
    docs = request.getfixturevalue(table)
    manifest = token_files.write_token_files(docs, str(tmp_path), default_vocabulary(), end_id=2, length=64)
    got = token_files.read_documents(manifest).collect()
    rows = docs.select("doc_id", "text").collect()
    ids = plain_ids([r.text for r in rows], 2)
    assert Counter((g.doc_id, g.n_tokens, g.ids_crc32) for g in got) == Counter((r.doc_id, len(i), crc(i)) for r, i in zip(rows, ids))
    at = 0
    ordered = sorted(got, key=lambda g: g.start)
    for g in ordered:
        assert g.start == at
        at += g.n_tokens
    assert [g.doc_id or -1 for g in ordered] == sorted(g.doc_id or -1 for g in got)


def test_sequences_are_reached_at_random(spark, given, tmp_path):
    manifest = token_files.write_token_files(given, str(tmp_path), default_vocabulary(), length=100).collect()
    one = max(manifest, key=lambda m: m.n_tokens)
    tokens = token_files.TokenFile(one.tokens_file)
    whole = tokens.ids(0, one.n_tokens)
    last = (one.n_tokens - 1) // 100
    for k in (0, last // 2, last):
        ids, mask = tokens.sequence(k)
        real = min(100, one.n_tokens - 100 * k)
        assert len(ids) == 100 and mask.to_pylist() == [i < real for i in range(100)]
        assert ids.to_pylist()[:real] == whole[100 * k : 100 * k + real].tolist()


def test_encoder_forgets_and_goes_on(monkeypatch):
    texts = ["one two, three four", "Two 's don't\tend", "five. six seven eight " * 50]
    monkeypatch.setattr("creditweir.llm.tokens.CACHED_WORDS", 4)
    own = encoder.__wrapped__(default_vocabulary())
    for _ in range(2):
        for text in texts:
            ids, starts = own.encode(pa.array([text]), 9)
            assert ids.tolist() == plain_ids([text], 9)[0] and starts.tolist() == [0, len(ids)]


@pytest.mark.parametrize("table", ["odd", "given", "none"])
def test_packing(spark, request, table):
    docs = request.getfixturevalue(table)
    got = packing.pack(packing.pieces(docs, default_vocabulary(), 0, capacity=512), capacity=512).collect()
    rows = docs.select("doc_id", "text").collect()
    want = Counter()
    for r, ids in zip(rows, plain_ids([r.text for r in rows], 0)):
        for k in range(0, len(ids), 512):
            part = ids[k : k + 512]
            want[(r.doc_id, k // 512, k, len(part), crc(part))] += 1
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    bins = defaultdict(list)
    for g in got:
        bins[g.sequence_id].append((g.offset, g.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    lengths = np.array([g.length for g in got], np.int64)
    assert len(bins) <= packing.lower_bound(lengths, 512) * 1.01 + 1


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 100, 300)
    members = packing.evolve(lengths, packing.seeds(lengths, 100, rng, 4), 100, rng)
    for bins in members:
        assert len(bins) == 300 and np.bincount(bins, weights=lengths).max() <= 100
    assert packing.lower_bound(np.array([60, 60, 60, 40]), 100) == 3
    assert packing.lower_bound(np.array([], np.int64), 100) == 0


@pytest.mark.parametrize("table", ["odd", "given", "none"])
def test_shards(spark, request, tmp_path, table):
    docs = request.getfixturevalue(table)
    placed = cut(shards.shard(docs, limit=4000))
    rows = placed.collect()
    assert len(rows) == docs.count()
    size = Counter()
    for r in rows:
        size[r.shard] += r.n_bytes
        assert len(r.shard) == r.depth and r.n_bytes == len((r.row.text or "").encode())
    for r in rows:
        assert r.shard_bytes == size[r.shard] and r.oversized == (size[r.shard] > 4000)
        # A bucket split because its parent was over the limit.
        if r.depth:
            assert sum(v for k, v in size.items() if k.startswith(r.shard[:-1])) > 4000
        if r.oversized:
            assert len({(q.row.doc_id, q.row.text) for q in rows if q.shard == r.shard and q.n_bytes}) == 1
    if rows:
        shards.write(placed, str(tmp_path / "out"), limit=4000)
        back = spark.read.parquet(str(tmp_path / "out")).select("row.*")
        assert Counter(map(tuple, back.collect())) == Counter(map(tuple, docs.select(back.columns).collect()))


def test_shards_keep_columns_of_any_name(spark, tmp_path):
    names = ["part", "Bucket", "hash", "depth", "n_bytes", "shard", "row", "cell", "oversized"]
    docs = spark.createDataFrame([(i, "text " * (i + 1), *[f"{n} {i}" for n in names]) for i in range(60)], ["doc_id", "text", *names])
    shards.write(shards.shard(docs, limit=900), str(tmp_path / "out"), limit=900)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("shard").distinct().count() > 2
    assert sorted(map(tuple, back.select("row.*").collect())) == sorted(map(tuple, docs.collect()))


def test_pages_against_their_article(spark):
    table = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r.page_id: r for r in pages.extract(table).collect()}
    for r in table.collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        inner = re.sub("<[^>]*>", "", re.sub("</?(?:p|h1|br)>", " ", inner))
        want = " ".join(html.unescape(inner).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("<p>", ""),
        ("no markup &amp; two\n lines", "no markup & two lines"),
        ("<article><h1>T</h1><p>a<b>b</b>&nbsp;c<p>d<br>e</article><footer>x</footer>", "T ab c d e"),
        ("<article><p>a</p><aside>x</aside><div class='comments'><p>y</p></div><p>b</p></article>", "a b"),
        ("<article><header><h1>T</h1></header><p>a</p><form><p>f</p></form></article><div id=sidebar>s", "T a"),
        ("<article><p>a<script>if (1 < 2) document.write('</p>')</script></p><p>b</article>", "a b"),
        ("<div class='cookie-notice'>c</div><main><p>a</main>", "a"),
        ("<article><p>a <!-- x > y --> b</p><p title='1 > 0'>c</p></article", "a b c"),
    ],
)
def test_page_cases(page, text):
    assert pages.main_text(page) == text


def test_surge_and_dive_on_pages_without_an_article():
    body = "<p>" + "A long paragraph of the page's own text. " * 6 + "</p>"
    menu = "".join(f"<li><a href=/{i}>entry {i}</a></li>" for i in range(8))
    got = pages.main_text(f"<ul>{menu}</ul>{body}<p>short</p>{body}<ul>{menu}</ul>")
    assert "entry" not in got and "short" in got and got.count("own text") == 12


def test_marked_wrappers_do_not_void_the_article():
    body = "<p>" + "The article's own text. " * 9 + "</p>"
    want = ("The article's own text. " * 9).strip()
    for mark in ("class='site has-sidebar'", "id='page-modal'", "class='post social'"):
        for name in ("main", "article"):
            page = f"<div {mark}><div class=menu>entry</div><{name}>{body}<div class=ad>buy</div></{name}></div><div class=comments>no</div>"
            assert pages.main_text(page) == want
    comment = f"<div class=comments><article>{'so true ' * 90}</article></div>"
    assert pages.main_text(f"<article>{body}</article>{comment}") == want
    assert pages.main_text(f"<div>{body * 6}</div>{comment}").count("own text") == 54
    assert "so true" not in pages.main_text(f"<div>{body * 6}</div>{comment}")


def test_page_rows(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<p>x</p>"), (2, "u", "<p>x</p>"), (3, "v", "<p>" + "w " * 50_000)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id or 0), r.n_chars) for r in got) == [(0, 0), (1, 0), (2, 1), (2, 1), (3, 99_999)]


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    again = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(5)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(again), failed


@pytest.mark.parametrize("table", ["odd", "given", "none"])
def test_quality_counts(request, table):
    docs = request.getfixturevalue(table)
    got = quality.judge(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter(
        (r.doc_id, *plain_counts(r.text)) for r in docs.collect()
    )
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_estimate_and_verdict(spark):
    """Outliers go, ordinary texts of a contaminated group stay; the estimate equals one in numpy."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words, 120)), "en", "s", None) for i in range(400)]
    rows += [(1000 + i, " ".join(w + "###$$$" for w in rng.choice(words, 120)), "en", "s", None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert all(got[i].kept for i in range(400)) and not any(got[1000 + i].kept for i in range(60))
    vectors = quality._vectors(quality.counts(docs)).withColumn("grp", quality.F.lit("g"))
    estimate = quality.robust_estimates(vectors.select("grp", "per_word", *quality.VECTOR)).first()
    x = np.array([[r[c] for c in quality.VECTOR] for r in vectors.collect()])
    subset = x[np.argsort(x[:, 1])[: int(0.75 * len(x))]]  # start from texts without symbols
    for _ in range(20):
        inverse = np.linalg.inv(np.cov(subset.T, bias=True) + np.diag(quality.FLOOR**2))
        d = np.einsum("ij,jk,ik->i", x - subset.mean(0), inverse, x - subset.mean(0))
        subset = x[np.argsort(d, kind="stable")[: int(np.ceil(0.75 * len(x)))]]
    assert np.allclose([estimate[f"m{i}"] for i in range(6)], subset.mean(0), atol=0.02)


def test_quality_distances_and_lengths(spark):
    """Distances equal those of each text's own covariance, inverted in numpy; symbol lists go and ordinary texts stay at every length."""
    rng = np.random.default_rng(5)
    words = np.array(["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(3000)])
    lengths = [40, 80, 150, 400]
    rows = [(i, " ".join(rng.choice(words, lengths[i % 4], replace=False))) for i in range(600)]
    lists = [" ".join(w + "#|" * (k % 2) for k, w in enumerate(rng.choice(words, n, replace=False))) for n in lengths for _ in range(10)]
    rows += [(1000 + i, text) for i, text in enumerate(lists)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert all(got[i].kept for i in range(600)) and not any(got[1000 + i].kept for i in range(40))

    vectors = quality._vectors(quality.counts(docs)).withColumn("grp", quality.F.lit("g")).where("not base_failed")
    p = quality.robust_estimates(vectors.select("grp", "per_word", *quality.VECTOR)).first()
    axes = np.array([[p[f"a{i}{j}"] for j in range(6)] for i in range(6)])
    covariance = np.linalg.inv(axes @ axes.T)
    for r in vectors.collect():
        own = covariance + np.diag(quality.WORD_VARIANCE) * max(0.0, 1 / r.n_words - p.held)
        d = np.array([r[c] for c in quality.VECTOR]) - [p[f"m{i}"] for i in range(6)]
        want = d @ np.linalg.inv(own) @ d / p.reach
        assert got[r.doc_id].distance == pytest.approx(want, rel=1e-6, abs=1e-9)
        assert got[r.doc_id].kept == (want <= quality.chi2_quantile(1 - quality.TAIL, 6))


def plain_sets(rows, width):
    out = []
    for text in rows:
        words = WORD.findall(lower(text or ""))
        out.append(frozenset(zip(*(words[k:] for k in range(width)))) if len(words) >= width else frozenset([tuple(words)] if words else []))
    return out


def plain_groups(ids, sets, percent):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    smallest = {root: min((x for x in members if x is not None), default=None) for root, members in groups.items()}
    return [smallest[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("table, width", [("odd", 2), ("given", 2), ("given", 5), ("none", 2)])
def test_near_copies(request, table, width):
    docs = request.getfixturevalue(table)
    rows = docs.collect()
    sets = plain_sets([r.text for r in rows], width)
    want = plain_groups([r.doc_id for r in rows], sets, 80)
    got = near_copies.near_copies(docs, width, 80).collect()
    assert Counter((g.doc_id, g.n_shingles, g.component_id, g.kept) for g in got) == Counter(
        (r.doc_id, len(s), c, r.doc_id == c) for r, s, c in zip(rows, sets, want)
    )


def test_a_group_of_near_copies_and_its_fringe(spark, monkeypatch):
    """Chains and stragglers of one base: small groups and blocks, so that both are split."""
    monkeypatch.setattr(near_copies, "GROUP", 5)
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(90):
        words = list(base)
        for at in rng.choice(100, rng.integers(0, 14), replace=False):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_groups([r[0] for r in rows], plain_sets([r[1] for r in rows], 2), 80)
    got = {g.doc_id: g.component_id for g in near_copies.near_copies(docs, 2, 80).collect()}
    assert [got[i] for i in range(90)] == want and len(set(want)) > 1


def test_classes_fetch_only_their_own_text(spark, monkeypatch):
    """Sixty texts under one id, and sixty under null: none is fetched for another's class."""
    fetched = []

    def spy(df):
        out = cut(df)
        if out.columns == ["cid", "digest", "text"]:
            fetched.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "cut", spy)
    rows = [(7 if i < 60 else None, " ".join([*(f"w{i // 2}y{k}" for k in range(60)), f"end{i}"])) for i in range(120)]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert Counter((g.doc_id, g.component_id) for g in got) == {(7, 7): 60, (None, None): 60}
    assert sum(fetched) == 120


def components_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[find(a)] = find(b)
    return {n: min(m for m in nodes if find(m) == find(n)) for n in nodes}


@pytest.mark.parametrize("spread", [20, 45, 60])
def test_round_two_joins_what_full_sets_join(spread):
    """Differences from a pivot give the components of all full sets, in fewer rows than members."""
    rng = np.random.default_rng(spread)
    pivot = np.unique(rng.integers(0, 2**62, 300).astype(np.uint64))
    more = rng.integers(2**62, 2**63, 60).astype(np.uint64)
    sets = [pivot]
    for _ in range(150):
        gone = rng.choice(len(pivot), rng.integers(0, spread), replace=False)
        sets.append(np.unique(np.r_[np.delete(pivot, gone), rng.choice(more, rng.integers(0, spread), replace=False)]))
    comp = [0, *(i if rng.random() < 0.7 else 0 for i in range(1, len(sets)))]
    # Those said to be in the pivot's component are linked to it, whatever they are.
    frame = pd.DataFrame(
        {
            "key": 0, "first": 0, "cid": range(len(sets)), "comp": comp, "i": 0, "j": 0,
            "base": [np.nan, *[float(len(pivot))] * (len(sets) - 1)],
            "lacks": [np.setdiff1d(pivot, x).tobytes() for x in sets],
            "beyond": [np.setdiff1d(x, pivot).tobytes() for x in sets],
        }
    )
    given_ = [(i, 0) for i, c in enumerate(comp) if c == 0]
    alike = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))]
    out = pd.concat([x for x in near_copies._blocks(80)(frame[k : k + 40] for k in range(0, len(frame), 40))])
    got = list(out.itertuples(index=False, name=None))
    assert set(got) <= {(min(p), max(p)) for p in alike}
    nodes = range(len(sets))
    assert components_of(nodes, given_ + got) == components_of(nodes, given_ + alike)
    assert len(got) < len(set(comp))


def test_a_large_group_without_a_common_pivot(spark, monkeypatch):
    """Two thousand texts around many centres, pairwise near the threshold: brute force gives the same."""
    monkeypatch.setattr(near_copies, "BLOCK", 128)
    rng = np.random.default_rng(11)
    base = np.array([f"w{i}" for i in range(200)])
    rows = []
    for i in range(2000):
        words = base.copy()
        at = rng.choice(200, rng.integers(6, 16), replace=False)
        words[at] = [f"v{i % 50}x{a}" if rng.random() < 0.5 else f"u{i}x{a}" for a in at]
        rows.append((i, " ".join(words)))
    got = {g.doc_id: g.component_id for g in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    sets = plain_sets([t for _, t in rows], 2)
    number = {x: k for k, x in enumerate({x for s in sets for x in s})}
    table = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        table[i, [number[x] for x in s]] = 1
    common, sizes = table @ table.T, table.sum(axis=1)
    alike = np.argwhere(np.triu(100 * common >= 80 * (sizes[:, None] + sizes - common), 1)).tolist()
    label = list(range(len(rows)))
    for a, b in alike:  # labels shrink to the smallest
        if label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    assert [got[i] for i in range(len(rows))] == label
    assert 1 < len(set(label)) < len(rows)


def test_sketch_estimates_similarity_for_any_size():
    rng = np.random.default_rng(2)
    for n in (1, 3, 40, 5000):
        common = rng.integers(0, 2**63, n).astype(np.uint64)
        left = np.concatenate([common, rng.integers(0, 2**63, n // 4).astype(np.uint64)])
        table = near_copies.sketch([common, left, common[:0]])
        assert (table[:2] != near_copies._EMPTY).all() and (table[2] == near_copies._EMPTY).all()
        assert abs((table[0] == table[1]).mean() - n / len(left)) < 5 * (0.25 / near_copies.BINS) ** 0.5


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 70)], "a long, b long")
    labels = {r.node: r.label for r in components(edges).collect()}
    assert {labels[i] for i in range(1, 41)} == {1} and labels[100] == labels[70] == 50
    assert components(edges.limit(0)).count() == 0


def test_licences(spark, odd, none):
    notice = licences.TEMPLATES["apache-2.0-notice"]
    half = len(notice) // 2
    rows = [
        (1, "Some prose.\nLicensed under the Apache License, Version 2.0.\nMore."),
        (2, f"First.\n\n{notice[:half]}\n{notice[half:]}\n\nLast."),
        (3, "Nothing to see\nhere."),
        (4, licences.TEMPLATES["mit"].upper()),
    ]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.unit, r.unit_no, r.licence) for r in got}
    assert (1, "line", 1, "apache-2.0-line") in found and (2, "paragraph", 1, "apache-2.0-notice") in found
    assert (4, "text", 0, "mit") in found and not [r for r in got if r.doc_id == 3]
    assert licences.scan(none).count() == 0 and licences.scan(odd).count() == 0


def test_licences_inside_longer_texts(spark):
    """Licences of several paragraphs and within sentences; full texts; two copies; a window per copy."""
    words = licences.TEMPLATES["mit"].split()
    mit = "\n\n".join(" ".join(words[a:b]) for a, b in ((0, 70), (70, 92), (92, None)))
    prose = " ".join(f"word{i}" for i in range(300))
    long_prose = " ".join(f"word{i}" for i in range(2000))
    rows = [
        (1, f"{prose}\n\n{mit}\n\n{prose}"),
        (2, f"{prose}. This project is released under the MIT License and {prose}"),
        (3, f"{long_prose}\n{licences.TEMPLATES['apache-2.0']}\n{long_prose}"),
        (4, f"{prose}\n\n{mit}\n\n{prose}\n\n{mit}\n\n{prose}"),
        (5, f"{prose} {licences.TEMPLATES['bsd-3-clause']} {prose}"),
        (6, prose),
        (7, f"{prose}\nLicensed under the MIT License.\n{prose}"),
    ]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = Counter((r.doc_id, r.unit, r.licence) for r in got)
    assert found[1, "window", "mit"] == found[2, "window", "mit-line"] == found[3, "window", "apache-2.0"] == 1
    assert found[4, "window", "mit"] == 2 and found[5, "window", "bsd-3-clause"] == 1
    assert found[7, "line", "mit-licensed-line"] == 1 and not found[7, "window", "mit-licensed-line"]
    assert not [r for r in got if r.doc_id == 6]
    assert {r.unit_no for r in got if r.doc_id == 1 and r.licence == "mit"} == {300}


def test_licences_against_all_pairs(given):
    def bigrams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return set(zip(words, words[1:]))

    templates = {k: bigrams(v) for k, v in licences.TEMPLATES.items()}
    want = set()
    for r in given.collect():
        text = r.text or ""
        units = [("text", 0, text), *(("line", i, x) for i, x in enumerate(text.split("\n")))]
        units += [("paragraph", i, x) for i, x in enumerate(x for x in re.split(r"\n[ \t\r\x0b\x0c]*\n", text) if x.strip())]
        for kind, i, unit in units:
            own = bigrams(unit)
            for name, other in templates.items():
                if own and 200 * len(own & other) >= 80 * (len(own) + len(other)):
                    want.add((r.doc_id, kind, i, name, len(own & other), len(own), len(other)))
    assert {tuple(r) for r in licences.scan(given).collect()} == want and want


def test_language_on_held_out_texts(spark):
    got = {r.doc_id: r for r in queries.op7_language(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    held = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in docs)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.98
    assert all(0 <= g.score <= 1 for g in got.values())


def test_language_cases(spark, odd, none, given):
    model = language.train(given)
    judged = language.predict(odd, model).collect()
    assert len(judged) == odd.count()
    for r in judged:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in model.languages
    assert {r.lang_pred for r in language.predict(odd, language.train(none)).collect()} == {"und"}
    assert language.predict(none, model).count() == 0


def test_bloom_filter_holds_every_learned_gram():
    keys = language.mix(np.arange(1, 5000, dtype=np.uint64))
    bits = np.zeros((5000 * 8, 1), np.uint8)
    bits[language.positions(keys, len(bits)).ravel()] |= 1
    model = language.Model(["a"], bits, np.array([0.1]))
    assert language.masks(model, keys).all()
    assert language.masks(model, language.mix(np.arange(10**6, 10**6 + 2000, dtype=np.uint64))).mean() < 0.1


def plain_contamination(docs, items, window):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    owners = defaultdict(set)
    for item, text in items:
        words = pattern.findall(lower(text or ""))
        if words:
            for i in range(max(1, len(words) - window + 1)):
                owners[tuple(words[i : i + window])].add(str(item))
    out = Counter()
    for doc, text in docs:
        words = pattern.findall(lower(text or ""))
        hit, named = set(), set()
        for n in {len(g) for g in owners}:
            for i in range(len(words) - n + 1):
                if found := owners.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    named |= found
        out[(doc, len(words), len(hit), tuple(sorted(named)))] += 1
    return out


@pytest.mark.parametrize("part_words", [500_000, 40])
def test_decontamination_cases(spark, odd, none, monkeypatch, part_words):
    monkeypatch.setattr(decontamination, "PART_WORDS", part_words)
    items = [(1, LONG), (2, "ordinary WORDS"), (3, None), (4, ""), (2, "ordinary words"), (9, "lazy"), (10, "日本語 text"), (11, "no such thing at all")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contamination(odd, benchmark).collect()
    got = Counter((r.doc_id, r.n_words, sum(e - b for b, e in decontamination.merge(list(zip(r.begins, r.ends)))), tuple(r["items"])) for r in found)
    assert got == plain_contamination([(r.doc_id, r.text) for r in odd.collect()], items, 10)
    digests = decontamination.digest(decontamination.contamination(odd, benchmark)).collect()
    assert Counter((r.doc_id, r.n_hit) for r in digests) == Counter({k: 0 for k in ()}) + Counter((a, c) for (a, _, c, _), n in got.items() for _ in range(n))
    assert decontamination.contamination(none, benchmark).count() == 0
    assert not any(r.begins for r in decontamination.contamination(odd, benchmark.limit(0)).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a x b c d"), (3, "a x y z b c d")], "doc_id long, text string")
    phrases = decontamination.Phrases(["a", "b", "c"], [[0, 1, 2]], [["i"]])
    index = decontamination.build_index(docs)
    assert {r.doc_id for r in decontamination.search(index, [phrases], 0, every=False).collect()} == {1}
    assert {r.doc_id for r in decontamination.search(index, [phrases], 1, every=False).collect()} == {1, 2}


def test_index_rows_come_few_at_a_time(spark):
    """Segments of megabytes: none shares a row group or a worker's batch with many others."""
    text = "array_join(transform(sequence(1, 300000), k -> concat('w', id, 'x', k)), ' ')"
    docs = spark.range(8, numPartitions=1).selectExpr("id AS doc_id", f"{text} AS text")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    index = decontamination.build_index(docs)
    written = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.inputFiles()]
    groups = [m.row_group(k) for m in written for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 8
    assert max(g.total_byte_size for g in groups) < 16 << 20
    assert index.dtypes == [("segment", "binary")]
    sizes = docs.mapInArrow(lambda batches: (pa.record_batch([[b.num_rows]], names=["n"]) for b in batches), "n long")
    with small_batches(spark):
        assert max(r.n for r in sizes.collect()) < 8
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_urls(spark):
    names = [None, "", "no scheme/net/", "http://net/", "http://a.b.net/x", "http://A.EXAMPLE.net/en/1?x#y", "http://example.net/de/",
             "http://notexample.com/de/", "http://example.com/de/#a", "http://x.org/fr/", "http://x.org/fr", "http://net", "ftp://net?a/"]
    pages_ = spark.createDataFrame(list(enumerate(names)), "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages_, labels, queries.URL_RULES).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("net", "/", "net/", "block") and got[4] == ("a.b.net", "/x", "net/", "block")
    assert got[5] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[6][2:] == ("net/", "block")
    assert got[7][2:] == (None, "allow") and got[8][2:] == ("example.com/de/", "block")
    assert got[9][2:] == ("org/fr/", "allow") and got[10][2:] == (None, "allow") and got[11] == ("net", "", None, "allow")
    assert got[12] == ("net", "", None, "allow")


def test_mined_url_rules(spark):
    rows, marks = [], []
    for i in range(200):
        bad = i % 4 == 0
        rows.append((i, f"http://{'casino' if bad else 'shop'}-{'abcdefgh'[i % 8]}.org/{'win' if i % 8 == 0 else 'read'}/{i}"))
        marks.append((i, bad))
    rows += [(1000, "http://x.org/win/9"), (1001, "http://x.org/read/9")]
    pages_ = spark.createDataFrame([(a, b, 1) for a, b in rows], "page_id long, url string, tokens long")
    judged = {r.page_id: r for r in urls.judge(pages_, spark.createDataFrame(marks, "page_id long, bad boolean"), []).collect()}
    assert judged[1000].verdict == "block" and judged[1000].confidence == 1.0 and judged[1001].verdict == "allow"
    assert all(judged[i].verdict == "allow" for i in range(1, 200, 2))


def test_pipeline_stages(spark, odd, none):
    """Every stage on odd rows, with the columns of documents, and on nothing."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, FOLDER)
        assert set(odd.columns) <= set(kept.columns), name
        assert stage(spark, none, FOLDER).count() == 0
    once = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, odd, FOLDER).collect()]
    assert once.count(1) == 1 and 2 not in once and 8 in once
    assert corpus_pipeline.pack_sequences(spark, none, FOLDER).count() == 0


def test_pipeline_against_plain_stages(spark, given):
    judged = {r.doc_id: r for r in language.predict(given, language.train(given.select("text", "lang"))).collect()}
    docs = cut(corpus_pipeline.identify_language(spark, given, FOLDER))
    rows = given.collect()
    want = {r.doc_id for r in rows if judged[r.doc_id].lang_pred != "und" and judged[r.doc_id].score >= corpus_pipeline.LEAST_SCORE}
    assert {r.doc_id for r in docs.collect()} == want
    kept = {r.doc_id for r in quality.judge(docs).collect() if r.kept}
    docs = cut(corpus_pipeline.apply_quality(spark, docs, FOLDER))
    assert {r.doc_id for r in docs.collect()} == kept
    rows = docs.collect()
    groups = plain_groups([r.doc_id for r in rows], plain_sets([r.text for r in rows], 5), 80)
    docs = cut(corpus_pipeline.drop_near_copies(spark, docs, FOLDER))
    assert {r.doc_id for r in docs.collect()} == set(groups)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {k[0] for k in plain_contamination([(r.doc_id, r.text) for r in docs.collect()], items, 10) if not k[2]}
    docs = cut(corpus_pipeline.remove_contaminated(spark, docs, FOLDER))
    assert {r.doc_id for r in docs.collect()} == clean
    packed = corpus_pipeline.pack_sequences(spark, docs, FOLDER).collect()
    assert {r.doc_id for r in packed} == clean
