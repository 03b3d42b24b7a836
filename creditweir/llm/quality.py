"""Operator 4: quality rules by robust multivariate outliers.

Every text gives counts of words, symbols, repeated lines and repeated windows. After
the fixed base rules, a vector of six transformed statistics is judged by its distance
from the robust centre of its language and source: a minimum-covariance-determinant
estimate over ALL texts of the group that pass the base rules, found by concentration
steps from two starts. A concentration step is one aggregation: squared distances fall
into fine logarithmic bins that carry moments, so the subset with the smallest
distances (three quarters of the group) needs neither a sort nor a row collected.

Statistics of short texts scatter more. The estimate holds the scatter at its texts' mean
1 / words; a text with fewer words is judged by the covariance plus ``WORD_VARIANCE`` times
what its own 1 / words exceeds that mean. Both matrices are diagonalised together, so each
text's own covariance costs six divisions. Longer texts are judged by the estimate itself.

Groups below ``MIN_GROUP`` texts are pooled over the sources of a language, then over
languages; a pool that is still smaller judges nothing (kept). Null or empty texts have
no words and fail the base rules. Null languages or sources are a group of their own.
Repeated rows are judged alike, each for itself. Other columns are not read and not returned.
"""

from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweir.llm.scratch import cut, tidy
from creditweir.llm.words import Words, mix, slices, split_words, text_index, texts_of

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_lines"]
#: log word length; square roots of the shares of symbols, capitals, other marks, repeated lines and windows.
VECTOR = ["x0", "x1", "x2", "x3", "x4", "x5"]
P = len(VECTOR)
#: Spread below which a statistic is not told apart, in its transformed unit.
FLOOR = np.array([0.05, 0.05, 0.05, 0.05, 0.10, 0.10])
SHARE, STEPS, MIN_GROUP, BINS_PER_OCTAVE = 0.75, 5, 120, 16
#: Parameter rows, two a group, up to which they are broadcast.
MAX_PARAMS = 20_000
#: Share of ordinary texts that lie beyond the cutoff, were the vectors normal.
TAIL = 1e-6
#: Variance of each statistic in a text of one word, in the order of VECTOR. The root of a share of N independent trials
#: varies by 1 / 4N: five characters a word give 0.05; capitals and marks bunch (names, numbers), repeats come in runs.
WORD_VARIANCE = np.array([0.25, 0.05, 0.10, 0.30, 5.0, 5.0])


def repeated_words(words: Words, width: int = 5) -> np.ndarray:
    """Per text: words inside a window of ``width`` words that the text holds twice or more."""
    codes, starts = words.codes, words.starts
    n = len(codes)
    if n < width:
        return np.zeros(len(starts) - 1, np.int64)
    text = text_index(starts)
    at = np.flatnonzero(text[width - 1 :] == text[: n - width + 1])
    key = mix(text[at].astype(np.uint64) + np.uint64(1))
    for k in range(width):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + codes[at + k].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    left, right = at[order][:-1][same], at[order][1:][same]
    differ = text[left] != text[right]
    for k in range(width):
        differ |= codes[left + k] != codes[right + k]
    if differ.any():  # two windows share a hash: count these slices by their words
        _, group, size = np.unique(
            np.column_stack([text[at], *(codes[at + k] for k in range(width))]), axis=0, return_inverse=True, return_counts=True
        )
        twice = at[size[group.ravel()] > 1]
    else:
        twice = np.concatenate([left, right])
    edge = np.zeros(n + width + 1, np.int32)
    starts_of = np.unique(twice)
    edge[starts_of] += 1
    np.subtract.at(edge, starts_of + width, 1)
    return words.per_text(np.cumsum(edge)[:n] > 0)


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines that hold a word, and those equal to an earlier one."""
    lists = pc.split_pattern(texts, "\n")
    text = text_index(lists.offsets.to_numpy())
    coded = lists.values.dictionary_encode()
    spoken = pc.not_equal(pc.ascii_trim_whitespace(coded.dictionary), "").to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    keep = spoken[codes] if len(codes) else np.zeros(0, bool)
    lines = np.bincount(text[keep], minlength=len(texts))
    distinct = np.unique(text[keep].astype(np.int64) * (len(spoken) + 1) + codes[keep]) // (len(spoken) + 1)
    return lines, lines - np.bincount(distinct, minlength=len(texts))


def count_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The columns of COUNTS."""
    words = split_words(texts)

    def each(values) -> np.ndarray:
        return words.per_text(values.to_numpy(zero_copy_only=False)[words.codes])

    lines, again = _lines(texts)
    return {
        "n_words": np.diff(words.starts),
        "word_chars": each(pc.utf8_length(words.vocabulary)),
        "n_symbols": each(pc.count_substring_regex(words.vocabulary, r"[#*$%&|<>]")),
        "n_dup_lines": again,
        "n_repeat_words": repeated_words(words),
        "n_upper": each(pc.count_substring_regex(words.vocabulary, r"\p{Lu}")),
        "n_letters": each(pc.count_substring_regex(words.vocabulary, r"\p{L}")),
        "n_lines": lines,
    }


def counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, COUNTS) for every row of ``docs``, written once."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                columns = count_texts(texts_of(part, "text"))
                keys = [part.column(c) for c in ("doc_id", "lang", "source")]
                yield pa.record_batch(
                    [*keys, *(pa.array(columns[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", "lang", "source", *COUNTS]
                )

    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")),
        F.col("text").cast("string").alias("text"),
    )
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    return cut(narrow.mapInArrow(count, schema))


def _vectors(table: DataFrame) -> DataFrame:
    """Base verdict and transformed statistics."""
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    marks = F.greatest(F.col("word_chars") - F.col("n_letters") - F.col("n_symbols"), F.lit(0))
    x = [
        F.log((F.col("word_chars") + 1) / words),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_upper") / F.greatest("n_letters", F.lit(1))),
        F.sqrt(marks / chars),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 1)),
        F.sqrt(F.col("n_repeat_words") / words),
    ]
    return table.withColumns({"base_failed": failed, "per_word": 1 / words, **dict(zip(VECTOR, x))})


def _group_keys(table: DataFrame) -> DataFrame:
    """(lang, source, grp): the group that judges a language and source, or null."""
    sizes = table.where(~F.col("base_failed")).groupBy("lang", "source").count()
    own = F.col("count") >= MIN_GROUP
    by_lang = sizes.where(~own).groupBy("lang").agg(F.sum("count").alias("pooled"))
    rest = by_lang.where(F.col("pooled") < MIN_GROUP).agg(F.sum("pooled")).first()[0] or 0  # one number
    keys = table.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").na.fill(0, ["count"])
    groups = keys.join(by_lang, "lang", "left").select(
        "lang",
        "source",
        F.when(own, F.to_json(F.struct("lang", "source")))
        .when(F.col("pooled") >= MIN_GROUP, F.to_json(F.struct("lang")))
        .when(F.lit(rest >= MIN_GROUP), F.lit("{}"))
        .alias("grp"),
    )
    # Written, its size is known: Spark broadcasts it if small, so a hot source is not shuffled into one task.
    return cut(groups)


#: m: centre; a: columns that turn the covariance into the unit matrix and WORD_VARIANCE into the diagonal v.
PARAMS = "grp string, origin int, n long, logdet double, reach double, held double, " + ", ".join(
    [f"m{i} double" for i in range(P)] + [f"a{i}{j} double" for i in range(P) for j in range(P)] + [f"v{i} double" for i in range(P)]
)
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def chi2_quantile(p: float, degrees: int) -> float:
    """Wilson and Hilferty's approximation."""
    c = 2 / (9 * degrees)
    return degrees * (1 - c + NormalDist().inv_cdf(p) * c**0.5) ** 3


def _estimate(grp, origin, n, taken, sums, squares, reach, held):
    """A parameter row from the moments of ``taken`` rows; ``held`` is their mean 1 / words."""
    mean = sums / taken
    cov = np.zeros((P, P))
    for (i, j), s in zip(_PAIRS, squares):
        cov[i, j] = cov[j, i] = s / taken - mean[i] * mean[j]
    cov += np.diag(FLOOR**2)
    spread, axes = np.linalg.eigh(cov)
    whiten = axes / np.sqrt(spread)
    extra, turn = np.linalg.eigh(whiten.T @ np.diag(WORD_VARIANCE) @ whiten)
    logdet = float(np.log(spread).sum())
    return [grp, int(origin), int(n), logdet, float(reach), float(held), *mean, *(whiten @ turn).ravel(), *np.maximum(extra, 0)]


def _columns():
    return [f.split()[0] for f in PARAMS.split(", ")]


def _distance():
    """Squared distance as one generated expression."""
    d = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(VECTOR)]
    short = F.greatest(F.col("per_word") - F.col("held"), F.lit(0.0))
    total = F.lit(0.0)
    for j in range(P):
        z = sum((d[i] * F.col(f"a{i}{j}") for i in range(1, P)), d[0] * F.col(f"a0{j}"))
        total = total + z * z / (1 + short * F.col(f"v{j}"))
    return total


def _small(params: DataFrame) -> DataFrame:
    """``params`` to be broadcast while its rows are at most MAX_PARAMS (10 MB), else as it is, for a shuffled join."""
    return F.broadcast(params) if params.limit(MAX_PARAMS + 1).count() <= MAX_PARAMS else params


def _moments():
    return [F.count("*").alias("taken"), F.sum("per_word").alias("words_"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(VECTOR)),
            *(F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"q{i}{j}") for i, j in _PAIRS)]


_SUMS = [f"s{i}" for i in range(P)]
_SQUARES = [f"q{i}{j}" for i, j in _PAIRS]


def _start(vectors: DataFrame) -> DataFrame:
    """Two starts per group: all rows, and the median with spreads around it."""
    medians = [F.percentile_approx(x, 0.5, 10_000).alias(f"c{i}") for i, x in enumerate(VECTOR)]
    spreads = [F.expr(f"percentile_approx({x}, array(0.25D, 0.75D), 10000)").alias(f"r{i}") for i, x in enumerate(VECTOR)]
    table = vectors.groupBy("grp").agg(*_moments(), *medians, *spreads)

    def build(frames):
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                n = r["taken"]
                held = r["words_"] / n
                rows.append(_estimate(r["grp"], 0, n, n, np.array([r[c] for c in _SUMS]), [r[c] for c in _SQUARES], np.inf, held))
                centre = np.array([r[f"c{i}"] for i in range(P)])
                width = np.array([(r[f"r{i}"][1] - r[f"r{i}"][0]) / 1.349 for i in range(P)])
                second = [centre[i] * centre[j] + (width[i] ** 2 if i == j else 0) for i, j in _PAIRS]
                rows.append(_estimate(r["grp"], 1, n, 1, centre, second, np.inf, held))
            yield pd.DataFrame(rows, columns=_columns())

    return cut(table.mapInPandas(build, PARAMS))


def _concentrate(vectors: DataFrame, params: DataFrame) -> DataFrame:
    """One concentration step for every group and start: a pass over all vectors."""
    bin_ = F.floor(F.log2(1 + _distance()) * BINS_PER_OCTAVE).cast("int")
    joined = vectors.join(_small(params), "grp").withColumn("bin", bin_)
    bins = joined.groupBy("grp", "origin", "bin").agg(*_moments())

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bin")
        total = int(frame["taken"].sum())
        reached = frame["taken"].cumsum().to_numpy()
        last = int(np.searchsorted(reached, SHARE * total)) + 1
        part = frame.iloc[:last]
        taken = int(part["taken"].sum())
        # The expected distance at the subset's edge calibrates the estimate.
        edge = 2 ** ((part["bin"].iloc[-1] + 1) / BINS_PER_OCTAVE) - 1
        expected = chi2_quantile(min(taken / total, 0.999), P)
        row = _estimate(
            frame["grp"].iloc[0], frame["origin"].iloc[0], total, taken,
            part[_SUMS].sum().to_numpy(), part[_SQUARES].sum().to_numpy(), max(1.0, edge / expected),
            part["words_"].sum() / taken,
        )
        return pd.DataFrame([row], columns=_columns())

    # A group and start has at most some hundred bins, whatever its rows.
    return cut(bins.groupBy("grp", "origin").applyInPandas(step, PARAMS))


def robust_estimates(vectors: DataFrame) -> DataFrame:
    """Per group the start with the smaller determinant after all steps."""
    params = _start(vectors)
    for _ in range(STEPS):
        params = _concentrate(vectors, params)
    columns = [c for c in _columns() if c != "grp"]
    best = params.groupBy("grp").agg(F.min_by(F.struct(*columns), F.struct("logdet", "origin")).alias("best"))
    return cut(best.select("grp", "best.*"))


@tidy
def judge(docs: DataFrame) -> DataFrame:
    """COUNTS, distance, base_failed and kept for every row of (doc_id, text, lang, source)."""
    table = _vectors(counts(docs))
    keyed = table.join(_group_keys(table), ["lang", "source"], "left")
    vectors = cut(keyed.select("doc_id", *COUNTS, "base_failed", "grp", "per_word", *VECTOR))
    params = robust_estimates(vectors.where(~F.col("base_failed") & F.col("grp").isNotNull()).select("grp", "per_word", *VECTOR))
    judged = vectors.join(_small(params), "grp", "left").withColumn("distance", _distance() / F.col("reach"))
    near = F.coalesce(F.col("distance") <= chi2_quantile(1 - TAIL, P), F.lit(True))
    return judged.select("doc_id", *COUNTS, "distance", "base_failed", (~F.col("base_failed") & near).alias("kept"))
