"""Operator 9, quality rules by robust multivariate outliers.

Every document gets whole-text statistics. Per language and source, a minimum-covariance-determinant
estimate describes the bulk of their transformed vectors, and documents far from their group's centre
(Mahalanobis distance) are rejected:

1. Three deterministic starts: medians with absolute deviations, mean and covariance of all, and the
   correlations of the standardised coordinates after a hyperbolic tangent.
2. Concentration steps from each: the half of the group that is nearest by the current distances gives
   the next centre and covariance, until the determinant falls no more. It falls or stops, so the steps end.
3. The start with the least determinant stays. It is reweighted: centre and covariance once more, of
   all documents within the 97.5 % distance of a normal bulk.

Coordinates are whole numbers of 1/1024 and distances are ranked in bins of 0.3 %, so sums and medians
are exact and no verdict depends on how rows are partitioned. Every step is a grouped aggregate over all
documents (sums of products, a median over bins), so a group that holds a third of all rows is summed
where it lies and only 21 numbers a group and start move.

The covariance is regularised: by ``FLOOR``, a spread too small to see, and by ``PRIOR_ROWS`` rows of
fixed spread ``PRIOR`` beside the group's own, which weigh much in a group of ten and nothing in one of
thousands (no switch by size).

Base rules (fixed): fewer than 50 words, or more than half of the words in repeated 3-word windows.

Results for odd input: null and empty texts have zero words and fail the base rules; null language
or source forms a group of its own; a small group is estimated by itself like any other (a group of one
document keeps it if the base rules do); repeated rows count each; an empty table gives an empty result.
Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcases.llm.common import stage

MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
#: chi-square quantile (5 degrees, 1 - 1e-9): beyond it the bulk's own members are not expected
CUTOFF = 50.5
#: chi-square quantile (5 degrees, 0.975) of the reweighting
NEAR = 12.83
#: consistency of the covariance of the nearest half, and of all within NEAR, for a 5-dimensional normal bulk
HALF_SCALE, NEAR_SCALE = 1.91, 1.056
#: coordinates: length in words, length of a word, symbols, repeated lines, repeated words. The floor is a tenth of the
#: length, a fiftieth of a word's, a symbol in a thousand characters, a line in a hundred, two words in a hundred
FLOOR = (0.1, 0.02, 0.1, 0.1, 0.15)
PRIOR, PRIOR_ROWS = (1.5, 0.15, 0.35, 0.1, 0.15), 10
UNIT, BINS = 1024, 256
STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
STATS_ONLY = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
X = ["x0", "x1", "x2", "x3", "x4"]
Z = ["z0", "z1", "z2", "z3", "z4"]
ESTIMATE = "lang string, source string, start int, m array<double>, w array<double>, logdet double"
GROUP = ["lang", "source"]


def text_stats(raw: bytes | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of a text."""
    if not raw:
        return 0, 0, 0, 0, 0, 0
    words = raw.split()
    chars = sum((len(raw), -sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))))
    if not raw.isascii():     # code points: bytes that do not continue one
        chars -= int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    n = len(words)
    repeated = 0
    if n > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        pairs = ids[:-1] * len(number) + ids[1:]
        if len(number) >= 2_000_000:                 # keep the product of three within 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        triples = pairs[:-1] * len(number) + ids[2:]
        _, back, times = np.unique(triples, return_inverse=True, return_counts=True)
        at = np.flatnonzero(times[back] > 1)
        if len(at):
            mask = np.zeros(n, bool)
            for k in range(3):
                mask[at + k] = True
            repeated = int(mask.sum())
    return n, chars, sum(raw.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines)


def _stats(docs: DataFrame, id_col, text_col, lang_col, source_col) -> DataFrame:
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                      F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    names = [c.split()[0] for c in STATS.split(", ")][3:]

    def run(it: Iterator[pa.RecordBatch]):
        for batch in it:
            rows = [text_stats(t) for t in batch.column(3).cast(pa.binary()).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.int64()) for c in cols)],
                                             ["doc_id", "lang", "source", *names])
    return src.mapInArrow(run, STATS)


def _vector() -> list[Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [F.log1p("n_words"), F.log(chars / n), F.log1p(100.0 * F.col("n_symbols") / chars),
            F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
            F.sqrt(F.col("n_repeat_words") / n)]


def _sums(names: list[str]) -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(x).alias(f"s{x}") for x in names),
            *(F.sum(F.col(a) * F.col(b)).alias(f"p{a}{b}") for i, a in enumerate(names) for b in names[i:])]


def _moments(r: dict, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance out of a row of sums, exact up to their last division."""
    n, c = int(r["n"]), np.empty((5, 5))
    sums = [int(r[f"s{x}"]) for x in names]
    for i, a in enumerate(names):
        for j in range(i, 5):
            c[i, j] = c[j, i] = (n * int(r[f"p{a}{names[j]}"]) - sums[i] * sums[j]) / (n * n) / UNIT**2
    return np.array([t / n / UNIT for t in sums]), c


def regularised(cov: np.ndarray, n: int, scale: float) -> np.ndarray:
    return (n * scale * cov + PRIOR_ROWS * np.diag(np.square(PRIOR))) / (n + PRIOR_ROWS) + np.diag(np.square(FLOOR))


def _estimate(r: dict, start: int, m: np.ndarray, cov: np.ndarray, known: bool = True) -> dict:
    return {"lang": r["lang"], "source": r["source"], "start": start, "m": m.tolist(), "w": np.linalg.inv(cov).ravel().tolist(),
            "logdet": float(np.linalg.slogdet(cov)[1]) if known else np.inf}


def _solved(sums: DataFrame, scale: float) -> DataFrame:
    """Centre, inverse regularised covariance and its log determinant, from the sums of a subset."""
    def run(it: Iterator[pd.DataFrame]):
        for pdf in it:
            rows = [(r, *_moments(r, X)) for r in pdf.to_dict("records")]
            yield pd.DataFrame([_estimate(r, r["start"], m, regularised(c, int(r["n"]), scale)) for r, m, c in rows],
                               columns=["lang", "source", "start", "m", "w", "logdet"])
    return sums.mapInPandas(run, ESTIMATE)


def _started(sums: DataFrame) -> DataFrame:
    """The three starts of each group; no determinant is known yet."""
    def run(it: Iterator[pd.DataFrame]):
        for pdf in it:
            out = []
            for r in pdf.to_dict("records"):
                middle, spread = np.asarray(r["middle"]) / UNIT, np.asarray(r["spread"]) / UNIT
                m, c = _moments(r, X)
                z = _moments(r, Z)[1]
                sd = np.sqrt(np.diag(z))
                corr = z / np.maximum(np.outer(sd, sd), 1e-9)
                np.fill_diagonal(corr, 1.0)
                tanh = corr * np.outer(spread, spread)
                out += [_estimate(r, k, mm, cc + np.diag(np.square(FLOOR)), known=False)
                        for k, (mm, cc) in enumerate([(middle, np.diag(spread**2)), (m, c), (middle, tanh)])]
            yield pd.DataFrame(out, columns=["lang", "source", "start", "m", "w", "logdet"])
    return sums.mapInPandas(run, ESTIMATE)


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> tuple[DataFrame, Column]:
    """``right`` with the names marked, and the null-safe condition on them."""
    marked = right.withColumnsRenamed({c: f"r_{c}" for c in names})
    cond = F.lit(True)
    for c in names:
        cond = cond & left[c].eqNullSafe(marked[f"r_{c}"])
    return marked, cond


def _distance(df: DataFrame, est: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance of each row to each of its group's estimates."""
    marked, cond = _same(df, est.select(*GROUP, "start", "m", "w"), GROUP)
    d = [F.col(x) / UNIT - F.col("m")[i] for i, x in enumerate(X)]
    d2 = sum(((1 if i == k else 2) * d[i] * d[k] * F.col("w")[5 * i + k] for i in range(5) for k in range(i, 5)), F.lit(0.0))
    return df.join(marked, cond).withColumn("d2", F.greatest(d2, F.lit(0.0))).drop("r_lang", "r_source", "m", "w")


def _starts(rows: DataFrame) -> DataFrame:
    # the values are whole numbers of few different sizes: exact medians need little memory
    middle = stage(rows.groupBy(*GROUP).agg(F.array(*(F.percentile(x, F.lit(0.5)) for x in X)).alias("middle")), "quality-middle")
    marked, cond = _same(rows, middle, GROUP)
    off = rows.join(marked, cond).drop("r_lang", "r_source")
    mad = [F.percentile(F.abs(F.col(x) - F.col("middle")[i]), F.lit(0.5)) for i, x in enumerate(X)]
    spread = stage(off.groupBy(*GROUP, "middle").agg(F.array(*(
        F.greatest(1.4826 * a, F.lit(UNIT * f)) for a, f in zip(mad, FLOOR, strict=True))).alias("spread")), "quality-spread")
    marked, cond = _same(rows, spread, GROUP)
    z = [F.round(UNIT * F.tanh((F.col(x) - F.col("middle")[i]) / F.col("spread")[i])).cast("long").alias(Z[i])
         for i, x in enumerate(X)]
    each = rows.join(marked, cond).select(*GROUP, "middle", "spread", *X, *z)
    both = each.groupBy(*GROUP, "middle", "spread").agg(*_sums(X), *_sums(Z)[1:])
    return _started(both)


def fit(rows: DataFrame) -> DataFrame:
    """(lang, source, start, m, w, logdet): one estimate a group, from rows of lang, source and x0 to x4
    (long, in 1/1024)."""
    # what has one row a group is written before it is joined: its size is known, so that the documents
    # need no shuffle where it is small
    est = stage(_starts(rows).withColumn("done", F.lit(False)), "quality-start")
    keys = [*GROUP, "start"]
    while not est.filter("not done").isEmpty():
        d = _distance(rows, est.filter("not done")).withColumn("bin", F.floor(BINS * F.log2(1 + 16 * F.col("d2"))))
        cut = stage(d.groupBy(*keys).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY bin)").alias("half")), "quality-cut")
        marked, cond = _same(d, cut, keys)
        near = d.join(marked, cond & (F.col("bin") <= F.col("half"))).select(*keys, *X)
        new = _solved(near.groupBy(*keys).agg(*_sums(X)), HALF_SCALE)
        marked, cond = _same(est, new.withColumnsRenamed({"m": "new_m", "w": "new_w", "logdet": "new_logdet"}), keys)
        better = F.coalesce(F.col("new_logdet") < F.col("logdet") - 1e-6, F.lit(False))
        est = stage(est.join(marked, cond, "left").select(
            *keys, *(F.when(better, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("m", "w", "logdet")),
            (~better).alias("done")), "quality-estimate")
    best = est.groupBy(*GROUP).agg(F.min_by(F.struct("start", "m", "w"), F.struct("logdet", "start")).alias("b")).select(*GROUP, "b.*")
    within = _distance(rows, stage(best, "quality-best")).filter(F.col("d2") <= NEAR)
    return stage(_solved(within.groupBy(*keys).agg(*_sums(X)), NEAR_SCALE), "quality-final")


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source", cutoff: float = CUTOFF, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: the statistics, base_failed, kept and distance2 (null where the base
    rules failed)."""
    base = ((F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    df = stage(_stats(docs, id_col, text_col, lang_col, source_col)
               .select("*", base.alias("base_failed"),
                       *(F.round(UNIT * v).cast("long").alias(x) for x, v in zip(X, _vector(), strict=True))), "quality")
    bulk = df.filter(~F.col("base_failed"))
    d = _distance(bulk.select("doc_id", *X, *GROUP, *STATS_ONLY, "base_failed"), fit(bulk.select(*GROUP, *X)))
    judged = d.select("doc_id", *STATS_ONLY, "base_failed", (F.col("d2") <= cutoff).alias("kept"),
                      F.col("d2").alias("distance2"))
    failed = df.filter("base_failed").select("doc_id", *STATS_ONLY, "base_failed",
                                             F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance2"))
    return judged.unionByName(failed)
