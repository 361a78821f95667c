"""Operator 4, toxicity by weak supervision.

1. Voters. Words and word beginnings that are much likelier in toxic than in clean learning rows
   form the lexicon, one voter each, chosen to explain the toxic rows between them; a few patterns (shouting, exclamation runs, drawn-out letters,
   symbol runs) are voters too. A voter fires or abstains on a text.
2. Label model. A text has a hidden label; a voter fires with one probability on toxic and with
   another on clean texts (its accuracies). The given label is one more voter, which errs: its two
   accuracies are estimated with the others'. EM estimates them and the labels' posteriors. Pairs of
   voters whose residuals, given the posterior, are correlated say partly the same thing: the
   squared correlations of a voter divide its evidence, so ten spellings of one word do not count as
   ten voters.
3. A linear (logistic) classifier on the lexicon's words and beginnings and the patterns is trained
   on the posteriors and scores every whole text.

What is learned: from at most ``MAX_TOXIC`` toxic and ``MAX_CLEAN`` clean labelled rows whose
crc32(doc_id) mod 5 is not 0 (a documented bound; chosen by the hash of the id, the same on every
run). The driver gets the ``CANDIDATES`` best features and, of the learning rows, which of
these they hold. Each row learned from stands for all labelled ones of its class, so the classes'
shares, and with them the scores, do not follow the bound.

Results for odd input: null and empty texts get the score of a text without any feature; without
labelled rows of both kinds every score is 0; several labels of one document count as toxic if any
is; null labels are ignored; repeated rows get equal scores; an empty table gives an empty result.
Columns other than the named ones are not read; labels, lang, source and id are not inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcases.llm.common import stage
from fleetcases.llm.language import held_out

MAX_TOXIC, MAX_CLEAN, CANDIDATES, VOTERS, MIN_TEXTS = 4000, 8000, 2000, 300, 3
BEGINNINGS = (4, 5, 6)
#: accuracy the given labels start from, the rows that this start counts as, and the least it may become
START, BELIEF, LEAST = 0.95, 20.0, 0.6
_WORD = re.compile(r"[^\W\d_]+")
#: name -> pattern; a voter fires where it is found
PATTERNS = {
    "shouting": re.compile(r"\b[^\W\d_a-z]{4,}\s+[^\W\d_a-z]{4,}\b"),
    "exclamations": re.compile(r"!{2,}"),
    "drawn out": re.compile(r"([^\W\d_])\1{3,}"),
    "masked word": re.compile(r"[^\W\d_][*@#$]{2,}[^\W\d_]"),
}


def features(text: str | None) -> set[str]:
    """Words of a text, and beginnings of the longer ones (marked by a final hyphen)."""
    words = set(_WORD.findall(text.lower())) if text else set()
    out = set(words)
    for n in BEGINNINGS:
        out.update([w[:n] + "-" for w in words if len(w) > n])
    return out


def fired(text: str | None) -> list[str]:
    return [n for n, p in PATTERNS.items() if text and p.search(text)]


def scored(text: str | None) -> set[str]:
    return features(text) | set(map(_mark, fired(text)))


class LabelModel:
    """Two-class generative model of voters that fire or abstain, and of given labels that err."""

    def __init__(self, prior: float, steps: int = 50):
        self.prior, self.steps = prior, steps

    def fit(self, votes: np.ndarray, marked: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        """Posterior of toxic per row. ``marked``: the rows' given labels, one more voter, whose two
        accuracies are estimated with the others' from a start of ``START`` (as if ``BELIEF`` rows
        had shown it) and never held below ``LEAST``: below a half the classes would change places,
        and without the labels the hidden classes could become languages. ``weight``: rows each stands for."""
        v = votes.astype(np.float64)
        w = np.ones(len(v)) if weight is None else weight
        post, share = np.where(marked > 0, START, 1 - START), np.ones(v.shape[1])
        for step in range(self.steps):
            w1, w0 = w * post, w * (1 - post)
            self.p1 = (w1 @ v + 0.5) / (w1.sum() + 1)
            self.p0 = (w0 @ v + 0.5) / (w0.sum() + 1)
            self.hit = max(LEAST, (w1 @ marked + START * BELIEF) / (w1.sum() + BELIEF))
            self.miss = min(1 - LEAST, (w0 @ marked + (1 - START) * BELIEF) / (w0.sum() + BELIEF))
            if step in (2, 8):
                share = self._share(v, post, w)
            on = np.log(self.p1 / self.p0) * share
            off = np.log((1 - self.p1) / (1 - self.p0)) * share
            said = np.where(marked > 0, math.log(self.hit / self.miss), math.log((1 - self.hit) / (1 - self.miss)))
            z = math.log(self.prior / (1 - self.prior)) + said + v @ (on - off) + off.sum()
            new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            done = np.abs(new - post).max() < 1e-4
            post = new
            if done and step > 8:
                break
        self.share = share
        return post

    def _share(self, v: np.ndarray, post: np.ndarray, w: np.ndarray) -> np.ndarray:
        """1 / how many voters say the same: the squares of a voter's positive residual correlations,
        each less what chance gives among as many rows (nine times its mean), add up over all voters."""
        res = v - np.outer(post, self.p1) - np.outer(1 - post, self.p0)
        cov = (res * w[:, None]).T @ res / w.sum()
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        square = np.maximum(cov / np.outer(sd, sd), 0) ** 2 - 9 * (w ** 2).sum() / w.sum() ** 2
        np.fill_diagonal(square, 1.0)
        return 1 / np.maximum(square, 0).sum(axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02, steps: int = 30) -> np.ndarray:
    """Weights and bias of a ridge logistic regression on soft labels and weighted rows, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    reg = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + reg * w
        h = (x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(reg)
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-5:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> dict:
    """{feature: weight} and the bias under the key None; empty without labels of both kinds."""
    known = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
             .filter(F.col("y").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
             .filter(~held_out("id")))
    of = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).filter("y in (0, 1)").collect()}
    pick = None
    for y, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        pick = part if pick is None else pick.unionByName(part)
    # at most MAX_TOXIC + MAX_CLEAN ids: a proven bound
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .join(F.broadcast(pick), "id").select("y", "text"))

    def count(it: Iterator[pa.RecordBatch]):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in it:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = features(t)
                seen[int(y > 0)].update(f)
                seen[int(y > 0)][""] += 1
        names = list(seen[0].keys() | seen[1].keys())
        for lo in range(0, len(names), 50_000):
            n = names[lo:lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.string()), pa.array([seen[1][x] for x in n], pa.int64()),
                                              pa.array([seen[0][x] for x in n], pa.int64())], ["f", "n1", "n0"])
    counts = rows.mapInArrow(count, "f string, n1 long, n0 long").groupBy("f").agg(F.sum("n1").alias("n1"),
                                                                                  F.sum("n0").alias("n0"))
    counts = counts.filter((F.col("n1") + F.col("n0") >= MIN_TEXTS))
    counts = stage(counts, "toxicity-counts")
    total = counts.filter("f = ''").first()
    if total is None or not total["n1"] or not total["n0"]:
        return {}
    t1, t0 = total["n1"], total["n0"]
    r1, r0 = (F.col("n1") + 0.5) / (t1 + 1), (F.col("n0") + 0.5) / (t0 + 1)
    # candidates: clearly likelier in toxic rows, by the standard error of the log ratio
    ratio = F.log(r1 / r0)
    sure = ratio / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    names = [r["f"] for r in counts.filter((F.col("f") != "") & (r1 > 5 * r0) & (sure > 3))
             .orderBy(F.desc(sure), F.desc("n1"), "f").limit(CANDIDATES).collect()]
    at = {f: i for i, f in enumerate(names)}
    pats = list(PATTERNS)

    def vote(it: Iterator[pa.RecordBatch]):
        for b in it:
            held, pat = [], []
            for t in b.column(1).to_pylist():
                x = np.zeros(len(names) + 1, bool)
                x[[at[f] for f in features(t) & at.keys()]] = True
                held.append(np.packbits(x).tobytes())
                on = fired(t)
                pat.append(np.packbits(np.array([p in on for p in pats])).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.binary()), pa.array(pat, pa.binary())],
                                             ["y", "x", "p"])
    got = rows.mapInArrow(vote, "y int, x binary, p binary").collect()
    got.sort(key=lambda r: (r["y"], bytes(r["x"]), bytes(r["p"])))       # the order rows arrive in does not matter
    bits = lambda c, n: np.stack([np.unpackbits(np.frombuffer(bytes(r[c]), np.uint8))[:n] for r in got])
    x, p = bits("x", len(names)), bits("p", len(pats))
    y = np.array([r["y"] > 0 for r in got], float)
    chosen = _cover(x, y)
    names, x = [names[i] for i in chosen], x[:, chosen]
    # rows stand for all labelled documents of their class, so the bounds do not shift the classes' shares
    stands = np.where(y > 0, max(1.0, of[1] / MAX_TOXIC), max(1.0, of[0] / MAX_CLEAN))
    prior = (stands @ y) / stands.sum()
    stands *= len(y) / stands.sum()
    votes = np.hstack([x, p])
    w = _logistic(votes, LabelModel(prior).fit(votes, y, stands), stands)
    return {None: float(w[-1])} | {f: float(v) for f, v in zip([*names, *map(_mark, pats)], w[:-1], strict=True)}


def _mark(pattern: str) -> str:
    return f"<{pattern}>"


def _cover(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Lexicon out of the candidates, one at a time: the one that explains most toxic rows not yet
    explained (a row's weight falls with the square of the voters it has) less the clean rows it
    hits. Words that merely share a few copied texts with real ones explain nothing new."""
    tox, clean = x[y > 0].astype(np.float32), x[y == 0].astype(np.float32)
    met, out = np.zeros(len(tox), np.float32), []
    scale = len(tox) / max(1, len(clean))
    cost = 3 * scale * clean.sum(axis=0)
    least = max(1.0, 0.002 * len(tox))
    while len(out) < min(VOTERS, x.shape[1]):
        gain = (1 / (1 + met) ** 2) @ tox - cost
        gain[out] = -1
        best = int(gain.argmax())
        if gain[best] < least:
            break
        out.append(best)
        met += tox[:, best]
    return out


def score_column(docs: DataFrame, model: dict, text_col: str = "text") -> Column:
    """Score (0 to 1) of each text, as a column for ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model = shared.value
        if not model:
            return pd.Series(np.zeros(len(texts)))
        known = model.keys() - {None}
        out = np.array([model[None] + math.fsum(model[f] for f in scored(t) & known) for t in texts], float)
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))
    return score(F.col(text_col))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = fit(docs, labels, id_col, text_col, label_col)
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
                      score_column(docs, model, text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
