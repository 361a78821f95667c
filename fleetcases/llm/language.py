"""Operator 1, language identification by string kernels.

The kernel of two texts is the share of character n-grams (blended, 1 to ``MAX_N`` long, presence
only) they have in common: |A and B| / sqrt(|A| |B|), over hashed n-grams. Landmark texts drawn from the
learning rows give the Nystroem map k(x, landmarks) W^(-1/2); one ridge regression a language (one
against the rest) is fitted on it. Scoring is two matrix products a batch: presence of the batch's
n-grams times presence of the landmarks', then times the folded coefficients.

What is learned: ``PER_LANGUAGE`` different texts of every language (all, if it has fewer) of the rows
whose crc32(doc_id) mod 5 is not 0 (a documented bound; those with the least hashes, the same on every
run, however many copies each has), ``LANDMARKS`` of them as landmarks, or one of each language if there
are more. Hashes of about twice as many texts and the n-gram presence bits of these reach the driver (4 KB
a text, 1.2 MB a language). No language is left out. Every whole text is predicted.

Results for odd input: null texts and texts without a letter are ``und`` with score 0; a language is
never null; ties go to the alphabetically first language; with no learning rows everything is ``und``;
repeated rows get equal answers; an empty table gives an empty result. Columns other than the named
ones are not read, and lang, source and id are not inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcases.llm.common import U

BITS, MAX_N, PER_LANGUAGE, LANDMARKS, RIDGE = 15, 3, 300, 96, 1e-2
DRAWS = 1 << 30
HELD_OUT = 5
UNKNOWN = "und"


def presence(text: str) -> np.ndarray:
    """Numbers of the hashed n-grams that occur in the text."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    found = np.zeros(1 << BITS, bool)
    h = c
    for n in range(1, MAX_N + 1):
        if len(c) < n:
            break
        if n > 1:
            h = h[:-1] * U(0x9E3779B97F4A7C15) + c[n - 1:]
        found[((h + U(n)) * U(0xD6E8FEB86659FD93) >> U(64 - BITS)).astype(np.int64)] = True
    return np.flatnonzero(found).astype(np.uint16)


def dense(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), 1 << BITS), np.float32)
    for i, r in enumerate(rows):
        out[i, r] = 1.0
    return out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray      # presence of the landmarks' n-grams, scaled: (n-grams, landmarks)
    weights: np.ndarray        # (landmarks + 1, languages)

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        p = dense(rows)
        k = p @ self.landmarks
        k /= np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))
        return k @ self.weights[:-1] + self.weights[-1]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def held_out(id_col: str = "doc_id"):
    """Fold of a row: crc32 of the id as text (a null id as the empty text) mod 5 is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % HELD_OUT == 0


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hash", F.xxhash64("text"))


def _draw():
    return F.pmod("hash", F.lit(DRAWS))


def _of_language(value: dict[str, int]):
    """The language's number, -1 for a language without one."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in value.items() for x in kv]), F.col("lang")), F.lit(-1))


def least_hashes(rows: DataFrame, per_language: int) -> dict[str, list[int]]:
    """Hashes of the texts to learn from by language: of its different texts the ``per_language`` with
    the least draw (hash mod 2^30, then the hash), or all if there are fewer. Only hashes are collected,
    of about twice the number: those below a draw that the approximate number of different texts gives.
    A language that has too few of them is drawn again further up, so none ends short."""
    sizes = {r["lang"]: max(1, r["n"]) for r in
             rows.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).collect()}
    upto = {lang: min(DRAWS, 2 * per_language * DRAWS // n) for lang, n in sizes.items()}
    least: dict[str, list[int]] = {}
    while upto:
        got: dict[str, list[int]] = {}
        for r in _hashed(rows).filter(_draw() <= _of_language(upto)).select("lang", "hash").distinct().collect():
            got.setdefault(r["lang"], []).append(r["hash"])
        least |= {lang: sorted(got.get(lang, ()), key=lambda h: (h % DRAWS, h))[:per_language] for lang in upto}
        upto = {lang: min(DRAWS, 4 * n + 1) for lang, n in upto.items() if n < DRAWS and len(least[lang]) < per_language}
    return least


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model | None:
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(id_col))
    wanted = least_hashes(rows, per_language)
    if not wanted:
        return None
    last = {lang: hashes[-1] % DRAWS for lang, hashes in wanted.items()}
    picked = _hashed(rows).filter(_draw() <= _of_language(last))

    def grams(it: Iterator[pa.RecordBatch]):
        left = {(lang, h) for lang, hashes in wanted.items() for h in hashes}
        for b in it:
            rows = []
            for lang, text, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (lang, h) in left:            # the first copy of a text in this task
                    left.remove((lang, h))
                    rows.append((lang, h, np.packbits(_mask(presence(text))).tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.binary()), strict=True)],
                                             ["lang", "hash", "grams"])
    sample = picked.select("lang", "text", "hash").mapInArrow(grams, "lang string, hash long, grams binary")
    # copies of a text that lie in several tasks: however many there are, one is learned from
    bits = {(r["lang"], r["hash"]): bytes(r["grams"]) for r in sample.distinct().collect()}
    languages = sorted(wanted)
    chosen = [(lang, bits[lang, h]) for lang in languages for h in wanted[lang]]
    y = np.array([languages.index(lang) for lang, _ in chosen])

    def unpacked(which) -> np.ndarray:
        x = np.stack([np.unpackbits(np.frombuffer(chosen[i][1], np.uint8)) for i in which]).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    # landmarks in turn from each language, so that a large one does not take them all
    turn = np.argsort(np.concatenate([np.arange((y == k).sum()) for k in range(len(languages))]), kind="stable")
    z = unpacked(turn[:max(landmarks, len(languages))])
    # a slice of rows at a time: a row takes 128 KB unpacked
    k = np.concatenate([unpacked(range(i, min(i + 512, len(chosen)))) @ z.T for i in range(0, len(chosen), 512)])
    value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])              # W^(-1/2) on the space it has
    phi = np.hstack([k @ root, np.ones((len(k), 1))])
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = (1.0 / np.bincount(y, minlength=len(languages)))[y] * len(y) / len(languages)
    a = (phi * weight[:, None]).T @ phi + RIDGE * len(k) * np.diag(np.append(np.ones(phi.shape[1] - 1), 0))
    beta = np.linalg.solve(a, (phi * weight[:, None]).T @ target)
    return Model(languages, np.ascontiguousarray(z.T), np.vstack([root @ beta[:-1], beta[-1:]]).astype(np.float32))


def _mask(idx: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << BITS, bool)
    out[idx] = True
    return out


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
                      F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]):
        model = shared.value
        for b in it:
            texts = b.column(2).to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            for lo in range(0, len(known), 128):
                part = known[lo:lo + 128]
                f = model.score([presence(texts[i]) for i in part])
                best = f.argmax(axis=1)
                score[part] = np.clip((f[np.arange(len(part)), best] + 1) / 2, 0, 1)
                for i, k in zip(part, best.tolist(), strict=True):
                    lang[i] = model.languages[k]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()),
                                              pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
    return src.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify_language(docs: DataFrame, **names) -> DataFrame:
    """Fit on the learning fold of ``docs`` and predict every row."""
    cols = {k: v for k, v in names.items() if k in ("id_col", "text_col")}
    return predict(docs, fit(docs, **names), **cols)
