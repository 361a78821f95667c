"""Operator 12, periodic runs by seed-and-extend on diagonals.

Words are separated by ASCII white space. A run is a stretch of words of one document with smallest
period q (words q apart are equal), at least ``least`` words and ``times`` periods long, that cannot be
extended on either side. A word is dropped if a run contains it after that run's first q words.

1. Words q apart are equal along ``length - q`` places of the diagonal with lag q. The least such stretch
   that any run guarantees, max(least - q, (times - 1) q) over all q, gives the length k of the first
   grams (16 for 24 words and 3 periods). Longer lags guarantee more: lags above k/2 of a power of two k
   have stretches of k places.
2. Grams of k = 16, 32, ... words are indexed by doubling: the rank of a gram is that of the pair of its
   halves, exact; places whose gram occurs once in their document are left out, so what remains in
   ordinary text is next to nothing after the first steps.
3. The occurrences of a gram in a document are paired, each with the next one. A run whose period is at
   most k repeats its grams first at its smallest period, so the pairs of any two others lead to no other
   run; lags over k wait for longer grams. A pair is a seed on the diagonal of its lag.
4. Seeds are taken by lag and place. A table holds, for every lag, how far its diagonal is covered; a
   seed before that place is passed over, any other is extended both ways until words differ.

A document is one row and is worked on whole, in slices of about a MB of text, so the memory of a task
follows its longest document; no rows are shuffled.

Results for odd input: null text and text without words have no words and no runs, and an empty collapsed
text; repeated rows are each judged on their own; a null id stays null; ties of equal exponent are told in
the query (least start, then period); an empty table gives an empty result. Columns other than the two
named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcases.llm.common import slices_of, split_words

LEAST, TIMES = 24, 3
SCHEMA = ("doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, "
          "collapsed string")


def guaranteed(least: int, times: int) -> int:
    """Places of its diagonal on which every run has equal words, at least."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of every key, and whether it occurs more than once."""
    _, rank, times = np.unique(keys, return_inverse=True, return_counts=True)
    return rank, times[rank] > 1


def _seeds(words: np.ndarray, bounds: np.ndarray, first: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For gram lengths k from ``first`` on: k, places and lags of occurrence pairs, by lag and place."""
    n = len(words)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][doc]
    rank, again = _ranks(doc * (int(words.max()) + 1) + words)
    at, k = np.flatnonzero(again), 1
    rank = rank[at]
    while len(at):
        if k >= first:
            order = np.argsort(rank, kind="stable")
            i, r = at[order], rank[order]
            lag = np.diff(i)
            use = (np.diff(r) == 0) & (lag <= k) & (lag > (0 if k == first else k // 2))
            i, lag = i[:-1][use], lag[use]
            order = np.lexsort((i, lag))
            yield k, i[order], lag[order]
        grams = np.full(n, -1, np.int64)
        grams[at] = rank
        at, rank = at[at + 2 * k <= end[at]], rank[at + 2 * k <= end[at]]
        half = grams[at + k]
        at, rank, half = at[half >= 0], rank[half >= 0], half[half >= 0]
        rank, again = _ranks(rank * n + half)
        at, rank, k = at[again], rank[again], 2 * k


def _equal_until(words: np.ndarray, at: int, lag: int, end: int) -> int:
    """First place from ``at`` on whose word differs from that ``lag`` further (or has none before end)."""
    step = 64
    while at + lag < end:
        m = min(step, end - lag - at)
        differ = words[at:at + m] != words[at + lag:at + lag + m]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + m, step * 4
    return at


def _equal_since(words: np.ndarray, at: int, lag: int, begin: int) -> int:
    """First place of the stretch before ``at`` whose words equal those ``lag`` further."""
    step = 64
    while at > begin:
        m = min(step, at - begin)
        differ = words[at - m:at] != words[at - m + lag:at + lag]
        if differ.any():
            return at - int(differ[::-1].argmax())
        at, step = at - m, step * 4
    return at


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Runs of documents that follow one another (word numbers, and where documents begin and end):
    rows of document, start (in the document), length, period, by document, start and period."""
    if times < 3:
        raise ValueError("runs of fewer than three periods are not guaranteed a seed")
    found = []
    if len(words):
        covered: dict[int, int] = {}
        first = 1 << (guaranteed(least, times).bit_length() - 1)
        for k, places, lags in _seeds(words, bounds, first):
            # neighbours on a diagonal are one seed
            head = np.append(True, (np.diff(lags) != 0) | (np.diff(places) != 1)) if len(places) else []
            for i, lag in zip(places[head].tolist(), lags[head].tolist(), strict=True):
                if i < covered.get(lag, 0):
                    continue
                d = int(np.searchsorted(bounds, i, "right")) - 1
                begin, end = int(bounds[d]), int(bounds[d + 1])
                right = _equal_until(words, i + k, lag, end)
                left = _equal_since(words, i, lag, begin)
                covered[lag] = right
                if right - left + lag >= max(least, times * lag):
                    found.append((d, left - begin, right - left + lag, lag))
    return np.array(sorted(set(found)), np.int64).reshape(-1, 4)


def _collapse(words: pa.Array, bounds: np.ndarray, runs: np.ndarray) -> pa.Array:
    """Texts of the words that no run drops, joined by one space."""
    n = len(words)
    step = np.zeros(n + 1, np.int64)
    begin = bounds[runs[:, 0]] + runs[:, 1]
    np.add.at(step, begin + runs[:, 3], 1)
    np.add.at(step, begin + runs[:, 2], -1)
    kept = np.cumsum(step)[:n] == 0
    offsets = np.append(0, np.cumsum(kept))[bounds]
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.filter(pa.array(kept)))
    return pc.binary_join(lists, " ")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                  times: int = TIMES) -> DataFrame:
    """One row per document: doc_id, n_words, runs (by start, then period) and the collapsed text."""
    struct = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(struct)), ("collapsed", pa.string())])

    def task(it: Iterator[pa.RecordBatch]):
        for batch in it:
            ids, texts = batch.column(0), batch.column(1).cast(pa.string())
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for lo, hi in slices_of(lengths):
                words, bounds = split_words(texts.slice(lo, hi - lo))
                numbers = words.dictionary_encode().indices.to_numpy().astype(np.int64)
                runs = find_runs(numbers, bounds, least, times)
                offsets = np.searchsorted(runs[:, 0], np.arange(hi - lo + 1))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(runs[:, c]) for c in (1, 2, 3)], fields=list(struct)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(np.diff(bounds)), lists,
                                                  _collapse(words, bounds, runs)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, SCHEMA)
