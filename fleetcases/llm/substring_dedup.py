"""Operator 8, substring dedup by a count-min prefilter.

Text is a sequence of words (separated by ASCII white space); a window is ``width`` consecutive
words of one document. Every word covered by a window that also starts earlier (smaller doc_id,
or the same document and an earlier start) is removed.

1. Every partition counts, in a sketch, the key of each of its windows: the least hash of the
   window's ``gram``-word pieces. Neighbouring windows mostly share the piece and it is counted
   once, so there are far fewer keys than windows; equal windows have equal keys. The partition sketches are summed; an estimate is never below the truth.
2. A second pass sends on only windows whose key is estimated repeated, as blocks of 96-bit
   window hashes dealt by that hash (no word, line or passage gathers in one block: a window that
   is frequent is reduced to its first occurrence in every batch). A block groups them exactly and
   keeps every occurrence but the first.
3. The removed windows go back to their documents by blocks of document ids.

Results for odd input: null text has no words (n_words 0, n_removed 0, kept_text
empty); a text with fewer than ``width`` words loses nothing; a null doc_id counts as smaller than
all others; rows sharing a doc_id are judged each on its own text but none of them is earlier than
another at the same start, so an exact repeat of a row changes nothing; an empty table gives an
empty result. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcases.llm import sketch
from fleetcases.llm.common import (NULL_ID, U, arrow_batches, binary_list, block_of, doc_key, least_pieces, longs,
                                   n_blocks, pack, runs, slices, text_bytes, unpack, windows_hash, word_hashes)

WIDTH, GRAM = 20, 8
_HITS = "block long, a binary, b binary, did binary, tag binary, pos binary"


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*doc_key(id_col, text_col), F.col(text_col).alias("text"))


def _windows(hashes: np.ndarray, counts: np.ndarray, width: int, gram: int):
    """Windows of a slice: their positions in it, document numbers, starts and keys; and the keys
    to count, once for every piece that serves as one."""
    n = np.maximum(counts - width + 1, 0)
    doc = np.repeat(np.arange(len(counts)), n)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(counts) - counts)[doc] + start
    if not len(at):
        return at, doc, start, hashes[:0], hashes[:0]
    pieces = windows_hash(hashes, gram, 11)
    valid = np.zeros(len(hashes) - width + 1, bool)
    valid[at] = True
    keys, used = least_pieces(pieces, len(valid), valid)
    return at, doc, start, keys[at], pieces[used]


def _sketch_rows(docs: DataFrame, cells: int, width: int, gram: int) -> DataFrame:
    def rows(it: Iterator[pa.RecordBatch]):
        part, seen = TaskContext.get().partitionId(), sketch.PartitionSketch(cells)
        for batch in it:
            texts = binary_list(batch, "text")
            for lo, hi in slices(texts):
                seen.add(_windows(*word_hashes(texts[lo:hi]), width, gram)[-1])
        out = list(seen.rows(part))
        if out:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out), preserve_index=False)
    return docs.select("text").mapInArrow(rows, sketch.ROWS_SCHEMA)


def _hits(docs: DataFrame, bits, cells: int, blocks: int, width: int, gram: int) -> DataFrame:
    """Windows estimated repeated, by block; a window met again in the same batch comes as a
    removed one (block -1) and not as a candidate."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    schema = pa.schema([("block", pa.int64())] + [(c, pa.binary()) for c in ("a", "b", "did", "tag", "pos")])

    def hits(it: Iterator[pa.RecordBatch]):
        table = shared.value

        def one(batch):
            texts, did = binary_list(batch, "text"), longs(batch, "did")
            tag = longs(batch, "th")
            got = []
            for lo, hi in slices(texts):
                hashes, counts = word_hashes(texts[lo:hi])
                at, doc, start, keys, _ = _windows(hashes, counts, width, gram)
                keep = sketch.reaches(table, keys, cells)
                if not keep.any():
                    continue
                at, doc, start = at[keep], doc[keep] + lo, start[keep]
                a = windows_hash(hashes, width, 23)[at]
                b = (windows_hash(hashes, width, 57)[at] >> U(32)).astype(np.uint32)
                got.append((a, b, did[doc], tag[doc], start.astype(np.uint32)))
            if not got:
                return None
            a, b, d, t, p = map(np.concatenate, zip(*got, strict=True))
            order = np.lexsort((p, d, b, a))
            a, b, d, t, p = a[order], b[order], d[order], t[order], p[order]
            later = np.append(False, (a[1:] == a[:-1]) & (b[1:] == b[:-1])) & _after(a, b, d, p)
            block = np.where(later, -1, (a % U(blocks)).astype(np.int64))
            order = np.lexsort((p, t, d, block))
            a, b, d, t, p, block = a[order], b[order], d[order], t[order], p[order], block[order]
            out = {c: [] for c in schema.names}
            for lo, hi in runs(block):
                out["block"].append(int(block[lo]))
                for c, x in (("a", a), ("b", b), ("did", d), ("tag", t), ("pos", p)):
                    out[c].append(pack(x[lo:hi]))
            return out
        yield from arrow_batches(one, it, schema)
    return docs.mapInArrow(hits, _HITS)


def _after(a, b, d, p) -> np.ndarray:
    """For rows sorted by (a, b, d, p): whether (d, p) is after that of the first row with its
    (a, b). Rows that share id and start with the first are no later than it."""
    if not len(a):
        return np.zeros(0, bool)
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    return (d != d[first]) | (p != p[first])


def _columns(pdf: pd.DataFrame, kinds: dict) -> list[np.ndarray]:
    return [np.concatenate([unpack(x, k) for x in pdf[c]]) if len(pdf) else np.zeros(0, k)
            for c, k in kinds.items()]


_KEYED = {"did": np.int64, "tag": np.int64, "pos": np.uint32}
_LOST = "block long, did binary, tag binary, pos binary"


def _dealt(did, tag, pos, blocks: int) -> pd.DataFrame:
    """Removed windows packed by the block of their document."""
    block = block_of(did, tag, blocks)
    order = np.lexsort((pos, tag, did, block))
    did, tag, pos, block = did[order], tag[order], pos[order], block[order]
    cut = runs(block)
    return pd.DataFrame({"block": np.array([block[lo] for lo, _ in cut], np.int64),
                         **{c: [pack(x[lo:hi]) for lo, hi in cut]
                            for c, x in (("did", did), ("tag", tag), ("pos", pos))}})


def _later(hits: DataFrame, blocks: int) -> DataFrame:
    """Exact grouping: every occurrence of a window but the first, by the document's block."""
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, d, t, p = _columns(pdf, {"a": np.uint64, "b": np.uint32, **_KEYED})
        if pdf["block"].iloc[0] >= 0:
            order = np.lexsort((p, d, b, a))
            a, b, d, t, p = a[order], b[order], d[order], t[order], p[order]
            keep = _after(a, b, d, p)
            d, t, p = d[keep], t[keep], p[keep]
        return _dealt(d, t, p, blocks)
    # removed ones found in the batches (block -1) have nothing to group: any few of them go together
    return (hits.withColumn("lot", F.when(F.col("block") < 0, F.xxhash64("did", "pos")).otherwise(F.lit(0)))
            .groupBy("block", "lot").applyInPandas(group, _LOST))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the n positions that a window of ``width`` at one of ``starts`` covers."""
    step = np.bincount(starts, minlength=n + 1)[:n + 1] - np.bincount(
        np.minimum(starts + width, n), minlength=n + 1)[:n + 1]
    return np.cumsum(step)[:n] > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed and kept_text (kept words joined by one
    space)."""
    spark = docs.sparkSession
    size = text_bytes(docs, text_col)
    blocks = n_blocks(spark, size)
    src = _documents(docs, id_col, text_col)
    cells = sketch.cells_for(size // 40)
    (bits,) = sketch.merge(_sketch_rows(src, cells, width, gram), cells, (2,))
    lost = _later(_hits(src, bits, cells, blocks, width, gram), blocks)

    def cut(docs_pdf: pd.DataFrame, lost_pdf: pd.DataFrame) -> pd.DataFrame:
        did, tag, pos = _columns(lost_pdf, _KEYED)
        order = np.lexsort((pos, tag, did))
        did, tag, pos = did[order], tag[order], pos[order].astype(np.int64)
        out = []
        for d, th, text in zip(docs_pdf["did"], docs_pdf["th"], docs_pdf["text"], strict=True):
            words = text.encode().split() if text else []
            lo, hi = np.searchsorted(did, [d, d], "left")[0], np.searchsorted(did, d, "right")
            here = pos[lo:hi][tag[lo:hi] == th]
            if len(here):
                kept = ~covered(here, width, len(words))
                left = [w for w, k in zip(words, kept, strict=True) if k]
            else:
                left = words
            out.append((None if d == NULL_ID else d, len(words), len(words) - len(left),
                        b" ".join(left).decode()))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_text"]
                            ).astype({"doc_id": "Int64"})

    return (src.withColumn("block", block_of(F.col("did"), F.col("th"), blocks)).groupBy("block")
            .cogroup(lost.groupBy("block"))
            .applyInPandas(cut, "doc_id long, n_words long, n_removed long, kept_text string"))
