"""Operator 2, exact removal of repeated byte strings by bucket-pointer refinement.

Texts are UTF-8 bytes. Every byte covered by a string of ``width`` bytes that also starts anywhere
else (another document or the same one) is removed, all occurrences alike.

1. Anchors. Every window of ``width`` bytes selects the least of the hashes of its ``GRAM``-byte
   strings; equal windows select the same one. The selected grams (about one in 85 positions) are
   counted in a fixed-size sketch of initial bucket sizes; buckets of one are final and leave.
2. A stretch of windows with one selected gram in a bucket of two or more is sent on as the bytes
   they span, dealt by the gram, copies within a batch once.
3. In a block the suffixes of all different stretches are refined together: buckets by their first
   8 bytes, then by the bucket of the suffix 8 bytes on, then 16, 32 and 64 on, each time
   with the buckets just made, until the buckets stand for the first ``width`` bytes. Suffixes alone
   in their bucket leave. What shares a bucket in the end is a repeated string.
4. Windows whose gram is in very many stretches (``HOT``) select once more, the least among the grams
   that are not: the pair names their bucket. A passage that very many texts share then is one stretch,
   sent once by each batch, and what stands around it parts at once.
5. Found intervals go back to their documents by blocks of document ids and text hashes.

Results for odd input: null text counts as empty (n_bytes 0, nothing removed, no spans); texts
shorter than ``width`` bytes lose nothing; a null doc_id is a document like any other and comes back
null; an exact repeat of a row is another document, so both lose what they share; rows sharing a
doc_id keep apart by their text; an empty table gives an empty result. Columns other than the two
named are not read.
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
from fleetcases.llm.common import (NULL_ID, U, arrow_batches, binary_list, block_of, doc_key, least_pieces,
                                   longs, mix, n_blocks, pack, pair_hash, runs, slices, sliding_min, text_bytes, unpack)

WIDTH, GRAM = 200, 32
#: stretches from which on a gram names a bucket only together with a second one
HOT = 4096
_SENT = "block long, body binary, lens binary, which binary, did binary, tag binary, pos binary"
_FOUND = "block long, did binary, tag binary, lo binary, hi binary"


def words_at(x: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position, as one number (big end first: number order is byte order)."""
    w = x.astype(np.uint64)
    for k in (1, 2, 4):
        w = (w[:-k] << U(8 * k)) | w[k:]
    return w


def _grams(x: np.ndarray) -> np.ndarray:
    """Hash of every ``GRAM`` bytes: their four words, weighted and mixed. Strings of equal hash are told
    apart by their bytes in the end, so a collision costs time alone."""
    if len(x) < GRAM:
        return np.zeros(0, np.uint64)
    w = words_at(x)
    n = len(x) - GRAM + 1
    h = w[:n] * U(0x9E3779B97F4A7C15)
    for at, factor in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        h += w[at:at + n] * U(factor)
    return mix(h)


def _selected(x: np.ndarray, counts: np.ndarray, width: int):
    """Key of each window of the slice, which windows lie in one text, the grams to count, and all grams."""
    n = len(x) - width + 1
    if n <= 0 or not (counts >= width).any():
        return None
    valid = np.zeros(n + width, np.int8)
    first = np.cumsum(counts) - counts
    ok = counts >= width
    valid[first[ok]] += 1
    valid[(first + counts - width + 1)[ok]] -= 1
    valid = np.cumsum(valid[:n]).astype(bool)
    grams = _grams(x)
    keys, used = least_pieces(grams, n, valid)
    return keys, valid, grams[used], grams


def _second(keys: np.ndarray, valid: np.ndarray, grams: np.ndarray, hot, cells: int) -> np.ndarray:
    """Keys in which windows with a hot gram are named by it and the least gram that is not hot."""
    busy = np.zeros(len(keys), bool)
    at = np.flatnonzero(valid)
    head = np.append(True, keys[at[1:]] != keys[at[:-1]])
    run = np.cumsum(head) - 1
    busy[at] = sketch.reaches(hot, keys[at[head]], cells)[run]
    if not busy.any():
        return keys
    span = len(grams) - len(keys) + 1
    step = np.zeros(len(grams) + 1, np.int64)
    np.add.at(step, np.flatnonzero(busy), 1)
    np.add.at(step, np.flatnonzero(busy) + span, -1)
    near = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    rest = np.full(len(grams), ~U(0))
    cold = near[~sketch.reaches(hot, grams[near], cells)]
    rest[cold] = grams[cold]
    return np.where(busy, pair_hash(keys, sliding_min(rest, span), 41), keys)


def _slice(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    return (np.frombuffer(b"".join(t or b"" for t in texts), np.uint8),
            np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts)))


def _sketch_rows(docs: DataFrame, cells: int, width: int) -> DataFrame:
    def rows(it: Iterator[pa.RecordBatch]):
        part, seen = TaskContext.get().partitionId(), sketch.PartitionSketch(cells)
        for batch in it:
            texts = binary_list(batch, "text")
            for lo, hi in slices(texts):
                if got := _selected(*_slice(texts[lo:hi]), width):
                    seen.add(got[2])
        out = list(seen.rows(part))
        if out:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out), preserve_index=False)
    return docs.select("text").mapInArrow(rows, sketch.ROWS_SCHEMA)


def _sent(docs: DataFrame, bits, hot, cells: int, blocks: int, width: int) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((bits, hot))
    names = ["body", "lens", "which", "did", "tag", "pos"]
    schema = pa.schema([("block", pa.int64())] + [(c, pa.binary()) for c in names])
    most = width - GRAM + 1

    def send(it: Iterator[pa.RecordBatch]):
        bits, hot = shared.value

        def one(batch):
            texts, did, tag = binary_list(batch, "text"), longs(batch, "did"), longs(batch, "th")
            number: dict[bytes, int] = {}           # a stretch met in this batch -> its number
            whole: list[bytes] = []
            blocks_of, which, docs_of, starts = [], [], [], []
            for lo, hi in slices(texts):
                x, counts = _slice(texts[lo:hi])
                if not (got := _selected(x, counts, width)):
                    continue
                keys, valid, _, grams = got
                first = np.cumsum(counts) - counts
                at = np.flatnonzero(valid)
                at = at[_repeated(keys, at, bits, cells)]
                if not len(at):
                    continue
                keep = np.zeros(len(keys), bool)
                keep[at] = True
                keys = _second(keys, keep, grams, hot, cells)
                doc = np.searchsorted(first + counts, at, "right")
                new = np.append(True, (keys[at[1:]] != keys[at[:-1]]) | (doc[1:] != doc[:-1]) | (np.diff(at) != 1))
                begin = np.flatnonzero(new)
                size = np.diff(np.append(begin, len(at)))
                begin, doc = at[begin], doc[begin]
                parts = -(-size // most)             # periodic text: pieces of at most ``most`` windows
                step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                left = np.repeat(size, parts) - step * most
                begin, doc = np.repeat(begin, parts) + step * most, np.repeat(doc, parts)
                size = np.minimum(left, most)
                raw = x.tobytes()
                pieces = [raw[b:e] for b, e in zip(begin.tolist(), (begin + size + width - 1).tolist(), strict=True)]
                known = len(whole)
                which.append(np.fromiter((number.setdefault(p, len(number)) for p in pieces), np.int64, len(pieces)))
                fresh = np.flatnonzero(which[-1] >= known)
                fresh = fresh[np.unique(which[-1][fresh], return_index=True)[1]]
                whole += [pieces[i] for i in fresh.tolist()]
                blocks_of.append((keys[begin[fresh]] % U(blocks)).astype(np.int64))
                docs_of.append(lo + doc)
                starts.append(begin - first[doc])
            if not whole:
                return None
            block, which = np.concatenate(blocks_of), np.concatenate(which)
            doc, start = np.concatenate(docs_of), np.concatenate(starts).astype(np.uint32)
            by, order = np.argsort(block, kind="stable"), np.argsort(block[which], kind="stable")
            ends = np.searchsorted(block[which][order], block[by], "right")
            out, at = {c: [] for c in schema.names}, 0
            local = np.empty(len(whole), np.uint32)
            for lo, hi in runs(block[by]):
                own, mine = by[lo:hi], order[at:ends[lo]]
                at = ends[lo]
                local[own] = np.arange(len(own))
                out["block"].append(int(block[own[0]]))
                for c, v in zip(names, (np.frombuffer(b"".join(whole[i] for i in own), np.uint8),
                                        np.array([len(whole[i]) for i in own], np.uint32), local[which[mine]],
                                        did[doc[mine]], tag[doc[mine]], start[mine]), strict=True):
                    out[c].append(pack(v))
            return out
        yield from arrow_batches(one, it, schema)
    return docs.mapInArrow(send, _SENT)


def _repeated(keys: np.ndarray, at: np.ndarray, bits, cells: int) -> np.ndarray:
    """Which of the windows ``at`` have a gram estimated in two stretches or more (asked once a run)."""
    head = np.append(True, keys[at[1:]] != keys[at[:-1]])
    return sketch.reaches(bits, keys[at[head]], cells)[np.cumsum(head) - 1]


def refine(x: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Positions of ``x`` at which a string of ``width`` bytes starts that also starts elsewhere.

    ``ends[i]``: where the stretch of position i ends; strings do not cross it. Bucket pointers: a
    suffix's bucket is a number, equal for suffixes whose first ``depth`` bytes are equal. A step
    sorts the suffixes still sharing a bucket by (own bucket, bucket of the suffix ``step`` bytes on)
    and renumbers; the next step uses the new numbers.
    """
    n = len(x)
    live = np.flatnonzero(np.arange(n) + width <= ends)
    if not len(live):
        return live
    pointer = np.full(n + 1, -1, np.int64)
    at = np.flatnonzero(np.arange(n) + 8 <= ends)
    _, pointer[at] = np.unique(words_at(x)[at], return_inverse=True)
    depth = 8
    alone = np.zeros(n + 1, bool)
    sizes = np.bincount(pointer[at])
    alone[at] = sizes[pointer[at]] == 1
    top = len(sizes)
    while depth < width:
        step = min(depth, width - depth)
        at = at[~alone[at] & (at + depth + step <= ends[at])]
        if not len(at):
            return at
        _, back, sizes = np.unique(pointer[at] * np.int64(8 * n) + pointer[at + step],
                                   return_inverse=True, return_counts=True)
        # numbers above every one in use: suffixes that left keep theirs, and stay distinct
        pointer[at] = back + top
        top += len(sizes)
        alone[at] = sizes[back] == 1
        depth += step
    return at[~alone[at]]


def _search(pdf: pd.DataFrame, blocks: int, width: int) -> pd.DataFrame:
    cat = lambda c, k: np.concatenate([unpack(v, k) for v in pdf[c]])
    did, tag, pos = cat("did", np.int64), cat("tag", np.int64), cat("pos", np.uint32).astype(np.int64)
    d, t, lo, hi = _stretches(pdf, did, tag, pos, width)
    block = block_of(d, t, blocks)
    order = np.lexsort((lo, t, d, block))
    d, t, lo, hi, block = d[order], t[order], lo[order], hi[order], block[order]
    cut = runs(block)
    return pd.DataFrame({"block": np.array([block[a] for a, _ in cut], np.int64),
                         **{c: [pack(v[a:b]) for a, b in cut]
                            for c, v in (("did", d), ("tag", t), ("lo", lo), ("hi", hi))}})


def _stretches(pdf: pd.DataFrame, did, tag, pos, width: int):
    """Found intervals of the stretches of one block."""
    number: dict[bytes, int] = {}
    which = []
    for body, lens, idx in zip(pdf["body"], pdf["lens"], pdf["which"], strict=True):
        raw, cuts = unpack(body, np.uint8).tobytes(), np.append(0, np.cumsum(unpack(lens, np.uint32), dtype=np.int64)).tolist()
        pieces = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        own = np.fromiter((number.setdefault(p, len(number)) for p in pieces), np.int64, len(pieces))
        which.append(own[unpack(idx, np.uint32)])
    whole = list(number)
    which = np.concatenate(which)
    times = np.bincount(which, minlength=len(whole))
    size = np.fromiter(map(len, whole), np.int64, len(whole))
    first = np.cumsum(size) - size
    x = np.frombuffer(b"".join(whole), np.uint8)
    ends = np.repeat(first + size, size)
    repeated = np.zeros(len(x), bool)
    repeated[refine(x, ends, width)] = True
    # a stretch that occurs twice or more is repeated as a whole
    n_starts = size - width + 1
    full = np.zeros(len(x) + 1, np.int64)
    many = times > 1
    np.add.at(full, first[many], 1)
    np.add.at(full, (first + n_starts)[many], -1)
    repeated |= np.cumsum(full[:-1]) > 0
    # runs of repeated starts within each stretch, then the same for each of its occurrences
    at = np.flatnonzero(repeated)
    if not len(at):
        return did[:0], tag[:0], pos[:0], pos[:0]
    of = np.searchsorted(first, at, "right") - 1
    new = np.append(True, (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1]))
    b = np.flatnonzero(new)
    e = np.append(b[1:], len(at)) - 1
    of, lo, hi = of[b], at[b] - first[of[b]], at[e] - first[of[b]] + width
    count = np.bincount(of, minlength=len(whole))
    base = np.cumsum(count) - count
    n = count[which]
    pick = np.repeat(base[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(did, n), np.repeat(tag, n), np.repeat(pos, n) + lo[pick], np.repeat(pos, n) + hi[pick]


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, spans (removed byte ranges, end
    exclusive, maximal, in order) and kept (the remaining bytes)."""
    spark = docs.sparkSession
    total = text_bytes(docs, text_col)
    blocks = n_blocks(spark, total)
    src = docs.select(*doc_key(id_col, text_col), F.col(text_col).alias("text"))
    cells = sketch.cells_for(total // 85)
    bits, hot = sketch.merge(_sketch_rows(src, cells, width), cells, (2, HOT))
    found = (_sent(src, bits, hot, cells, blocks, width).groupBy("block")
             .applyInPandas(lambda pdf: _search(pdf, blocks, width), _FOUND))

    def cut(docs_pdf: pd.DataFrame, found_pdf: pd.DataFrame) -> pd.DataFrame:
        cat = lambda c, k: (np.concatenate([unpack(v, k) for v in found_pdf[c]])
                            if len(found_pdf) else np.zeros(0, k))
        did, tag, lo, hi = cat("did", np.int64), cat("tag", np.int64), cat("lo", np.int64), cat("hi", np.int64)
        order = np.lexsort((lo, tag, did))
        did, tag, lo, hi = did[order], tag[order], lo[order], hi[order]
        out = []
        for d, th, text in zip(docs_pdf["did"], docs_pdf["th"], docs_pdf["text"], strict=True):
            raw = text.encode() if text else b""
            a, b = np.searchsorted(did, d, "left"), np.searchsorted(did, d, "right")
            own = tag[a:b] == th
            s, e = lo[a:b][own], np.maximum.accumulate(hi[a:b][own]) if own.any() else hi[:0]
            spans, kept, at = [], [], 0
            if len(s):
                first = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
                spans = list(zip(s[first].tolist(), e[np.append(first[1:], len(s)) - 1].tolist(), strict=True))
            for x, y in spans:
                kept.append(raw[at:x])
                at = y
            kept.append(raw[at:])
            out.append((None if d == NULL_ID else d, len(raw), sum(y - x for x, y in spans),
                        [{"start": x, "end": y} for x, y in spans], b"".join(kept)))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "spans", "kept"]).astype({"doc_id": "Int64"})

    return (src.withColumn("block", block_of(F.col("did"), F.col("th"), blocks)).groupBy("block")
            .cogroup(found.groupBy("block"))
            .applyInPandas(cut, "doc_id long, n_bytes long, n_removed long, "
                                "spans array<struct<start:long,end:long>>, kept binary"))
