"""Operator 3, near duplicates by BagMinHash.

A document is the multiset of its ``SHINGLE``-word shingles; similarity is the weighted Jaccard of two
multisets (sum of the smaller counts over sum of the larger). Documents of similarity ``SIMILAR`` or
more are linked; a class is a connected component of the links.

1. Signature. An element of weight w is a Poisson process over time and weight, dealt at random to the
   registers; a point counts if its height lies below w. Heights are organised in doubling strips
   (0-1, 1-2, 2-4, ...), each with a process of its own seeded by the element, so a larger weight
   keeps the points of a smaller one and most points never are generated: times are generated only up to
   where all registers of the document are filled. A register keeps its earliest point; two documents
   agree in a register with probability equal to their weighted Jaccard.
2. Equal multisets are one node. Bands of ``ROWS`` registers put nodes in buckets; a pair of 0.8
   shares one of the ``BANDS`` buckets with probability 1 - 3e-6.
3. Links. Every member of a bucket is compared with the bucket's first and central node (the one whose
   buckets are the fullest), and the links' components are computed. Buckets whose members then still are in different components are
   searched in blocks of ``BLOCK`` members for other pairs across components, whatever their size; such pairs are
   verified within the block, and only the links that join components leave it. Candidates whose
   signatures agree too little for 0.8 (``LEAST_AGREE``, more than six standard errors below) are passed
   over; all others are verified on the multisets.
4. Components: minimum labels along links with pointer jumping, on written tables.

Results for odd input: texts without words are in no class but their own; texts of fewer than
``SHINGLE`` words are one shingle; exact copies (repeated rows as well) share a class; the class id is the
least doc_id of the class (null counts as least and gives null); rows sharing a doc_id keep apart by
their text; an empty table gives an empty result. Columns other than the named ones are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcases.llm.common import (NULL_ID, U, binary_list, doc_key, keyed, mix, pack, slices, small_batches, stage,
                                   unpack, windows_hash, word_hashes)

SHINGLE, SIMILAR, BANDS, ROWS, LEAST_AGREE, BLOCK = 5, 0.8, 32, 5, 0.6, 2000
BLOCK_BYTES = 8 << 20
REGISTERS = BANDS * ROWS
#: rows of an Arrow batch: a row may carry two whole documents
BATCH = 1000


def shingles(hashes: np.ndarray, counts: np.ndarray):
    """(document, shingle, weight) of a slice of documents, sorted by document and shingle."""
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, 0)
    first = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(counts)), n)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    h = windows_hash(hashes, SHINGLE, 91)
    value = h[at] if len(at) else h[:0]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        one = []
        for d in short:
            v = np.array([counts[d]], np.uint64)
            for k in range(first[d], first[d] + counts[d]):
                v = mix(v * U(0x9E3779B97F4A7C15) + hashes[k:k + 1])
            one.append(v)
        doc, value = np.append(doc, short), np.concatenate([value, *one])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    if not len(doc):
        return doc, value, doc
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])))
    return doc[new], value[new], np.diff(np.append(new, len(doc)))


def signatures(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n_docs: int,
               registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash of each document: 32-bit digests of the registers' earliest points."""
    total = np.bincount(doc, weight, minlength=n_docs)
    best = np.full((n_docs, registers), np.inf)
    limit = np.zeros(n_docs)
    todo = total > 0
    limit[todo] = registers * (math.log(registers) + 2.0) / total[todo]
    while todo.any():
        pick = todo[doc]
        d, v, w = doc[pick], value[pick], weight[pick]
        best[todo] = np.inf
        strip = 0
        while len(d):                                   # strip 0 is [0, 1), strip k [2^(k-1), 2^k)
            low, width = (0, 1) if strip == 0 else (1 << (strip - 1), 1 << (strip - 1))
            _strip(best, d, v, w, limit, strip, low, width, registers)
            more = w > low + width
            d, v, w, strip = d[more], v[more], w[more], strip + 1
        todo &= np.isinf(best).any(axis=1)              # too short a time for some register: go on longer
        limit[todo] *= 2
    out = (mix(best.view(np.uint64).ravel()) >> U(32)).astype(np.uint32)
    return out.reshape(n_docs, registers)


def _strip(best, d, v, w, limit, strip: int, low: int, width: int, registers: int) -> None:
    seed = mix(v + U((strip + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    t = np.zeros(len(d))
    flat = best.ravel()
    step = 0
    while len(d):
        step += 1
        r = mix(seed + U(step * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        t = t - np.log(((r >> U(11)).astype(np.float64) + 0.5) / 2.0 ** 53) / width
        on = t <= limit[d]
        d, w, seed, t, r = d[on], w[on], seed[on], t[on], r[on]
        s = mix(r)
        height = low + width * ((s >> U(11)).astype(np.float64) / 2.0 ** 53)
        ok = height < w
        register = ((mix(s) >> U(32)) * U(registers) >> U(32)).astype(np.int64)
        np.minimum.at(flat, d[ok] * registers + register[ok], t[ok])


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """did, th, node (digest of the multiset, null without words) and sig of every row."""
    src = docs.select(*doc_key(id_col, text_col), F.col(text_col).alias("text"))

    def run(it: Iterator[pa.RecordBatch]):
        for b in it:
            texts = binary_list(b, "text")
            node, sig = [], []
            for lo, hi in slices(texts, 1 << 20):
                d, v, w = shingles(*word_hashes(texts[lo:hi]))
                got = signatures(d, v, w, hi - lo)
                cut = np.searchsorted(d, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    a, z = cut[i], cut[i + 1]
                    if a == z:
                        node.append(None)
                        sig.append(None)
                    else:
                        node.append(xxhash.xxh3_128_digest(v[a:z].tobytes() + w[a:z].astype(np.int64).tobytes()))
                        sig.append(got[i].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.binary()),
                                              pa.array(sig, pa.binary())], ["did", "th", "node", "sig"])
    return src.mapInArrow(run, "did long, th long, node binary, sig binary")


def _agree(a: bytes, b: bytes) -> float:
    return float((np.frombuffer(a, np.uint32) == np.frombuffer(b, np.uint32)).mean())


def _similar(pairs: DataFrame, nodes: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) whose multisets have the similarity. Texts are fetched by two joins; a node in
    very many pairs is one row there, and skew handling splits its pairs."""
    bag = nodes.select("node", "bag")
    j = (pairs.join(bag.withColumnsRenamed({"node": "a", "bag": "x"}), "a")
         .join(bag.withColumnsRenamed({"node": "b", "bag": "y"}), "b"))

    def run(it: Iterator[pa.RecordBatch]):
        for batch in it:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                keep.append(weighted_jaccard(unpack(x, np.uint64), unpack(y, np.uint64)) >= similar)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))],
                                             ["a", "b"])
    return j.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def weighted_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two multisets given as sorted values with repeats: common over all."""
    both = np.sort(np.concatenate([_numbered(x), _numbered(y)]))
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common) if len(both) else 0.0


def _numbered(x: np.ndarray) -> np.ndarray:
    """A multiset as a set: the k-th copy of a value becomes a value of its own."""
    first = np.append(True, x[1:] != x[:-1])
    k = np.arange(len(x)) - np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))
    return np.where(k == 0, x, mix(x + k.astype(np.uint64) * U(0x9E3779B97F4A7C15)))


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, label): the least node of each node's component, for the nodes of ``edges`` (a, b)."""
    edges = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    label = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    label = stage(label, f"{name}-labels")
    while True:
        near = (edges.join(label.withColumnsRenamed({"node": "b", "label": "l"}), "b").groupBy("a").agg(F.min("l").alias("l")))
        new = label.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"),
                                                                              F.least("label", "l").alias("label"))
        # jump: a label is a node, whose own label is at most as large
        jump = label.select(F.col("node").alias("j"), F.col("label").alias("jl"))
        new = stage(new.join(jump, new["label"] == jump["j"]).select("node", "old", F.least("label", "jl").alias("label")),
                    f"{name}-labels")
        if not new.filter("label != old").head(1):
            return new.select("node", "label")
        label = new.select("node", "label")


def _buckets(nodes: DataFrame) -> DataFrame:
    width = 4 * ROWS
    keys = F.array(*(F.xxhash64(F.lit(b), F.substring("sig", b * width + 1, width)) for b in range(BANDS)))
    return nodes.select("node", F.posexplode(keys).alias("band", "bucket"))


def _agreeing(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree in at least the share ``least``."""
    sig = nodes.select("node", "sig")
    j = (pairs.join(sig.withColumnsRenamed({"node": "a", "sig": "x"}), "a")
         .join(sig.withColumnsRenamed({"node": "b", "sig": "y"}), "b").select("a", "b", "x", "y"))

    def run(it: Iterator[pa.RecordBatch]):
        for b in it:
            keep = pa.array([_agree(x, y) >= least for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)],
                            pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])
    return j.mapInArrow(run, "a binary, b binary")


def _across(open_members: DataFrame, least: float, similar: float, lots: int | None = None) -> DataFrame:
    """Links (a, b) that join the components meeting in a bucket. ``open_members`` holds bucket, band,
    node, label, sig and bag. A bucket is compared block against block, each pair of blocks in a group of
    its own; a block has at most ``BLOCK`` members and about ``BLOCK_BYTES`` of multisets, and all pairs of
    blocks are dealt into ``lots`` groups of about that size (as many as the shuffle partitions if not given). A pair that shares several buckets is compared
    in the first of them (they all hold its two components, so all are open). Pairs are verified where they meet, and no pair within a component is returned: a group of n members
    gives n - 1 links at most."""
    lots = lots or int(open_members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = open_members.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("bag")) / BLOCK_BYTES))
                                              .cast("int").alias("n_blocks"))
    m = open_members.join(size, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    m = m.select("bucket", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
                 "node", "label", "sig", "bag")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.stack([np.frombuffer(s, np.uint32) for s in pdf["sig"]])
        node, bag, label = pdf["node"].to_numpy(), pdf["bag"].to_numpy(), pd.factorize(pdf["label"])[0]
        own, i, j, band = (pdf[c].to_numpy() for c in ("own", "i", "j", "band"))
        out = []
        for at in pdf.groupby(["bucket", "i", "j"], sort=False).indices.values():
            out += _links_between(at[own[at] == i[at[0]]], at[own[at] == j[at[0]]], int(band[at[0]]), sig, node, label, bag,
                                  least, similar)
        return pd.DataFrame(out, columns=["a", "b"])

    # small buckets share a group; two blocks of a large one are dealt like a bucket of their own
    return (m.withColumn("lot", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(lots))).groupBy("lot")
            .applyInPandas(run, "a binary, b binary"))


def _links_between(left, right, band: int, sig, node, label, bag, least: float, similar: float) -> list[tuple]:
    """Verified links between the members ``left`` and ``right`` of one bucket that join components.
    Signatures alone decide which pairs are looked at; only their multisets are unpacked."""
    pairs = []
    for k in left:
        other = right[label[right] != label[k]]
        if not len(other):
            continue
        same = sig[other] == sig[k]
        near = same.mean(axis=1) >= least
        other, same = other[near], same[near]
        bands = same.reshape(len(other), BANDS, ROWS).all(axis=2)
        other = other[bands[:, band] & ~bands[:, :band].any(axis=1)]
        if len(other):
            pairs.append((k, other))
    if not pairs:
        return []
    need = np.unique(np.concatenate([np.append(o, k) for k, o in pairs]))
    bags = [_numbered(unpack(bag[x], np.uint64)) for x in need]
    sizes = np.array([len(x) for x in bags])
    cut = np.append(0, np.cumsum(sizes))
    element = np.unique(np.concatenate(bags), return_inverse=True)[1]
    mine = np.zeros(int(element.max()) + 1, bool)
    group = label[need].copy()
    out = []
    for k, other in pairs:
        p, q = int(np.searchsorted(need, k)), np.searchsorted(need, other)
        q = q[group[q] != group[p]]
        if not len(q):
            continue
        mine[element[cut[p]:cut[p + 1]]] = True
        common = np.array([np.count_nonzero(mine[element[cut[x]:cut[x + 1]]]) for x in q])
        mine[element[cut[p]:cut[p + 1]]] = False
        for x in q[common / (sizes[q] + sizes[p] - common) >= similar]:
            if group[x] != group[p]:
                out.append((node[need[p]], node[need[x]]))
                group[group == group[x]] = group[p]
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per input row: doc_id, class_id (least doc_id of its class), class_size and
    representative (the one row of each class that a filter keeps)."""
    got = _classes(docs, id_col, text_col, similar)
    ident = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return got.select(ident("did").alias("doc_id"), ident("class_did").alias("class_id"), "class_size",
                      "representative")


def _classes(docs: DataFrame, id_col: str, text_col: str, similar: float) -> DataFrame:
    """did, th, copy, class_did, class_size, representative of every row; ``copy`` numbers the
    exact repeats of a row that has one (1 for the first)."""
    with small_batches(docs.sparkSession, BATCH):
        return _grouped(docs, id_col, text_col, similar)


def _grouped(docs: DataFrame, id_col: str, text_col: str, similar: float) -> DataFrame:
    rows = stage(_signed(docs, id_col, text_col), "signatures")
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min(F.struct("did", "th")).alias("r"), F.first("sig").alias("sig"),
                                                                F.count("*").alias("n"))
    nodes = stage(nodes.select("node", "r.did", "r.th", "sig", "n"), "nodes")
    buckets = stage(_shared(_buckets(nodes)), "buckets")
    # everything against the first and the central node of its bucket
    ends = _centres(buckets)
    star = buckets.join(ends, "bucket")
    pairs = star.select(F.least("lo", "node").alias("a"), F.greatest("lo", "node").alias("b")).unionByName(
        star.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b"))).filter("a != b").distinct()
    close = stage(_agreeing(pairs, nodes, LEAST_AGREE), "candidates")
    bags = _bags(docs, nodes, close.select(F.explode(F.array("a", "b")).alias("node")), id_col, text_col)
    links = stage(_similar(close, bags, similar), "links")
    label = components(links)
    # buckets that still hold several components
    named = buckets.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("bucket")
    members = stage(named.join(mixed, "bucket", "left_semi"), "open")
    if members.head(1):
        bags = _bags(docs, nodes, members.select("node"), id_col, text_col)
        n, size = members.count(), bags.agg(F.avg(F.length("bag"))).first()[0] or 0
        lots = max(1, math.ceil(n * size / BLOCK_BYTES), -(-n // (4 * BLOCK)))
        members = members.join(nodes.select("node", "sig"), "node").join(bags, "node")
        more = stage(_across(members, LEAST_AGREE, similar, lots), "links-across")
        if more.head(1):
            label = components(links.unionByName(more), "links-all")
    # classes are formed on nodes, exact copies being one; written, so that neither join of a large class is
    # bound to the partitioning of an aggregate and skew handling can split it
    named = nodes.select("node", "did", "th", "n").join(label.withColumnRenamed("label", "root"), "node", "left")
    named = stage(named.withColumn("root", F.coalesce("root", "node")), "members")
    best = named.groupBy("root").agg(F.min(F.struct("did", "th")).alias("best"), F.sum("n").alias("class_size"))
    of_node = stage(named.join(stage(best, "classes"), "root").select("node", "best", "class_size"), "node-classes")
    j = rows.select("did", "th", "node").join(of_node, "node", "left")
    top = F.coalesce("best", F.struct("did", "th"))
    return j.select("did", "th", top["did"].alias("class_did"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
                    ((F.col("did") == top["did"]) & (F.col("th") == top["th"])).alias("representative"))


def _centres(buckets: DataFrame) -> DataFrame:
    """(bucket, lo, centre): the least node and the one whose buckets hold most nodes together (ties to
    the greatest). The text that many others were changed from keeps the bands that they share, so
    its buckets are the large ones: compared with it, a group comes together at once."""
    size = buckets.groupBy("bucket").agg(F.count("*").alias("n"))
    weight = buckets.join(size, "bucket").groupBy("node").agg(F.sum("n").alias("n"))
    return buckets.join(weight, "node").groupBy("bucket").agg(F.min("node").alias("lo"),
                                                              F.max(F.struct("n", "node"))["node"].alias("centre"))


def _shared(buckets: DataFrame) -> DataFrame:
    """Rows of buckets with two nodes or more."""
    many = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    return buckets.join(many, "bucket", "left_semi")


def _bags(docs: DataFrame, nodes: DataFrame, need: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, bag): the sorted shingles, packed, of the nodes in ``need``."""
    which = nodes.join(need.distinct(), "node", "left_semi").select("node", F.col("did").alias("n_did"), F.col("th").alias("n_th"))
    src = docs.select(*doc_key(id_col, text_col), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    j = src.join(which, (F.col("did") == F.col("n_did")) & (F.col("th") == F.col("n_th"))).select("node", "text")

    def run(it: Iterator[pa.RecordBatch]):
        for b in it:
            texts = binary_list(b, "text")
            out = []
            for lo, hi in slices(texts):
                d, v, w = shingles(*word_hashes(texts[lo:hi]))
                cut = np.searchsorted(d, np.arange(hi - lo + 1))
                out += [pack(np.repeat(v[a:z], w[a:z])) for a, z in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["node", "bag"])
    # exact repeats of a row would give a node twice
    return stage(j.mapInArrow(run, "node binary, bag binary").groupBy("node").agg(F.first("bag").alias("bag")), "bags")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``docs``, all columns, with one row of each class: the least doc_id; of rows that repeat its id and
    text, the one whose columns have the least hash. Rows without words all stay."""
    got = _classes(docs, id_col, text_col, similar).filter("representative").select("did", "th").distinct()
    kept = keyed(docs, id_col, text_col).join(got, ["did", "th"], "left_semi")
    twice = kept.groupBy("did", "th").agg(F.count("*").alias("n")).filter("n > 1").limit(1)
    if twice.head(1):
        text = F.col("row")[text_col]
        wordless = F.length(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x09-\\x0D]", " "))) == 0
        one = (kept.filter(~wordless).groupBy("did", "th")
               .agg(F.min_by("row", F.xxhash64(*(F.col("row")[c] for c in docs.columns))).alias("row")))
        kept = kept.filter(wordless).select("row").unionByName(one.select("row"))
    return kept.select("row.*")
