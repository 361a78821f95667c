"""Operator 6, benchmark decontamination with a positional inverted index (DataFrame functions only).

Words are runs of ASCII letters (A-Z counts as a-z), digits and non-ASCII characters. A window is
``width`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window.

1. Term statistics: how often each benchmark word occurs in the documents.
2. Rarest terms: each window keeps its ``RAREST`` rarest words as index terms. A window with a word
   that no document has cannot occur and leaves.
3. Index: postings (document, position) of the index terms only.
4. Intersection: a posting minus the term's offset in the item is an alignment of item and
   document. An occurring window puts all its index terms on one alignment, so alignments with
   fewer are dropped: the lists, adjusted by their offsets, are intersected by a count.
5. Exact phrases: the remaining alignments are compared word by word, window by window.

The benchmark's terms go to every task only where they were counted to be at most ``BROADCAST_TERMS``;
above that the same join shuffles, and its frequent terms are split by skew handling.

Results for odd input: null and empty texts have no words and no hits; null or wordless items are no
windows; items with equal texts all count; repeated item rows count once; rows sharing a doc_id keep
apart by their text, exact repeats get equal rows; null ids are kept; empty tables give no hits (no
benchmark) or no rows (no documents). Columns other than the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcases.llm.common import doc_key, stage

WIDTH, RAREST, BROADCAST_TERMS = 13, 3, 200_000
#: a word in text as written; A-Z are made small afterwards, which changes no word's limits. The other ASCII
#: characters are listed one by one: Java looks listed ones up in a table, but tries ranges in turn at every character
WORD = "[^" + "".join(rf"\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def small(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Different item texts (ik, words), and the item ids of each."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words(small(F.col(text_col))).alias("iw"))
    rows = rows.filter(F.size("iw") > 0).withColumn("ik", F.sha2(F.concat_ws(" ", "iw"), 256))
    return rows.groupBy("ik").agg(F.first("iw").alias("iw")), rows.select("ik", "item_id").distinct()


def _meet(left: DataFrame, terms: DataFrame, on: str) -> DataFrame:
    """Inner join with a table of terms, broadcast only after its rows were counted."""
    return left.join(F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms, on)


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Positional index over the given terms (column ``term``, Unicode lower case): did, th, pos, term."""
    found = docs.select(*doc_key(id_col, text_col), F.posexplode(words(F.col(text_col))).alias("pos", "word"))
    return _meet(found.select("did", "th", "pos", F.lower("word").alias("term")), terms, "term")


def _index_terms(docs: DataFrame, items: DataFrame, width: int, text_col: str) -> DataFrame:
    """(term, ik, offset) for the rarest words of every window that can occur at all."""
    at = items.select("ik", F.size("iw").alias("n"), F.posexplode("iw").alias("offset", "word"))
    at = at.select("ik", "n", "offset", F.lower("word").alias("term"))
    found = docs.select(F.explode(words(F.col(text_col))).alias("word")).select(F.lower("word").alias("term"))
    freq = stage(_meet(found, at.select("term").distinct(), "term").groupBy("term").agg(F.count("*").alias("freq")),
                 "term-frequency")
    known = at.join(freq, "term", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    w = F.least(F.lit(width), F.col("n"))
    each = known.select("ik", "offset", "term", "freq", w.alias("w"), F.explode(F.sequence(
        F.greatest(F.lit(0), F.col("offset") - w + 1), F.least(F.col("offset"), F.col("n") - w))).alias("start"))
    order = F.struct("freq", "term", "offset")
    picked = (each.groupBy("ik", "start").agg(F.min("freq").alias("least"), F.sort_array(F.collect_list(order)).alias("t"))
              .filter("least > 0").select("ik", F.explode(F.slice("t", 1, RAREST)).alias("t")))
    return picked.select("ik", F.col("t.term").alias("term"), F.col("t.offset").alias("offset")).distinct()


def alignments(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(did, th, ik, iw, delta): item and document laid so that item word i meets document word
    delta + i, for every alignment that can hold a window."""
    index = stage(_index_terms(docs, items, width, text_col), "index-terms")
    found = postings(docs, index.select("term").distinct(), id_col, text_col)
    laid = _meet(found, index, "term").select("did", "th", "ik", (F.col("pos") - F.col("offset")).alias("delta"))
    laid = laid.groupBy("did", "th", "ik", "delta").agg(F.count("*").alias("met"))
    sized = items.select("ik", "iw", F.least(F.lit(RAREST), F.size("iw")).alias("least"))
    return laid.filter(F.col("met") >= 1).join(sized, "ik").filter("met >= least").select("did", "th", "ik", "iw", "delta")


def _occurring(width: int) -> Column:
    """Windows of the row's alignments that are equal to the document's words: (ik, start, len)."""
    def per(c):
        n = F.size(c["iw"])
        w = F.least(F.lit(width), n)
        lo = F.greatest(F.lit(0), -c["delta"])
        hi = F.least(n - w, F.col("n_words") - w - c["delta"])

        def same(s):
            return F.slice(F.col("dw"), c["delta"] + s + 1, w) == F.slice(c["iw"], s + 1, w)
        starts = F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(starts, same), lambda s: F.struct(
            c["ik"].alias("ik"), (c["delta"] + s).alias("start"), w.alias("len")))
    return F.flatten(F.transform("cands", per))


def phrase_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id",
                text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                keys: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, items (ids of items with occurring windows,
    sorted as strings) and hits (start and length of the occurring windows, in words); with
    ``keys`` also the row's key (did, th)."""
    items, ids = _items(benchmark, item_id_col, item_text_col)
    items = stage(items, "items")
    cands = (alignments(docs, items, width, id_col, text_col).groupBy("did", "th")
             .agg(F.collect_list(F.struct("ik", "iw", "delta")).alias("cands"))
             .withColumnsRenamed({"did": "c_did", "th": "c_th"}))
    src = docs.select(F.col(id_col).alias("doc_id"), *doc_key(id_col, text_col), F.col(text_col).alias("text"))
    both = src.join(cands, (F.col("did") == F.col("c_did")) & (F.col("th") == F.col("c_th")), "left")
    both = both.select("doc_id", "did", "th", F.size(words(F.col("text"))).alias("n_words"), "cands",
                       F.when(F.col("cands").isNotNull(), words(small(F.col("text")))).alias("dw"))
    hits = both.select("doc_id", "did", "th", "n_words", F.coalesce(_occurring(width), F.array().cast(
        "array<struct<ik:string,start:int,len:int>>")).alias("hits"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1))))
    out = stage(hits.select("doc_id", "did", "th", F.col("n_words").cast("long").alias("n_words"), "hits",
                            F.size(covered).cast("long").alias("n_hit")), "phrase-hits")
    of = (out.select("did", "th", F.explode("hits.ik").alias("ik")).distinct().join(ids, "ik")
          .groupBy("did", "th").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
          .withColumnsRenamed({"did": "i_did", "th": "i_th"}))
    return (out.join(of, (F.col("did") == F.col("i_did")) & (F.col("th") == F.col("i_th")), "left")
            .select("doc_id", *(["did", "th"] if keys else []), "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["len"].alias("len"))).alias("hits")))


def contaminated() -> Column:
    """At least one word in twenty of a document is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def proximity_hits(docs: DataFrame, benchmark: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text",
                   item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, pos): documents in which every different word of an item occurs within
    ``slop`` words of an occurrence (at pos) of the item's rarest word, in any order."""
    items, ids = _items(benchmark, item_id_col, item_text_col)
    at = items.select("ik", F.explode(F.array_distinct(F.transform("iw", F.lower))).alias("term"))
    found = stage(postings(docs, at.select("term").distinct(), id_col, text_col), "proximity-postings")
    freq = found.groupBy("term").agg(F.count("*").alias("freq"))
    known = at.join(freq, "term", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    rare = known.groupBy("ik").agg(F.min(F.struct("freq", "term")).alias("r"), F.count("*").alias("n"))
    rare = stage(rare.select("ik", "n", F.col("r.term").alias("term"), F.col("r.freq").alias("freq")), "proximity-rarest")
    anchor = found.join(rare.filter("freq > 0"), "term").select("did", "th", "ik", "n", F.col("pos").alias("pos0"))
    # positions within slop share a cell of slop + 1 positions or are in neighbouring ones
    cell = F.floor(F.col("pos0") / (slop + 1))
    anchor = anchor.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    other = found.join(at, "term").withColumn("cell", F.floor(F.col("pos") / (slop + 1)))
    met = (anchor.join(other, ["did", "th", "ik", "cell"]).filter(F.abs(F.col("pos") - F.col("pos0")) <= slop)
           .groupBy("did", "th", "ik", "pos0", "n").agg(F.count_distinct("term").alias("met")).filter("met = n"))
    back = docs.select(F.col(id_col).alias("doc_id"), *doc_key(id_col, text_col)).withColumnsRenamed({"did": "d", "th": "t"})
    return (met.join(ids, "ik").join(back, (F.col("did") == F.col("d")) & (F.col("th") == F.col("t")))
            .select("doc_id", "item_id", F.col("pos0").alias("pos")))
