"""Operator 13, mixing sources to target weights by weighted fair queueing (DataFrame functions only).

A document's size is its number of words (runs without ASCII white space). Sources in code point order,
null last, take the weights in turn; they share ``share`` times all words by weight, none more than
``repeats`` times its own words (what it cannot use is shared again among the others by weight).

1. The documents of a source are shuffled (ordered by a digest of id and text) and queue ``repeats``
   times. The virtual finish time of a document is the words its source has queued up to its end,
   divided by the source's target: at time 1 every source has been served its target.
2. The running words of a source are sums over the leading digits of the digest: leaves of a bounded
   number of documents, running sums of leaves and of groups of leaves. No source is walked by one task.
3. All queues are merged in the order of finish times: time is cut into ranges of about ``RANGE_WORDS``
   words, dealt out by range, sorted inside; the words before a document are those of the ranges before
   plus the running words in its own. What lies beyond the budget in this order is cut off.

Identical rows (same id, text and source) are one queue entry with a number of copies until the ranges
are dealt, so a group of copies of any size stays spread. One row per source (a weight, two sums) is
sorted in one task: the number of sources is taken to be far below that of documents.

Results for odd input: null text and text without words have size 0, take 0 and queue nowhere; a source
without words has target 0; a null source is a source of its own, a null id an id like any other; rows
repeated in full are each a document; with ``share`` above ``repeats`` every target is its limit; an empty
table gives an empty result. Columns other than the three named are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcases.llm.common import stage

WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: words of the mix in a range of finish times, and queue entries in a leaf, about
RANGE_WORDS, LEAF_ROWS = 200_000, 2_000
#: ranges that one running sum goes over
GROUP = 4_096


def _key(doc_id: Column, text: Column) -> Column:
    """Digest that a document is shuffled by."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(text)))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size and the key it is shuffled by (null without words)."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col)
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return (docs.select(doc_id.alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"),
                        _key(doc_id, text).alias("key")).withColumn("key", F.when(F.col("size") > 0, F.col("key"))))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row per source: source, no (from 0, in code point order, null last), source_size, target."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    src = (sized.groupBy("source").agg(F.sum("size").alias("source_size"))
           .withColumn("no", (F.row_number().over(by_name) - 1).cast("long")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * repeats
    # sources in the order in which they reach their limit as the common level rises
    filling = Window.orderBy("full_at", "no")
    src = src.withColumn("weight", weight).withColumn("limit", limit).withColumn("full_at", F.col("limit") / F.col("weight"))
    full = F.coalesce(F.sum("limit").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything).cast("double") * F.lit(float(share))
    src = src.withColumn("level", (budget - full) / rest)
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything)
    cap = F.col("limit").cast("double")
    return src.withColumn("level", level).select(
        "source", "no", "source_size", F.coalesce(F.least(cap, F.col("weight") * F.col("level")), cap).alias("target"))


def _running(df: DataFrame, part: list, order: str, words: str, name: str) -> DataFrame:
    """``name``: sum of ``words`` over the rows before, in ``order`` within ``part``."""
    before = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(words).over(before), F.lit(0)))


def _queues(sized: DataFrame, sources: DataFrame, n_rows: int) -> DataFrame:
    """Queue entries: identical documents with their number of copies and ``before``, the words of
    the documents of their source that are queued before them."""
    digits = max(1, math.ceil(math.log(max(n_rows / LEAF_ROWS, 1), 16)))
    entries = (sized.filter("size > 0").groupBy("source", "doc_id", "key", "size").agg(F.count("*").alias("copies"))
               .withColumn("words", F.col("copies") * F.col("size"))
               .withColumn("leaf", F.substring("key", 1, digits)))
    leaves = (entries.groupBy("source", "leaf").agg(F.sum("words").alias("leaf_words"))
              .withColumn("branch", F.substring("leaf", 1, digits // 2)))
    branches = _running(leaves.groupBy("source", "branch").agg(F.sum("leaf_words").alias("branch_words")),
                        ["source"], "branch", "branch_words", "branch_before")
    leaves = (_same(_running(leaves, ["source", "branch"], "leaf", "leaf_words", "leaf_before"), branches, ["source", "branch"])
              .select("source", "leaf", (F.col("leaf_before") + F.col("branch_before")).alias("leaf_before")))
    entries = _running(entries, ["source", "leaf"], "key", "words", "here")
    return (_same(_same(entries, leaves, ["source", "leaf"]), sources, ["source"])
            .withColumn("before", F.col("here") + F.col("leaf_before"))
            .drop("here", "leaf", "leaf_before", "words"))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on columns of one name, null equal to null."""
    other = right.select(*[F.col(c).alias(f"r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [left[c].eqNullSafe(other[f"r_{c}"]) for c in keys]
    return left.join(other, on).drop(*[f"r_{c}" for c in keys])


def schedule(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Every document once per turn in the merged order: doc_id, source, key, size, source_size,
    target, copy, turn, finish (virtual), at (words up to its end in the merged order) and taken
    (whether that is within the budget). Documents without words are not in it."""
    n_rows, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    budget = total * share
    ranges = max(1, int(budget // RANGE_WORDS))
    queues = _queues(sized, targets(sized, weights, share, repeats), n_rows)

    def edge(k: Column) -> Column:      # words of its source that a range of finish times begins after
        return F.floor(k * F.col("target") / ranges)

    def copies_until(words: Column) -> Column:      # copies that end within so many words of the source
        return F.least(F.greatest(F.floor((words - F.col("base")) / F.col("size")), F.lit(0)), F.col("copies"))

    def about(words: Column) -> Column:
        return F.floor(words * ranges / F.col("target"))

    base, size = F.col("base"), F.col("size")
    turns = (queues.withColumn("turn", F.explode(F.array(*map(F.lit, range(repeats)))))
             .withColumn("base", F.col("turn") * F.col("source_size") + F.col("before")))
    # the range an entry ends in is found in whole words; the quotient only says where to look
    parts = (turns.withColumn("range", F.explode(F.sequence(F.greatest(about(base + size) - 2, F.lit(0)),
                                                            about(base + size * F.col("copies")) + 1)))
             .withColumn("first", copies_until(edge(F.col("range"))))
             .withColumn("last", copies_until(edge(F.col("range") + 1)))
             .filter("last > first").drop("copies", "before"))
    parts = stage(parts, "mixing-parts")

    per_range = (parts.groupBy("range").agg(F.sum((F.col("last") - F.col("first")) * size).alias("words"))
                 .withColumn("group", F.floor(F.col("range") / GROUP)))
    groups = _running(per_range.groupBy("group").agg(F.sum("words").alias("group_words")).withColumn("all", F.lit(0)),
                      ["all"], "group", "group_words", "group_before").select("group", "group_before")
    offsets = (_running(per_range, ["group"], "range", "words", "range_before").join(groups, "group")
               .select("range", (F.col("range_before") + F.col("group_before")).alias("range_before")))

    merged = Window.partitionBy("range").orderBy("finish", "no", "queued").rowsBetween(Window.unboundedPreceding, 0)
    # dealt by range first, so that the copies of one entry come into being spread over its ranges
    items = (parts.repartition("range").withColumn("copy", F.explode(F.sequence(F.col("first") + 1, F.col("last"))))
             .withColumn("queued", base + F.col("copy") * size)
             .withColumn("finish", F.col("queued") / F.col("target"))
             .withColumn("here", F.sum("size").over(merged)))
    return (items.join(offsets, "range").withColumn("at", F.col("here") + F.col("range_before"))
            .select("doc_id", "source", "key", "size", "source_size", "target", "copy", "turn", "finish", "at",
                    (F.col("at") <= F.lit(float(budget))).alias("taken")))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source) and taken (words that
    the mix takes of it, repeats counted)."""
    sized = stage(sizes(docs, id_col, text_col, source_col), "mixing-sizes")
    served = (schedule(sized, weights, share, repeats)
              .groupBy("doc_id", "source", "key", "size", "source_size", "target", "copy")
              .agg(F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("taken")))
    empty = _same(sized.filter("size = 0"), targets(sized, weights, share, repeats), ["source"]).withColumn(
        "taken", F.lit(0).cast("long"))
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    return served.select(*cols).unionByName(empty.select(*cols))


def mixed_texts(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """The mix itself: doc_id, source, text, turn and at, in the order of training."""
    sized = stage(sizes(docs), "mixing-sizes")
    taken = schedule(sized, weights, share, repeats).filter("taken").select("doc_id", "source", "key", "turn", "at")
    doc_id = F.col("doc_id").cast("long")
    texts = docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), "text",
                        _key(doc_id, F.col("text")).alias("key")).distinct()
    return _same(taken, texts, ["doc_id", "source", "key"]).select("doc_id", "source", "text", "turn", "at").orderBy("at")
