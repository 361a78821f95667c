"""Operator 7, Merkle fixity audit of WARC replicas.

A page is a WARC resource record; its leaf is the SHA-256 of the record's bytes. An archive is the
records in the order of (page id, leaf); a node stands for an ordered range of page ids, and
thereby for a range of offsets of the archive: level 0 is one id, a node of level k the ``FAN``^k ids from
its number times that. A node's hash is that of its children's hashes in order. Two replicas are
compared from the root down: only the children of nodes that differ are read, and only the records
of the page ids that differ in the end.

Many versions of one page id are hashed in parts by the first digits of their leaves, exact copies
as one leaf with its count, and their offsets and turns are summed part by part, so neither a list nor
a window grows with a frequent id.

Results for odd input: null url and html count as empty; a null page id is an id before all others
and comes back null; exact copies of a record are told by their number (``copies``); an empty replica
has no nodes, so every record of the other is missing or extra; two empty ones agree. Columns other
than the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetcases.llm.common import NULL_ID, stage

FAN_BITS = 6
FAN = 1 << FAN_BITS


def warc_record(url: Column, body: Column) -> Column:
    """Bytes (as text) of a WARC resource record."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(id, leaf, length, copies) of an archive's different records."""
    rec = warc_record(F.col(url_col), F.col(body_col))
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), rec.alias("rec"))
    rows = rows.select("id", F.sha2("rec", 256).alias("leaf"), F.octet_length("rec").cast("long").alias("length"))
    return rows.groupBy("id", "leaf", "length").agg(F.count("*").alias("copies"))


def _hash(entries: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(entries), "\n"), 256)


def _before(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its ``keys`` with lesser leaves: sums of the
    parts told by the leaf's first digits, then within a part."""
    df = df.withColumn("p", F.substring("leaf", 1, 3)).withColumn("__v", value)
    sums = df.groupBy(*keys, "p").agg(F.sum("__v").alias("__n"))
    sums = sums.withColumn("__base", F.coalesce(F.sum("__n").over(
        W.partitionBy(*keys).orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inner = F.coalesce(F.sum("__v").over(
        W.partitionBy(*keys, "p").orderBy("leaf").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.join(sums, [*keys, "p"]).withColumn(name, F.col("__base") + inner).drop("p", "__v", "__base")


class Tree:
    """Written levels of an archive's tree, from page ids up, and its root."""

    def __init__(self, recs: DataFrame, depth: int, name: str):
        self.records = recs
        size = F.sum(F.col("length") * F.col("copies")).alias("n_bytes")
        part = (recs.groupBy("id", F.substring("leaf", 1, 3).alias("p"))
                .agg(_hash(F.collect_list(F.concat_ws(" ", "leaf", F.col("copies").cast("string")))).alias("h"), size))
        level = part.groupBy(F.col("id").alias("node")).agg(
            _hash(F.collect_list(F.concat_ws(" ", "p", "h"))).alias("hash"), F.sum("n_bytes").alias("n_bytes"))
        self.levels = []
        for k in range(depth):
            level = stage(level.withColumn("parent", F.shiftright("node", FAN_BITS) if k < depth - 1
                                           else F.lit(0).cast("long")), f"{name}-{k}")
            self.levels.append(level)
            # the sort key keeps the children in the order of their numbers
            order = F.struct("node", "hash")
            level = level.groupBy(F.col("parent").alias("node")).agg(F.sha2(F.array_join(F.transform(
                F.sort_array(F.collect_list(order)), lambda s: s["hash"]), "\n"), 256).alias("hash"),
                F.sum("n_bytes").alias("n_bytes"))
        top = level.head(1)
        self.root = top[0]["hash"] if top else None


def depth_for(*archives: DataFrame) -> int:
    """Levels until at most ``FAN`` or so nodes are left for the root, the same for all replicas."""
    spans = [a.filter(F.col("id") != NULL_ID).agg(F.min("id"), F.max("id")).first() for a in archives]
    lo = min([s[0] for s in spans if s[0] is not None], default=0)
    hi = max([s[1] for s in spans if s[1] is not None], default=0)
    depth, n = 1, hi - lo + 1
    while n > FAN:
        depth, n = depth + 1, n // FAN + 1
    return depth


def audit(left: DataFrame, right: DataFrame, **names) -> DataFrame:
    """Records in which replica ``right`` departs from ``left``: page_id, status (corrupt, missing,
    extra), expected and found (leaves), offset and length (of the record in ``left``)."""
    a, b = stage(records(left, **names), "fixity-left"), stage(records(right, **names), "fixity-right")
    depth = depth_for(a, b)
    ta, tb = Tree(a, depth, "tree-left"), Tree(b, depth, "tree-right")
    bad = left.sparkSession.createDataFrame([(0, 0)] if ta.root != tb.root else [], "node long, offset long")
    for k in range(depth - 1, -1, -1):
        parent = bad.select(F.col("node").alias("parent"), F.col("offset").alias("from"))
        la = ta.levels[k].join(parent, "parent").withColumn("offset", F.col("from") + F.coalesce(F.sum("n_bytes").over(
            W.partitionBy("parent").orderBy("node").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        lb = tb.levels[k].join(parent.select("parent"), "parent").select("node", F.col("hash").alias("other"))
        both = la.select("node", "hash", "offset").join(lb, "node", "full")
        bad = both.filter(~F.col("hash").eqNullSafe(F.col("other"))).select("node", "offset")
        bad = stage(bad, f"fixity-{k}")
    ids = bad.select(F.col("node").alias("id"), "offset")
    ra = _before(a.join(ids, "id"), ["id"], F.col("length") * F.col("copies"), "before")
    ra = ra.withColumn("offset", F.col("offset") + F.col("before")).drop("before")
    rb = b.join(ids.select("id"), "id", "left_semi").select("id", "leaf", F.col("copies").alias("found_copies"))
    d = ra.join(rb, ["id", "leaf"], "full").filter(~F.col("copies").eqNullSafe(F.col("found_copies")))
    # versions of an id that are only here or only there are matched in order; the rest is missing or extra
    d = d.withColumn("here", F.coalesce("copies", F.lit(0)) > F.coalesce("found_copies", F.lit(0)))
    d = _before(stage(d, "fixity-records"), ["id", "here"], F.lit(1), "turn")
    gone = d.filter("here").select("id", "turn", F.col("leaf").alias("expected"), "offset", "length")
    new = d.filter(~F.col("here")).select("id", "turn", F.col("leaf").alias("found"))
    out = gone.join(new, ["id", "turn"], "full")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("corrupt")
    return out.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("page_id"), status.alias("status"), "expected",
                      "found", "offset", "length")
