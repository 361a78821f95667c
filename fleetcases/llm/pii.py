"""Operator 10, personal data by bootstrapped contextual extraction (DataFrame functions only).

Base entities (email, ip, card, phone) are found by pattern and check. They, and values with a
machine-made looking run inside, are the seeds. Instances are runs of letters, digits and ``- _ . / + @``
with a digit; their lexical patterns are the word before them with the mark between (``password=``,
``token = "``), the bare word before (``passport``) and the word after. Patterns and instances form a
bipartite graph over the whole corpus, scored in turns until no pattern moves by ``SETTLED``: a pattern by
the mean score of its different instances, an instance by the patterns it occurs with. A pattern counts
only with the share of its occurrences, over all texts, that stand beside a value (at least half). Values in high-confidence patterns are found as
kind ``key``, whether or not they look like a seed. Scores only rise and stay below 1, so the turns end.

Positions are code points, end exclusive. Java's ``split`` and ``regexp_extract_all`` walk the same
matches, so the running sum of the lengths of pieces and matches gives each match its place.

Results for odd input: null text counts as empty and has no spans; candidates overlapping a base
span are not added; a pattern needs ``MIN_VALUES`` different values; values have ``LEAST`` characters or more,
pattern words 2 to 24 letters; rows sharing a doc_id keep apart
by their text, exact repeats get equal rows; null ids are kept; an empty table gives an empty result.
Columns other than the named ones are not read (``redact`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetcases.llm.common import doc_key, keyed, stage

KINDS = ("email", "ip", "card", "phone")
FOUND_KIND = "key"
MIN_VALUES, CONFIDENT, LEAST, SETTLED = 5, 0.8, 6, 0.01
# The patterns of the contract. A local part or a number can only start where a run starts (or a
# match has just ended), so a long run is walked once, not once from each of its characters; and
# single separators inside a card number are first turned into one character, so that the
# pattern is a plain run and needs no nested repetition.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = "[0-9][0-9\u0001]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SET = r"[0-9A-Za-z_./+@-]"
#: a value: from one bound of its characters to the other, with a digit and long enough
_TOKEN = rf"(?<!{_SET})[0-9A-Za-z](?:{_SET}*[0-9A-Za-z])?"
_VALUE = rf"(?<!{_SET})(?={_SET}{{{LEAST}}})(?=[A-Za-z_./+@-]*+[0-9]){_TOKEN}"
#: the word before with a mark (it holds one of = : " # and possibly spaces), the bare word before, the word after
_WORD = r"(?<![\p{L}_])[\p{L}_]{2,24}+"
_MARKED = rf"{_WORD} {{0,2}}[=:#\"][=:#\" ]{{0,3}}(?={_TOKEN})"
_BEFORE = rf"{_WORD}(?: {{0,2}}[=:#\"][=:#\" ]{{0,3}}| {{1,2}}){_VALUE}"
_AFTER = rf"{_VALUE}[\"),;]{{0,2}} {{1,2}}[\p{{L}}_]{{2,24}}+(?![\p{{L}}_])"
CONTEXTS = ("before", "after")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def _matches(kind: str, text: Column, pattern: str, trigger: Column) -> Column:
    """Array of (kind, idx, gap, match): gap is the length of the text before the match, after the
    one before. Texts without the trigger are not searched."""
    hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.zip_with(hit, F.slice(gaps, 1, F.size(hit)), lambda m, g: F.struct(g.alias("gap"), m.alias("match")))
    rows = F.transform(rows, lambda r, i: F.struct(F.lit(kind).alias("kind"), i.alias("idx"), r["gap"].alias("gap"),
                                                   r["match"].alias("match")))
    empty = F.array().cast("array<struct<kind:string,idx:int,gap:int,match:string>>")
    return F.coalesce(F.when(trigger, rows), empty)


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(did, th, kind, start, end, match, copies) of base matches that pass their check, and of contexts;
    copies is the number of equal rows."""
    t = F.col("text")
    single = F.regexp_replace(F.regexp_replace(t, "\u0001", "\u0002"), r"(?<=[0-9])[ -](?=[0-9])", "\u0001")
    src = docs.select(*doc_key(id_col, text_col), F.col(text_col).alias("text")).filter(
        t.contains("@") | t.rlike("[0-9]"))
    rows = src.select("did", "th", F.explode(F.concat(
        _matches("email", t, _EMAIL, t.contains("@")),
        _matches("ip", t, _IP, t.rlike(r"[0-9]\.[0-9]")),
        _matches("card", single, _CARD, t.rlike(r"[0-9][0-9 -][0-9]|[0-9][0-9]")),
        _matches("phone", t, _PHONE, t.rlike(r"\+[0-9]")),
        _matches("before", t, _BEFORE, t.rlike("[0-9]")),
        _matches("after", t, _AFTER, t.rlike("[0-9]")))).alias("r")).select("did", "th", "r.*")
    # exact repeats of a row have the same matches: keep one of each before adding up
    rows = rows.groupBy("did", "th", "kind", "idx", "gap", "match").agg(F.count("*").alias("copies"))
    order = W.partitionBy("did", "th", "kind").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    n = F.length("match")
    placed = rows.withColumn("end", F.sum(F.col("gap") + n).over(order)).withColumn("start", F.col("end") - n)
    digits, size = _digits(F.col("match")), F.length(_digits(F.col("match")))
    ok = (F.when(F.col("kind") == "ip", F.col("match").rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
          .when(F.col("kind") == "card", F.when(size.between(13, 19), _luhn(digits)).otherwise(False))
          .when(F.col("kind") == "phone", size.between(9, 15)).otherwise(True))
    return placed.filter(ok).select("did", "th", "kind", F.col("start").cast("long").alias("start"),
                                    F.col("end").cast("long").alias("end"), "match", "copies")


def _contexts(found: DataFrame) -> DataFrame:
    """Contexts as (did, th, start, end, value, pattern, sign, copies): the place of the value; sign is what is counted over all
    texts, the pattern itself or its bare word."""
    before = F.col("kind") == "before"
    value = F.when(before, F.regexp_extract("match", rf"({_TOKEN})$", 1)).otherwise(F.regexp_extract("match", rf"^({_TOKEN})", 1))
    rest = F.length("match") - F.length("value")
    side = F.when(before, F.expr("left(match, length(match) - length(value))")).otherwise(
        F.expr("right(match, length(match) - length(value))"))
    side = F.regexp_replace(F.lower(side), " +", " ")
    marked, word = before & side.rlike("[=:#\"]"), F.regexp_extract(side, r"([\p{L}_]+)", 1)
    bare = F.when(before, F.concat(word, F.lit(" _"))).otherwise(F.concat(F.lit("_ "), word))
    return found.filter(F.col("kind").isin(*CONTEXTS)).withColumn("value", value).select(
        "did", "th", F.when(before, F.col("start") + rest).otherwise(F.col("start")).alias("start"),
        F.when(before, F.col("end")).otherwise(F.col("end") - rest).alias("end"), "value",
        F.when(marked, side).otherwise(bare).alias("pattern"), F.when(marked, side).otherwise(word).alias("sign"), "copies")


def _signs(texts: DataFrame) -> DataFrame:
    """(sign, in_all): how often every word, and every word with a mark, stands in the texts."""
    t = F.lower("text")
    marked = F.transform(F.regexp_extract_all(t, F.lit(_MARKED), F.lit(0)), lambda x: F.regexp_replace(x, " +", " "))
    none = F.array().cast("array<string>")
    both = F.concat(F.split(t, r"[^\p{L}_]+"), F.when(t.rlike("[=:#\"]"), marked).otherwise(none))
    return texts.select(F.explode(both).alias("sign")).groupBy("sign").agg(F.count("*").alias("in_all"))


def learn_patterns(contexts: DataFrame, base: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern, score, n_values): the graph of ``contexts`` scored in turns. ``base``: the base matches (match), ``texts``: all
    texts (text), for how often a pattern stands without a value."""
    run = F.regexp_extract_all("value", F.lit("[0-9A-Za-z]{12,}"), F.lit(0))
    made = F.exists(run, lambda r: (F.length(_digits(r)) >= 3) & (F.length(r) - F.length(_digits(r)) >= 3))
    known = base.select(F.col("match").alias("value")).distinct().withColumn("known", F.lit(True))
    edges = contexts.groupBy("value", "pattern", "sign").agg(F.sum("copies").alias("times"))
    edges = stage(edges.join(known, "value", "left").select(
        "value", "pattern", "sign", "times", F.when(made | F.col("known"), 1.0).otherwise(0.0).alias("seed")), "pii-edges")
    # a pattern with too few values can neither be learned nor vouch for a value
    many = edges.groupBy("pattern", "sign").agg(F.sum("times").alias("times"), F.count("*").alias("n_values"))
    many = stage(many.filter(F.col("n_values") >= MIN_VALUES), "pii-many")
    share = F.least(F.lit(1.0), F.col("times") / F.col("in_all"))
    shares = stage(many.join(_signs(texts), "sign").select("pattern", "n_values", share.alias("share")).filter("share >= 0.5"),
                   "pii-shares")
    edges = stage(edges.select("value", "pattern", "seed").join(shares, "pattern"), "pii-graph")
    score, last = edges.select("value", F.col("seed").alias("s")).distinct(), None
    while True:
        patterns = stage(edges.join(score, "value").groupBy("pattern", "n_values", "share").agg(
            (F.sum("s") / (F.count("*") + 0.5) * F.col("share")).alias("score")), "pii-patterns")
        if last is not None:
            moved = patterns.join(last.select("pattern", F.col("score").alias("was")), "pattern")
            if moved.filter(F.col("score") > F.col("was") + SETTLED).isEmpty():
                return patterns.select("pattern", "score", "n_values")
        last = patterns
        # a value's doubt is the product of its patterns' doubts; seeds keep their score
        sure = patterns.filter("score >= 0.5").select("pattern", "score")
        doubt = F.exp(F.sum(F.log(1 - F.coalesce("score", F.lit(0.0)))))
        score = edges.join(sure, "pattern", "left").groupBy("value").agg(F.greatest(F.max("seed"), 1 - doubt).alias("s"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, th, kind, start, end): base spans and those that the learned patterns add."""
    found = stage(_found(docs, id_col, text_col), "pii-found")
    is_base = F.col("kind").isin(*KINDS)
    contexts = stage(_contexts(found), "pii-contexts")
    sure = learn_patterns(contexts, found.filter(is_base), docs.select(F.col(text_col).alias("text"))).filter(
        F.col("score") >= CONFIDENT).select("pattern")
    keys = contexts.join(sure, "pattern").select(
        "did", "th", F.lit(FOUND_KIND).alias("kind"), "start", "end").distinct()
    base = found.filter(is_base).select("did", "th", "kind", "start", "end")
    # a key that overlaps a base span is dropped: the ends before and the starts after it tell
    own = W.partitionBy("did", "th").orderBy("start", "end")
    both = base.unionByName(keys).withColumns({
        "before": F.max(F.when(is_base, F.col("end"))).over(own.rowsBetween(W.unboundedPreceding, 0)),
        "after": F.min(F.when(is_base, F.col("start"))).over(own.rowsBetween(0, W.unboundedFollowing))})
    free = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    return both.filter(is_base | free).select("did", "th", "kind", "start", "end")


def _rank() -> Column:
    return F.array_position(F.array(*map(F.lit, (*KINDS, FOUND_KIND))), F.col("kind"))


def span_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and spans (kind, start, end), by kind as listed, then start."""
    spans = find_spans(docs, id_col, text_col).groupBy("did", "th").agg(F.sort_array(F.collect_list(
        F.struct(_rank().alias("rank"), "start", "end", "kind"))).alias("spans")).withColumnsRenamed({"did": "s_did", "th": "s_th"})
    src = docs.select(F.col(id_col).alias("doc_id"), *doc_key(id_col, text_col))
    empty = F.array().cast("array<struct<rank:bigint,start:bigint,end:bigint,kind:string>>")
    return (src.join(spans, (F.col("did") == F.col("s_did")) & (F.col("th") == F.col("s_th")), "left")
            .select("doc_id", F.coalesce("spans", empty).alias("spans")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with every span replaced by its kind in angle brackets (overlapping
    spans together by the first one's)."""
    spans = find_spans(docs, id_col, text_col)
    own = W.partitionBy("did", "th").orderBy("start", F.desc("end"), "kind")
    first = F.coalesce(F.max("end").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1)) <= F.col("start")
    parts = spans.withColumn("part", F.sum(F.when(first, 1).otherwise(0)).over(
        own.rowsBetween(W.unboundedPreceding, 0)))
    parts = parts.groupBy("did", "th", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"),
                                                   F.min_by("kind", F.struct("start", -F.col("end"), "kind")).alias("kind"))
    prev = F.coalesce(F.lag("end").over(W.partitionBy("did", "th").orderBy("part")), F.lit(0))
    lists = parts.withColumn("gap", prev).groupBy("did", "th").agg(
        F.sort_array(F.collect_list(F.struct("part", "gap", "start", "end", "kind"))).alias("cut"))
    j = keyed(docs, id_col, text_col).join(lists, ["did", "th"], "left")
    t = F.col("row")[text_col]
    kept = F.transform("cut", lambda c: F.concat(t.substr((c["gap"] + 1).cast("int"), (c["start"] - c["gap"]).cast("int")),
                                                 F.lit("<"), F.upper(c["kind"]), F.lit(">")))
    rest = t.substr((F.element_at("cut", -1)["end"] + 1).cast("int"), F.length(t))
    text = F.when(F.col("cut").isNotNull(), F.concat(F.array_join(kept, ""), rest)).otherwise(t)
    return j.select(*((text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))
