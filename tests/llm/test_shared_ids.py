"""Rows that share an id, or have none, and tables whose columns are named like an operator's own."""

import numpy as np
import pytest

import corpus_pipeline
from fleetcases.llm import near_dedup, pii, substring_dedup, suffix_dedup
from fleetcases.llm.common import block_of, doc_key

PASSAGE = " ".join(f"passage{i} of{i % 5} words" for i in range(40))


def _null_ids(n=5000, shared=500):
    rng = np.random.default_rng(7)
    clean = [" ".join(rng.choice(2000, 60).astype(str)) for _ in range(n - shared)]
    return clean, [f"{' '.join(rng.choice(2000, 30).astype(str))} {PASSAGE} {i}" for i in range(shared)]


@pytest.mark.parametrize("op", ["bytes", "words"])
def test_clean_rows_without_an_id_lose_nothing(spark, op):
    clean, dirty = _null_ids()
    docs = spark.createDataFrame([(None, t) for t in clean + dirty], "doc_id long, text string").repartition(4)
    if op == "bytes":
        got = suffix_dedup.remove_repeated_bytes(docs).select("n_bytes", "n_removed", "kept").collect()
        kept = {bytes(r["kept"]).decode() for r in got if not r["n_removed"]}
        assert sum(r["n_removed"] > 0 for r in got) == len(dirty)
    else:
        got = substring_dedup.remove_repeats(docs).select("n_removed", "kept_text").collect()
        kept = {r["kept_text"] for r in got if not r["n_removed"]}
        # without ids no row is earlier than another at the same start, so the passage may stay at one place
        assert len(dirty) - 1 >= sum(r["n_removed"] > 0 for r in got)
    assert set(clean) <= kept and len(got) == len(clean) + len(dirty)


def test_rows_of_one_id_spread_over_blocks(spark):
    clean, _ = _null_ids(800, 0)
    docs = spark.createDataFrame([(None, t) for t in clean], "doc_id long, text string")
    keys = docs.select(*doc_key())
    blocks = [r["b"] for r in keys.select(block_of(keys["did"], keys["th"], 17).alias("b")).collect()]
    assert set(blocks) == set(range(17)) and max(np.bincount(blocks)) < 100
    did, th = (np.array([r[c] for r in keys.collect()], np.int64) for c in ("did", "th"))
    assert sorted(block_of(did, th, 17).tolist()) == sorted(blocks)


NAMES = ("__did", "__th", "__cut", "did", "th", "row", "cut", "n", "node", "part", "block", "spans", "text_bytes")


def test_further_columns_may_have_any_name(spark):
    text = "write to someone@example.org or call +1 (736) 555-2678 today " + " ".join(f"w{i}" for i in range(30))
    rows = [(i, text if i < 3 else f"{text} {i * 7919} other tail number {i}", *([f"c{i}"] * len(NAMES))) for i in range(8)]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES)
    docs = spark.createDataFrame(rows, schema)
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert all("<EMAIL>" in r["text"] and r["__cut"] == f"c{i}" and r["row"] == f"c{i}" for i, r in got.items())
    one = near_dedup.keep_one(docs)
    assert one.columns == docs.columns and 0 in {r["doc_id"] for r in one.collect()} and one.count() < 8
    sf = "/root/testdata/sf0.001"
    assert corpus_pipeline.drop_contaminated(spark, docs, sf).columns == docs.columns
    assert corpus_pipeline.drop_contaminated(spark, docs, sf).count() == 8


def test_of_repeated_rows_the_same_one_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, f"s{i}") for i in range(20)]
    kept = set()
    for parts in (1, 3, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts, "source")
        got = near_dedup.keep_one(docs).collect()
        assert len(got) == 1
        kept.add(got[0]["source"])
    assert len(kept) == 1
