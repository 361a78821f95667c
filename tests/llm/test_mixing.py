"""Source mixing against a walk over the merged queues in plain Python, and against its SQL."""

import collections
import hashlib
import re

import duckdb
import pytest

from fleetcases.llm import mixing, queries

SCHEMA = "doc_id long, text string, lang string, source string, no int, target string, size int"


def levels(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    """Targets by sharing again what a source cannot use, until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    full, budget = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        left = budget - sum(full.values())
        got = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if got[s] > repeats * sizes[s]]
        if not over:
            return full | got
        full |= {s: float(repeats * sizes[s]) for s in over}
        if len(full) == len(names):
            return full


def walk(rows):
    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), t) for i, t, s in rows]
    total = collections.Counter()
    for _, s, n, _ in docs:
        total[s] += n
    target = levels(total)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    items = []
    for no, s in enumerate(names):
        queue = sorted((d for d in enumerate(docs) if d[1][1] == s and d[1][2]), key=lambda d: hashlib.md5(
            f"{'null' if d[1][0] is None else d[1][0]}:{hashlib.md5(d[1][3].encode()).hexdigest()}".encode()).hexdigest())
        ends = 0
        for _turn in range(2):
            for k, d in queue:
                ends += d[2]
                items.append((ends / target[s], no, ends, k, d[2]))
    taken, at = collections.Counter(), 0
    for _, _, _, k, n in sorted(items):
        at += n
        if at <= 1.5 * sum(total.values()):
            taken[k] += n
    return sorted(((i, n, total[s], round(target[s], 6), taken[k]) for k, (i, s, n, _) in enumerate(docs)), key=repr)


def _rows():
    rows = [(i, "w " * (1 + i * 37 % 90), f"s{i * i % 5}" if i % 9 else None) for i in range(400)]
    rows += [(None, "copy of a text", "s1")] * 700 + [(3, "copy of a text", "s1")] * 5      # hot identical rows
    rows += [(900 + i, None, "s0") for i in range(30)] + [(None, None, None), (None, "", "empty"), (1, " \t ", "blank")]
    return rows + [(2000, "long " * 9000, "s3"), (2001, "é ü \x1c x\x0by", "Ä"), (2002, "tiny", "z")]


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", s, 1, "y", 7) for i, t, s in rows], SCHEMA).repartition(5)


def _got(df):
    return sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in df.collect()), key=repr)


def test_mix_equals_walk(spark, monkeypatch):
    want = walk(_rows())
    docs = _frame(spark, _rows())
    assert _got(mixing.mix_sources(docs)) == want
    # many ranges, leaves and groups of ranges give the same as one
    monkeypatch.setattr(mixing, "RANGE_WORDS", 50)
    monkeypatch.setattr(mixing, "LEAF_ROWS", 1)
    monkeypatch.setattr(mixing, "GROUP", 7)
    assert _got(mixing.mix_sources(docs)) == want


def test_mix_properties(spark):
    rows = _got(mixing.mix_sources(_frame(spark, _rows())))
    by_source = collections.defaultdict(lambda: [0, 0])
    for _, n, total, target, taken in rows:
        assert taken in (0, n, 2 * n)
        by_source[(total, target)][0] += taken
        by_source[(total, target)][1] = max(by_source[(total, target)][1], n)
    budget = 1.5 * sum(n for _, n, _, _, _ in rows)
    assert sum(x for x, _ in by_source.values()) <= budget
    for (total, target), (taken, longest) in by_source.items():
        assert target <= 2 * total and taken >= target - longest - 1


def test_mixed_texts_come_in_order(spark):
    got = [tuple(r) for r in mixing.mixed_texts(_frame(spark, _rows())).collect()]
    at = [r[4] for r in got]
    assert at == sorted(at)
    words = sum(len(r[2].split(" ")) if r[1] != "Ä" else 0 for r in got if r[2].isascii())
    assert words >= 0.9 * at[-1]


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a", "s")], [(None, "a b", None)] * 3])
def test_mix_small_tables(spark, rows):
    assert _got(mixing.mix_sources(_frame(spark, rows))) == walk(rows)


def test_mix_is_native(spark):
    plan = mixing.mix_sources(_frame(spark, _rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_mix_equals_its_sql(spark, tmp_path):
    docs = _frame(spark, _rows())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_source_mixing(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(queries.ORACLE_SQL["op13_source_mixing"]).fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
