"""O1-O3 truth table, dedupe rule D2, and a randomised islands check."""

import datetime as dt
import itertools

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL, rows, srt
from fleetcases.operators.cases import build_cases, build_cases_legacy, flag_case_boundaries
from fleetcases.sources.fixtures import PARAMS, Fixtures

OCT = lambda d: dt.date(2020, 10, d)
AS_OF = OCT(20)
TRUTH_DAYS = {"A": [8, 9, 10], "B": [8, 12, 13], "C": [20], "D": [15, 15, 16],
              "E": [10, 11, 18], "F": [19, 20], "G": [12]}
SCHEMA = "ams_id long, asset_id string, cmh_id long, source_system_id long, device_type string, date date"


def _log(spark, days_by_key):
    data = [(1, k, 1, 1, "LMP", OCT(d)) for k, days in days_by_key.items() for d in days]
    return spark.createDataFrame(data, SCHEMA)


def _pairs(df):
    return rows(df, "asset_id", "start_date", "close_date")


def test_build_cases_truth_table(spark):
    got = _pairs(build_cases(_log(spark, TRUTH_DAYS), AS_OF, dedupe=False))
    want = [("A", OCT(8), OCT(10)), ("B", OCT(8), OCT(8)), ("B", OCT(12), OCT(13)),
            ("C", OCT(20), None), ("D", OCT(15), OCT(16)), ("D", OCT(15), None),
            ("E", OCT(10), OCT(11)), ("E", OCT(18), OCT(18)), ("F", OCT(19), None),
            ("G", OCT(12), OCT(12))]
    assert got == srt(want)


def test_build_cases_legacy_truth_table(spark):
    got = _pairs(build_cases_legacy(_log(spark, TRUTH_DAYS), AS_OF, dedupe=False))
    want = [("A", OCT(8), OCT(10)), ("B", OCT(8), None), ("B", OCT(12), OCT(13)),
            ("C", OCT(20), None), ("D", OCT(15), OCT(16)), ("D", OCT(15), None),
            ("E", OCT(8), OCT(18)), ("E", OCT(10), OCT(11)), ("E", OCT(18), None),
            ("F", OCT(19), None), ("G", OCT(12), None)]
    assert got == srt(want)


def test_dedupe_merges_repeated_day(spark):
    got = _pairs(build_cases(_log(spark, {"D": [15, 15, 16]}), AS_OF, dedupe=True,
                             first_day=OCT(8)))
    assert got == [("D", OCT(15), OCT(16))]


def test_flags(spark):
    f = flag_case_boundaries(_log(spark, {"E": [10, 11, 18]}), AS_OF, first_day=OCT(8))
    assert rows(f, "date", "opens", "closes", "rn") == [
        (OCT(10), True, False, 1), (OCT(11), False, True, 2), (OCT(18), True, True, 3)]


def test_first_day_of_log_always_opens(spark):
    # a repeated first day: both rows open (the global first-day rule), as does any repeat
    f = flag_case_boundaries(_log(spark, {"X": [8, 8, 9]}), AS_OF, first_day=OCT(8))
    assert [r.opens for r in f.orderBy("rn").collect()] == [True, True, False]


def _islands(days_by_key, as_of):
    out = []
    for k, days in days_by_key.items():
        ds = sorted(set(days))
        start = prev = ds[0]
        for d in ds[1:] + [None]:
            if d is None or d - prev > 1:
                out.append((k, OCT(start), None if OCT(prev) == as_of else OCT(prev)))
                if d is not None:
                    start = d
            prev = d if d is not None else prev
    return srt(out)


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(st.sampled_from("pqrstu"), st.lists(st.integers(1, 20), min_size=1,
                                                          max_size=12), min_size=1, max_size=4))
def test_build_cases_matches_islands(spark, days_by_key):
    got = _pairs(build_cases(_log(spark, days_by_key), AS_OF))
    assert got == _islands(days_by_key, AS_OF)


def test_fixture_anchor_counts(spark):
    for sf, (n, n_open, n_dup, n_legacy) in {SF_SMALL: (110, 7, 130, 130),
                                            SF_MID: (1059, 54, 1258, 1260)}.items():
        fx = Fixtures(spark, sf)
        c = build_cases(fx.issue_log, PARAMS.as_of)
        assert c.count() == n
        assert c.filter(F.col("close_date").isNull()).count() == n_open
        assert build_cases(fx.issue_log_dup, PARAMS.as_of, dedupe=False).count() == n_dup
        assert build_cases_legacy(fx.issue_log, PARAMS.as_of).count() == n_legacy


def _simulate(days_by_key, as_of, first_day, legacy=False):
    """Row-by-row model of the case rules over every log row (repeats included)."""
    out = set()
    for k, days in days_by_key.items():
        ds = sorted(days)
        n = len(ds)
        bounds = []
        for i, d in enumerate(ds):
            prev = ds[i - 1] if i else None
            nxt = ds[i + 1] if i + 1 < n else None
            opens = d == first_day or prev is None or d - prev != 1
            closes = (nxt is None and OCT(d) != as_of) or (nxt is not None and nxt - d > 1)
            if opens or closes:
                bounds.append((d if opens else None, d if closes else None))
        for j, (s, c) in enumerate(bounds):
            nxt_close = bounds[j + 1][1] if j + 1 < len(bounds) else None
            if legacy:
                close = nxt_close
                if s is None and close is None:
                    continue
                s = first_day if s is None else s
            else:
                if s is None:
                    continue
                close = c if c is not None else nxt_close
            out.add((k, OCT(s), None if close is None else OCT(close)))
    return srt(out)


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.sampled_from("pqrs"),
                       st.lists(st.tuples(st.integers(8, 20), st.integers(1, 7)), min_size=1,
                                max_size=6), min_size=1, max_size=3),
       st.booleans())
def test_repeated_rows_match_row_by_row_model(spark, spec, legacy):
    days = {k: [d for d, m in v for _ in range(m)] for k, v in spec.items()}
    first = min(d for v in days.values() for d in v)
    builder = build_cases_legacy if legacy else build_cases
    got = _pairs(builder(_log(spark, days), AS_OF, dedupe=False))
    assert got == _simulate(days, AS_OF, first, legacy)


def test_many_repeats_of_a_closing_day(spark):
    days = {"Z": [10] * 6 + [15], "Y": [12] * 5, "W": [9, 10, 10, 10, 10, 10, 11]}
    for legacy in (False, True):
        builder = build_cases_legacy if legacy else build_cases
        got = _pairs(builder(_log(spark, days), AS_OF, dedupe=False))
        assert got == _simulate(days, AS_OF, 9, legacy)


def test_deduped_cases_are_unique_with_attribute_variants(spark):
    data = [(a, "V", 1, 1, t, OCT(d)) for a, t in ((1, "LMP"), (2, "AMP"))
            for d in (9, 10, 10, 12)]
    log = spark.createDataFrame(data, SCHEMA)
    c = build_cases(log, AS_OF)
    assert c.count() == c.distinct().count() > 0


def test_case_counts_at_the_bench_scale(spark):
    c = build_cases(Fixtures(spark, "/root/testdata/sf0.1").issue_log, PARAMS.as_of)
    r = c.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("close_date").isNull().cast("int")).alias("o")).first()
    assert (r.n, r.o) == (10478, 517)


def test_hot_device_is_collapsed_before_the_window(spark):
    from fleetcases.operators.cases import CASE_ATTRS, _device_days
    hot = {"H": [d for d in (8, 9, 10, 14) for _ in range(300)]}     # 1200 rows, 4 days
    cold = {k: [8 + i % 5, 12] for i, k in enumerate("abcdefghijklmnopqrstuvwxyz")}
    days = {**hot, **cold}
    log = _log(spark, days)
    per_day = _device_days(log, AS_OF, "asset_id", "date", CASE_ATTRS, False).filter(F.col("asset_id") == "H")
    assert log.filter(F.col("asset_id") == "H").count() > log.count() / 3
    assert {(r["date"], r["n"]) for r in per_day.collect()} == {(OCT(d), 300) for d in (8, 9, 10, 14)}
    assert _pairs(build_cases(log, AS_OF, dedupe=False)) == _simulate(days, AS_OF, 8)
    assert build_cases(log, AS_OF).filter(F.col("asset_id") == "H").count() == 2


def test_one_answer_for_every_row_order(spark):
    # a device moved between accounts within a day: the day counts once, with the least account
    rows = [(1, "V", 7, 1, "LMP", OCT(15)), (1, "V", 8, 1, "LMP", OCT(15)), (1, "V", 7, 1, "LMP", OCT(16)),
            (2, "U", None, 2, "AMP", OCT(9)), (2, "U", 3, 2, "AMP", OCT(9)), (2, "U", 3, 2, "AMP", OCT(10))]
    want = {True: [(1, "V", 7, 1, "LMP", OCT(15), OCT(16)), (2, "U", None, 2, "AMP", OCT(9), OCT(10))]}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 3, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            for order in itertools.permutations(range(3)):
                some = [rows[i] for i in order] + [rows[3 + i] for i in order]
                log = spark.createDataFrame(some, SCHEMA).repartition(parts)
                for dedupe in (True, False):
                    for builder in (build_cases, build_cases_legacy):
                        got = srt(builder(log, AS_OF, dedupe=dedupe).collect())
                        assert got == want.setdefault((dedupe, builder), got)
                assert srt(build_cases(log, AS_OF).collect()) == want[True]
                flags = flag_case_boundaries(log, AS_OF).select("asset_id", "cmh_id", "date", "opens", "closes", "rn")
                assert srt(flags.collect()) == want.setdefault("flags", srt(flags.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_run_across_as_of(spark):
    # only a run whose last day is as_of stays open; a run reaching past it closes on its last day
    days = {"H": [19, 20, 21], "I": [18, 19], "J": [20]}
    got = _pairs(build_cases(_log(spark, days), AS_OF, first_day=OCT(8)))
    assert got == [("H", OCT(19), OCT(21)), ("I", OCT(18), OCT(19)), ("J", OCT(20), None)]
    assert got == _simulate(days, AS_OF, 8)
