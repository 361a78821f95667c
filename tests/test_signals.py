"""O5 window edges: D3 (heartbeat timestamp vs start date), D4 (first-day cut-offs)."""

import datetime as dt

from conftest import rows
from fleetcases.operators.signals import missing_signal_days

D = lambda m, d: dt.date(2020, m, d)
T = lambda m, d, h=0, mi=0, s=0, us=0: dt.datetime(2020, m, d, h, mi, s, us)
FIRST = D(10, 1)

CASES = [  # asset_tag, source_system_id, start_date, close_date, case_duration, client_id
    ("T1", 100, D(10, 20), None, 11, 7),
    ("T2", 200, D(10, 20), None, 11, 8),
    ("T3", 300, D(10, 20), D(10, 22), 3, 9),
    ("T4", 400, D(10, 3), D(10, 3), 1, 10),
    ("T5", 500, D(10, 20), None, 11, 11),
]
HEARTBEATS = [
    (7, T(10, 14)),              # exactly midnight of start-6: not after it, out
    (7, T(10, 15, 10)), (7, T(10, 19, 23, 59)),
    (7, T(10, 20)),              # the start itself: out
    (8, T(10, 14, 0, 0, 0, 1)),  # just after midnight of start-6: in (D3)
    (8, T(10, 15, 1)), (8, T(10, 16, 1)), (8, T(10, 17, 1)), (8, T(10, 18, 1)), (8, T(10, 19, 1)),
    (10, T(10, 1, 10)),          # on the log's first day: in
    (10, T(9, 30, 10)),          # before the log's first day: ignored (D4)
]
POLLS = [
    (300, T(10, 14, 12)),        # day start-6: out for polls (compared by day)
    (300, T(10, 15, 12)), (300, T(10, 16, 12)), (300, T(10, 16, 13)),
    (400, T(9, 30, 12)),         # counted only if T4 had no heartbeat day
]


def _run(spark, **kw):
    cases = spark.createDataFrame(CASES, "asset_tag string, source_system_id long, start_date date, "
                                         "close_date date, case_duration long, client_id long")
    hb = spark.createDataFrame(HEARTBEATS, "client_id long, created_at timestamp_ntz")
    pl = spark.createDataFrame(POLLS, "client_resource_id long, poll_last_utc timestamp_ntz")
    out = missing_signal_days(cases, hb, pl, FIRST, **kw)
    return dict((r[0], r[1]) for r in rows(out, "asset_tag", "days_with_no_heartbeat"))


def test_window_edges(spark):
    assert _run(spark) == {"T1": 3, "T2": -1, "T3": 3, "T4": 4, "T5": 5}


def test_strict_days(spark):
    got = _run(spark, strict_days=True)
    assert got["T2"] == 0 and got["T1"] == 3


def test_pruning_bound_does_not_change_result(spark):
    assert _run(spark, last_day=D(10, 20)) == _run(spark)


from hypothesis import given, settings, strategies as st  # noqa: E402


def _model(cases, hbs, polls, first, lookback=5):
    """The source's range conditions, row by row."""
    out = {}
    for tag, src, start, client in cases:
        lo = dt.datetime.combine(start - dt.timedelta(days=lookback + 1), dt.time())
        hi = dt.datetime.combine(start, dt.time())
        cut = dt.datetime.combine(first, dt.time())
        h = {t.date() for c, t in hbs if c == client and t >= cut and lo < t < hi}
        p = {t.date() for c, t in polls if c == src
             and t.date() >= first - dt.timedelta(days=lookback + 1)
             and start - dt.timedelta(days=lookback + 1) < t.date() < start}
        out[tag] = lookback - (len(p) if not h else len(h))
    return out


stamp = st.builds(lambda d, s: dt.datetime(2020, 10, 1) + dt.timedelta(days=d, seconds=s),
                  st.integers(0, 20), st.sampled_from([0, 1, 3600, 86399]))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), stamp), max_size=25),
       st.lists(st.tuples(st.integers(1, 3), stamp), max_size=25),
       st.lists(st.integers(3, 20), min_size=1, max_size=4, unique=True))
def test_random_signals_match_range_model(spark, hbs, polls, starts):
    first = D(10, 3)
    cases = [(f"T{i}", 1 + i % 3, D(10, s), 1 + (i + 1) % 3) for i, s in enumerate(starts)]
    cdf = spark.createDataFrame([(t, src, s, None, 1, c) for t, src, s, c in cases],
                                "asset_tag string, source_system_id long, start_date date, "
                                "close_date date, case_duration long, client_id long")
    hb = spark.createDataFrame(hbs or [(0, T(10, 1))], "client_id long, created_at timestamp_ntz")
    pl = spark.createDataFrame(polls or [(0, T(10, 1))],
                               "client_resource_id long, poll_last_utc timestamp_ntz")
    got = dict((r[0], r[1]) for r in rows(missing_signal_days(cdf, hb, pl, first),
                                          "asset_tag", "days_with_no_heartbeat"))
    assert got == _model(cases, hbs, polls, first)
