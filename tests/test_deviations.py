"""Boundary days of the deviation operators against brute force."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from tallyworks.operators import deviations as op

ASOF = date(2026, 9, 30)
P = op.DeviationParams(asof=ASOF.isoformat())
DDL = "id string, opened date, area string, asset string, sev string, cause string, owner string, closed date, capa string, capa_closed date"


def record(i, opened, asset="m", cause="c", sev="Minor", closed=None, capa=None, capa_closed=None, area="A"):
    return (f"d{i}", opened, area, asset, sev, cause, "o", closed, capa, capa_closed)


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL)


def test_repeat_window(spark):
    first = date(2026, 1, 1)
    gaps = {"g0": 0, "g1": 1, "g180": 180, "g181": 181}
    rows = [record(0, first, asset=a) for a in gaps] + [
        (f"{a}-late", *record(1, first + timedelta(days=g), asset=a)[1:]) for a, g in gaps.items()]
    got = {r.id: r.repeat for r in op.with_repeat(frame(spark, rows), P).filter(F.col("id").endswith("late")).collect()}
    assert got == {"g0-late": False, "g1-late": True, "g180-late": True, "g181-late": False}


def test_effectiveness_edges(spark):
    close = date(2026, 1, 10)
    rows = []
    for offset in (0, 1, 180, 181):
        asset = f"a{offset}"
        rows.append((f"x{offset}", *record(0, close - timedelta(days=40), asset=asset, closed=close - timedelta(days=20), capa="C", capa_closed=close)[1:]))
        rows.append((f"y{offset}", *record(1, close + timedelta(days=offset), asset=asset)[1:]))
    for left in (179, 180):
        done = ASOF - timedelta(days=left)
        rows.append((f"z{left}", *record(2, done - timedelta(days=50), asset=f"z{left}", closed=done - timedelta(days=30), capa="C", capa_closed=done)[1:]))
    got = {r.id: r.effectiveness for r in op.with_effectiveness(frame(spark, rows), P).collect()}
    assert (got["x0"], got["x1"], got["x180"], got["x181"]) == ("Effective", "Ineffective", "Ineffective", "Effective")
    assert (got["z179"], got["z180"], got["y1"]) == ("Check pending", "Effective", None)


def test_capa_status_and_ages(spark):
    due_today = ASOF - timedelta(days=90)
    rows = [
        record(1, ASOF - timedelta(days=30)), record(2, ASOF - timedelta(days=31)), record(3, ASOF - timedelta(days=20)),
        record(4, ASOF - timedelta(days=21)), record(5, ASOF - timedelta(days=61), capa="C"), record(6, ASOF - timedelta(days=91)),
        record(7, due_today - timedelta(days=3), closed=due_today, capa="C"),
        record(8, due_today - timedelta(days=3), closed=due_today - timedelta(days=1), capa="C"),
        record(9, due_today, closed=due_today, capa="C", capa_closed=ASOF), record(10, due_today, closed=due_today, capa=""),
    ]
    got = {r.id: r for r in op.register(frame(spark, rows), P).collect()}
    assert [got[f"d{i}"].overdue for i in (1, 2)] == [False, True]
    assert [got[f"d{i}"].due_soon for i in (1, 2, 3, 4)] == [True, False, False, True]
    assert [got[f"d{i}"].aging_bucket for i in (1, 2, 5, 6, 7)] == ["0-30", "31-60", "61-90", "90+", None]
    assert [got[f"d{i}"].capa_status for i in (5, 7, 8, 9, 10)] == [
        "Awaiting dev. close", "Open", "Overdue", "Closed", "Not required"]


def test_trend_counts_records_before_the_spine(spark):
    rows = [record(1, date(2026, 3, 5)), record(2, date(2026, 5, 1), closed=date(2026, 7, 2)),
            record(3, date(2026, 7, 9), closed=date(2026, 11, 1))]
    got = [(r.month.month, r.opened, r.closed, r.median_days_to_close, r.open_at_month_end)
           for r in op.closeout_trend(frame(spark, rows), P, "2026-05-01").collect()]
    assert got == [(5, 1, 0, None, 2), (6, 0, 0, None, 2), (7, 1, 1, 62.0, 2), (8, 0, 0, None, 2), (9, 0, 0, None, 2)]


def test_hot_pair_equals_brute_force(spark):
    start = date(2025, 1, 1)
    days = [start + timedelta(days=(i * i) % 500) for i in range(300)]
    rows = [record(i, d, asset="hot" if i % 3 else f"m{i % 7}") for i, d in enumerate(days)]
    got = {r.id: r.repeat for r in op.with_repeat(frame(spark, rows), P).collect()}
    for r in rows:
        want = any(o[3] == r[3] and o[5] == r[5] and 0 < (r[1] - o[1]).days <= 180 for o in rows)
        assert got[r[0]] == want
    kpi = op.dev_kpis(frame(spark, rows), P).collect()[0]
    assert kpi.repeats == sum(got.values()) and kpi.effectiveness_rate == 0.0


def test_pairs_and_required_capa(spark):
    rows = [record(1, date(2026, 1, 1)), record(2, date(2026, 2, 1)), record(3, date(2026, 1, 1), asset="n"),
            record(4, date(2026, 1, 1), asset="n"), record(5, date(2026, 4, 1), asset="p", sev="Major")]
    pairs = op.repeat_pairs(frame(spark, rows), P).collect()
    assert [(r.asset, r.records, r.repeats, r.flag) for r in pairs] == [("m", 2, 1, "No CAPA yet")]
    assert {r.id for r in op.capa_required(frame(spark, rows), P).collect()} == {"d2", "d5"}
