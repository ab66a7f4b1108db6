"""Due times against a walk over every minute."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from tidemark.operators import history as H

UTC = dt.timezone.utc


def fits(field, value, lowest):
    for part in field.split(","):
        span, _, step = part.partition("/")
        low, _, top = span.partition("-")
        lo = lowest if span == "*" else int(low)
        hi = 99 if span == "*" else int(top) if top else lo
        if lo <= value <= hi and (value - lo) % int(step or 1) == 0:
            return True
    return False


def walked(cron, zone, start, end):
    m, h, dom, mon, dow = cron.split()
    at, out = start, []
    while at < end:
        x = at.replace(tzinfo=UTC).astimezone(ZoneInfo(zone))
        a, b = fits(dom, x.day, 1), fits(dow, x.isoweekday() % 7, 0)
        day = (a or b) if dom != "*" and dow != "*" else (a and b)
        if fits(m, x.minute, 0) and fits(h, x.hour, 0) and fits(mon, x.month, 1) and day:
            out.append(at)
        at += dt.timedelta(minutes=1)
    return out


CRONS = ["*/20 * * * *", "30 1,2 * * *", "15 0-4/2 * * 0", "0 3 10-12 3 1", "45 23 * 3,11 *"]


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "Asia/Seoul", "Asia/Kolkata", "Pacific/Apia"])
@pytest.mark.parametrize("start", [dt.datetime(2024, 3, 9, 0, 7), dt.datetime(2024, 3, 30), dt.datetime(2024, 11, 2), dt.datetime(2024, 10, 26), dt.datetime(2024, 4, 6)])
def test_cron_times_around_clock_changes(spark, zone, start):
    end = start + dt.timedelta(days=3, hours=5)
    jobs = spark.createDataFrame([(i, c, zone) for i, c in enumerate(CRONS)], "job_id INT, cron STRING, timezone STRING")
    got = {}
    for r in H.expand_cron(jobs, start, end).collect():
        got.setdefault(r.job_id, []).append(r.logical_at)
    for i, c in enumerate(CRONS):
        assert sorted(got.get(i, [])) == walked(c, zone, start, end)
    hourly = H.expand_schedule(spark.createDataFrame([(1, 6, zone)], "job_id INT, period_hours INT, timezone STRING"), start, end)
    assert sorted(r.logical_at for r in hourly.collect()) == walked("0 */6 * * *", zone, start, end)


def test_a_century_of_one_day_a_year(spark):
    jobs = spark.createDataFrame([(1, "0 0 1 1 *", "UTC"), (2, "0 0 1 1 *", "UTC")], "job_id INT, cron STRING, timezone STRING")
    assert H.expand_cron(jobs, dt.datetime(2000, 1, 1), dt.datetime(2100, 1, 1)).count() == 200
