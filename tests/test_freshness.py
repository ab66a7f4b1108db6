"""The freshness processor without a stream: phases of packed occurrences."""

import numpy as np
import pytest

from tidemark.streaming import freshness as S

HOUR = 3_600_000_000


@pytest.fixture()
def sensor():
    return S.FreshnessProcessor(HOUR, 10 * HOUR)


def batch(*rows):
    """Rows (job, logical hour, is_finish, at hour); a job of None is NULL."""
    keys = np.array([(j or 0, j is None, h * HOUR) for j, h, _, _ in rows], [(c, S.ROW[c]) for c in S.KEY])
    return keys, np.array([f for _, _, f, _ in rows], bool), np.array([int(a * HOUR) for *_, a in rows], np.int64)


def told(frames):
    return sorted((int(r.job), bool(r.nojob), r.logical // HOUR, r.report, r["at"] / HOUR) for f in frames for _, r in f.iterrows())


def test_a_slice_holds_many_occurrences_with_one_timer(sensor):
    start = np.empty(0, S.ROW)
    rows, found = sensor.apply(start, *batch((1, 0, False, 0), (2, 0, False, 0), (3, 0, False, 0), (None, 0, False, 0), (4, 0, False, 0), (4, 0, True, 0.5)))
    assert len(rows) == 5 and not found and rows["timer"].min() == 3_600_001
    rows, found = sensor.apply(rows, *batch((2, 0, True, 0.9), (3, 0, True, 5), (1, 0, False, 0)))
    assert told(found) == [(3, False, 0, "BREACH", 1.0), (3, False, 0, "LATE_FINISH", 5.0)]
    rows, found = sensor.expire(rows, 3_600_000)
    assert len(rows) == 5 and not found
    rows, found = sensor.expire(rows, 3_600_001)
    assert told(found) == [(0, True, 0, "BREACH", 1.0), (1, False, 0, "BREACH", 1.0)]
    rows, found = sensor.apply(rows, *batch((1, 0, True, 6), (3, 0, True, 7), (2, 0, True, 6)))
    assert told(found) == [(1, False, 0, "LATE_FINISH", 6.0)]
    rows, found = sensor.expire(rows, 17 * 3_600_000)
    assert not len(rows) and not found


def test_a_finish_before_its_occurrence_waits_for_it(sensor):
    rows, found = sensor.apply(np.empty(0, S.ROW), *batch((1, 2, True, 0.5), (2, 2, True, 8)))
    assert not found and set(rows["phase"]) == {S.EARLY}
    rows, found = sensor.apply(rows, *batch((1, 2, False, 2), (2, 2, False, 2)))
    assert told(found) == [(2, False, 2, "BREACH", 3.0), (2, False, 2, "LATE_FINISH", 8.0)]
    assert set(rows["phase"]) == {S.DONE}
