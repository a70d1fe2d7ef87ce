"""The sliding percentiles against brute force."""

import math
import random
from datetime import datetime, timedelta

import pytest

from gaugewatch.config import OutlierRule, RunGrid
from gaugewatch.operators import trailing
from gaugewatch.operators.outlier import outlier
from gaugewatch.operators.runs import tag_runs
from gaugewatch.operators.trailing import fenced_history_percentiles

START = datetime(2024, 1, 1)


def nearest(values, share):
    return sorted(values)[max(1, math.ceil(share * len(values))) - 1]


def brute(rows, grid, lookback, history):
    out = {}
    for tag in {row[0] for row in rows}:
        for run in range(1, grid.count + 1):
            end = run * grid.step_minutes - lookback
            seen = [v for t, m, v in rows if t == tag and end - history <= m < end]
            if not seen:
                continue
            q1, q3 = nearest(seen, 0.25), nearest(seen, 0.75)
            low, high = q1 - (q3 - q1) * 1.5, q3 + (q3 - q1) * 1.5
            kept = [v for v in seen if low <= v <= high]
            out[tag, run] = (len(seen), q1, q3, nearest(kept, 0.01), nearest(kept, 0.99))
    return out


def found(spark, frame, tags, grid, lookback, history, **options):
    made = fenced_history_percentiles(
        frame, tag_runs(spark, tags, grid), grid, lookback, timedelta(minutes=history), **options
    )
    return {
        (r.tag_name, r.run_no): (r.history_count, r.history_q1, r.history_q3, r.history_p1, r.history_p99)
        for r in made.collect()
    }


def readings(seed, n=900):
    """Ties, a hot value, a hot tag, negatives, extremes and a tag with one reading."""
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        minute = draw.uniform(-600, 900)
        tag = "hot" if draw.random() < 0.6 else "cold"
        kind = draw.random()
        if kind < 0.35:
            value = 7.0
        elif kind < 0.4:
            value = draw.choice([-1e6, 1e6])
        else:
            value = round(draw.gauss(0, 20), 1)
        rows.append((tag, minute, value))
    return rows + [("single", 30.0, 5.0)]


@pytest.mark.parametrize(
    "fanout,levels,step,lookback,history",
    [(4, 1, 60, 60, 300), (2, 3, 60, 60, 300), (8, 2, 60, 90, 240), (16, 1, 30, 60, 150)],
)
def test_matches_brute_force(spark, long_frame, fanout, levels, step, lookback, history):
    rows = readings(fanout * 10 + levels)
    grid = RunGrid(START, 12, step)
    got = found(
        spark, long_frame(rows), ["hot", "cold", "single"], grid, lookback, history, fanout=fanout, levels=levels
    )
    assert got == brute(rows, grid, lookback, history)


def test_levels_follow_from_the_data(spark, long_frame, monkeypatch):
    monkeypatch.setattr(trailing, "PAIRS_PER_COUNT", 0)
    chosen = []
    needed = trailing._levels_needed
    monkeypatch.setattr(trailing, "_levels_needed", lambda top: chosen.append(needed(top)) or chosen[-1])
    rows = readings(77)
    grid = RunGrid(START, 48, 15)
    assert found(spark, long_frame(rows), ["hot", "cold"], grid, 15, 600, fanout=4) == {
        key: value for key, value in brute(rows, grid, 15, 600).items() if key[0] != "single"
    }
    assert chosen == [3]


def test_fanout_must_be_a_power_of_two(spark, long_frame):
    grid = RunGrid(START, 1)
    with pytest.raises(ValueError):
        found(spark, long_frame([("a", 0, 1.0)]), ["a"], grid, 60, 60, fanout=6)


def test_grid_agrees_with_single_runs(spark, long_frame):
    """A backfill hour and the single-run path reach the same verdict."""
    rows = readings(5, 400)
    frame = long_frame(rows)
    rule = OutlierRule(60, 1, 1.5)
    many = outlier(frame, ["hot", "cold", "gone"], RunGrid(START, 6), rule, "s", "t", fanout=4)
    columns = ["run_id", "tag_name", "status", "history_p1", "history_p99", "recent_min", "recent_max"]
    batch = {(r.run_id, r.tag_name): r for r in many.select(columns).collect()}
    for hour in (1, 4, 6):
        single = outlier(
            frame, ["hot", "cold", "gone"], RunGrid.single(START + timedelta(hours=hour)), rule, "s", "t"
        )
        for row in single.select(columns).collect():
            assert row == batch[row.run_id, row.tag_name]


def test_slices_make_few_pairs_that_are_not_kept(spark, long_frame, monkeypatch):
    """A run meets at most twice the folded readings of its history, however long the table."""
    made, meet = [], trailing.meet_in_slices

    def counting(readings, requests, history):
        pairs = meet(readings, requests, history)
        inside = (pairs["cell"] >= history.start(pairs["run_no"])) & (pairs["cell"] < history.end(pairs["run_no"]))
        made.append((pairs.count(), pairs.filter(pairs["cell"].isNull() | inside).count()))
        return pairs

    monkeypatch.setattr(trailing, "meet_in_slices", counting)
    draw = random.Random(2)
    # Two weeks of readings against histories of eight hours.
    rows = [("hot", draw.uniform(-600, 20_000), draw.gauss(0, 5)) for _ in range(4000)]
    grid = RunGrid(START, 300, 60)
    assert found(spark, long_frame(rows), ["hot"], grid, 60, 480, fanout=4, levels=1)
    assert len(made) == 3
    for pairs, kept in made:
        assert kept <= pairs <= 2 * kept
