"""State by buckets of users: few keys, the same totals."""

from __future__ import annotations

import datetime as dt

from weftline.sources.folders import shared_folder
from weftline.streaming import events as ev


def test_many_users_are_few_keys_of_state(spark, monkeypatch):
    monkeypatch.setattr(ev, "BUCKETS", 2)
    day = dt.datetime(2024, 1, 1)
    rows = [(k, day + dt.timedelta(minutes=k), None if k % 11 == 0 else k % 11, "view", float(k)) for k in range(88)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    state = shared_folder(spark, "stream-state")
    with ev.rocks_state(spark):
        ev.run_updating(ev.transformed_totals(ev.event_batches(spark, [df.where("event_id < 40"), df.where("event_id >= 40")])), "update", state)
        held = ev.state_table(spark, state, "totals")
        assert held.count() <= 3
        got = {tuple(r) for r in ev.held_totals(held).collect()}
    assert got == {(u or None, 8, 77.0 + u) for u in range(11)}
