from __future__ import annotations

import datetime
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from holdfast.operators import throttle
from holdfast.operators.throttle import throttle_batch
from holdfast.streaming.throttle import open_log, replay

WINDOW, QUOTA = 1_000_000, 3
EPOCH = datetime.datetime(2024, 1, 1)


def log_frame(spark, hits):
    """hits: (event_id, key, microseconds)."""
    rows = [(e, EPOCH + datetime.timedelta(microseconds=int(us)), k) for e, k, us in hits]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long")


def by_hand(hits):
    state, out = {}, {}
    for event, key, us in sorted(hits, key=lambda h: (h[2], h[0])):
        opened, count = state.get(key, (None, 0))
        if opened is None or us > opened + WINDOW:
            opened, count = us, 0
        if count < QUOTA:
            state[key], out[event] = (opened, count + 1), (True, None)
        else:
            state[key], out[event] = (opened, count), (False, -(-(opened + WINDOW - us) // 1_000_000))
    return out


def decided(df):
    return {r.event_id: (r.accepted, r.retry_after) for r in df.collect()}


def random_hits(n=4000, keys=40):
    rng = np.random.default_rng(3)
    owner = np.where(rng.random(n) < 0.4, 0, rng.integers(1, keys, n))  # one hot key
    at = rng.integers(0, 20_000_000, n)
    at[: n // 20] = at[n // 20 : n // 10]  # equal times
    return [(i, int(k), int(us)) for i, (k, us) in enumerate(zip(owner, at))]


def test_window_edges(spark):
    hits = [(1, 7, 0), (2, 7, 10), (3, 7, 20), (4, 7, 30), (5, 7, WINDOW), (6, 7, WINDOW + 1)]
    found = decided(throttle_batch(log_frame(spark, hits), WINDOW, QUOTA))
    assert found[4] == (False, 1)
    # The closing instant belongs to the old window; one microsecond later opens a new one.
    assert found[5] == (False, 0)
    assert found[6] == (True, None)


@pytest.mark.parametrize("partitions", [1, 8, 40])
def test_batch_equals_a_sequential_scan(spark, partitions):
    hits = random_hits()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that keys span ranges
    try:
        found = decided(throttle_batch(log_frame(spark, hits).repartition(7), WINDOW, QUOTA))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == by_hand(hits)


def test_a_keyless_hot_key_over_many_windows(spark, monkeypatch):
    # 15 a minute over 30 days: the longest chain decides the number of tables written, not the number of windows.
    minute = 60_000_000
    rng = np.random.default_rng(5)
    hot = np.sort(rng.integers(0, 30 * 1440 * minute, 120_000))
    burst = 7_000_000_000 + np.arange(400) * 100_000
    made = pd.DataFrame({"at": np.concatenate([hot, burst, hot[:500]])})
    made["event_id"] = np.arange(len(made))
    made["user_id"] = [-9] * 120_400 + [3] * 500
    events = spark.createDataFrame(made).selectExpr("event_id", "timestamp_micros(at) AS ts", "nullif(user_id, -9) AS user_id")
    written = []
    known = throttle.publish
    monkeypatch.setattr(throttle, "publish", lambda df, name, *rest: written.append(name) or known(df, name, *rest))
    found = throttle_batch(events).orderBy("event_id").toPandas()
    assert len(written) < 24
    state, accepted = {}, np.zeros(len(made), bool)
    for row in made.sort_values(["at", "event_id"]).itertuples():
        opened, count = state.get(row.user_id, (None, 0))
        if opened is None or row.at > opened + minute:
            opened, count = row.at, 0
        accepted[row.event_id] = count < throttle.QUOTA
        state[row.user_id] = (opened, count + 1)
    assert list(found.accepted) == list(accepted) and not accepted.all()


def test_text_keys_and_addresses(spark):
    rows = [("1.2.3.4, 9.9.9.9", "5.5.5.5"), (" 1.2.3.4", None), ("", "7.7.7.7"), (None, "7.7.7.7"), (None, None), (" ,x", "")]
    events = spark.createDataFrame([(i, EPOCH, *r) for i, r in enumerate(rows)], "event_id long, ts timestamp_ntz, forwarded string, address string")
    keyed = events.withColumn("client", throttle.client_key(F.col("forwarded"), F.col("address")))
    assert [r.client for r in keyed.orderBy("event_id").collect()] == ["1.2.3.4"] * 2 + ["7.7.7.7"] * 2 + ["unknown"] * 2
    out = {r.event_id: r for r in throttle_batch(keyed.withColumn("client", F.nullif("client", F.lit("unknown"))), WINDOW, 1, "client").collect()}
    assert {e: r.accepted for e, r in out.items()} == {0: True, 1: False, 2: True, 3: False, 4: True, 5: False}
    assert out[4].client == "unknown" and {r.accepted for r in throttle_batch(keyed, WINDOW, 0, "client").collect()} == {False}
    assert throttle_batch(keyed.limit(0), WINDOW, 1, "client").count() == 0


def test_zoned_and_missing_keys(spark):
    df = log_frame(spark, [(1, 7, 0), (2, 7, 5)]).selectExpr("event_id", "cast(ts as timestamp) ts", "user_id")
    nobody = df.selectExpr("event_id + 10 as event_id", "ts", "cast(null as long) as user_id")
    timeless = df.selectExpr("event_id + 20 as event_id", "cast(null as timestamp) as ts", "user_id")
    found = decided(throttle_batch(df.union(nobody).union(timeless), WINDOW, 1))
    assert {e: a for e, (a, _) in found.items()} == {1: True, 2: False, 11: True, 12: False, 21: True, 22: False}


def test_stream_in_several_batches_equals_batch(spark, tmp_path):
    hits = sorted(random_hits(1500, 20), key=lambda h: (h[2], h[0]))
    folder = str(tmp_path / "log")
    for part in np.array_split(np.arange(len(hits)), 4):
        log_frame(spark, [hits[i] for i in part]).coalesce(1).write.mode("append").parquet(folder)
    result = replay(open_log(spark, folder, bytes_per_trigger=1), WINDOW, QUOTA)
    assert decided(result) == by_hand(hits)
    assert result.where("late").count() == 0


def test_late_rows_are_kept_and_flagged(spark, tmp_path):
    folder = str(tmp_path / "log")
    log_frame(spark, [(1, 1, 5_000_000)]).coalesce(1).write.parquet(folder)
    log_frame(spark, [(2, 1, 10)]).coalesce(1).write.mode("append").parquet(folder)
    rows = {r.event_id: r for r in replay(open_log(spark, folder, bytes_per_trigger=1), WINDOW, QUOTA).collect()}
    assert len(rows) == 2 and rows[1].late is False and rows[2].late is True and rows[2].accepted


def test_state_goes_behind_the_watermark(spark, tmp_path):
    # Forty keys, then one a hundred windows later: only that one's state is left.
    folder = str(tmp_path / "log")
    early = [(i, i % 40, 1000 * i) for i in range(200)]
    for part in (early, [(500, 99, 100 * WINDOW)], [(501, 99, 100 * WINDOW + 5), (502, 7, 100 * WINDOW + 6)]):
        log_frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
    progress: list = []
    hits = [*early, (500, 99, 100 * WINDOW), (501, 99, 100 * WINDOW + 5), (502, 7, 100 * WINDOW + 6)]
    found = replay(open_log(spark, folder, bytes_per_trigger=1), WINDOW, QUOTA, slack_us=WINDOW, progress_of=progress)
    assert decided(found) == by_hand(hits)
    held = [p.stateOperators[0].numRowsTotal for p in progress]
    assert max(held) > 40 and held[-1] < 10


def test_a_range_has_no_more_rows_when_the_log_grows(spark, monkeypatch):
    hits, written = random_hits(12_000), {}

    def publish(df, name, own=throttle.publish):
        written.setdefault(name, own(df, name))
        return own(df, name) if name != "throttle-ranges" else written[name]

    monkeypatch.setattr(throttle, "publish", publish)
    monkeypatch.setattr(throttle, "RANGE_ROWS", 500, raising=False)
    found = decided(throttle_batch(log_frame(spark, hits).repartition(7), WINDOW, QUOTA))
    assert found == by_hand(hits)
    assert written["throttle-ranges"].groupBy("_range").count().agg(F.max("count")).first()[0] < 1_500


def test_parts_of_the_hops_follow_their_number(spark, monkeypatch):
    # Adaptive execution would put parts together by their compressed bytes; parts of a given number stay.
    hits = random_hits()
    monkeypatch.setattr(throttle, "RANGE_ROWS", 100)
    rounds = []

    def publish(df, name, own=throttle.publish):
        written = own(df, name)
        if name == "throttle-hops":
            given = re.findall(r"RepartitionByExpression \[.*\], (\d+)", df._jdf.queryExecution().optimizedPlan().toString())
            rounds.append((written.where("next IS NOT NULL").count(), [int(n) for n in given]))
        return written

    monkeypatch.setattr(throttle, "publish", publish)
    found = decided(throttle_batch(log_frame(spark, hits), WINDOW, QUOTA))
    assert found == by_hand(hits)
    assert len(rounds) > 2
    for (hops, _), (_, given) in zip(rounds, rounds[1:]):
        assert given and all(n == -(-hops // 100) for n in given)
