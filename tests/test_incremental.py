"""The grid merged from stored states, and compaction: equal to a rebuild after replays, withdrawn files and new versions."""
from __future__ import annotations

import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from stockgrid import config
from stockgrid.operators import incremental as inc
from stockgrid.operators.aggregate import tag_sources
from stockgrid.operators.grid import ordering_grid
from stockgrid.sources import snapshots
from stockgrid.streaming import ingest
from fixtures import OH_SCHEMA, CO_SCHEMA, OO_SCHEMA, target

SCHEMA = {"on_hand": OH_SCHEMA, "customer_orders": CO_SCHEMA, "open_orders": OO_SCHEMA}


def day(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=n)


def some_rows(kind, seed, n=40):
    out = []
    for i in range(n):
        plant = [None, "2910", "2920", "2930"][(seed + i) % 4]
        material = None if i % 13 == 0 else f"100{(seed * 7 + i) % 25}"
        q = [0.1 * i, None, float(i), 2.0 ** 61 + i, -1.5][(i + seed) % 5]
        if kind == "on_hand":
            out.append((plant, material, q, 1.0, None, day((i * 7 + seed) % 50) if i % 3 else None))
        elif kind == "customer_orders":
            out.append((plant, material, q, 0.25))
        else:
            out.append((plant, material, q, 4.0, 2.0, None, day((i + seed) % 30)))
    return out


class Feed:
    """Files by kind and batch, stored as states and kept as rows for the rebuild."""

    def __init__(self, spark, path):
        self.spark, self.path, self.rows = spark, path, {}

    def put(self, kind, batch, files, again=1):
        df = None
        for name, seed in files.items():
            part = self.spark.createDataFrame(some_rows(kind, seed), SCHEMA[kind]).withColumn("_source_file", F.lit(name))
            self.rows[kind, batch, name] = part
            df = part if df is None else df.unionByName(part)
        for _ in range(again):
            inc.write_states(df, kind, batch, self.path)

    def withdraw(self, kind, name, through):
        inc.withdraw(self.spark, self.path, kind, name, through)
        self.rows = {k: v for k, v in self.rows.items() if not (k[0] == kind and k[2] == name and k[1] <= through)}

    def rebuild(self):
        by_kind = {}
        for (kind, _, _), df in self.rows.items():
            df = df.drop("_source_file")
            by_kind[kind] = by_kind[kind].unionByName(df) if kind in by_kind else df
        return ordering_grid(tag_sources(by_kind.get("customer_orders"), by_kind.get("on_hand"), by_kind.get("open_orders")),
                             target(self.spark))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def check(feed):
    assert rows_of(inc.incremental_grid(feed.spark, feed.path, target(feed.spark))) == rows_of(feed.rebuild())


def test_states_equal_a_rebuild(spark, tmp_dir):
    feed = Feed(spark, os.path.join(tmp_dir, "states"))
    feed.put("on_hand", 0, {"a.csv": 1, "b.csv": 2}, again=2)       # a replayed batch counts once
    feed.put("customer_orders", 0, {"a.csv": 3})
    check(feed)
    feed.put("open_orders", 0, {"o.csv": 4})
    feed.put("on_hand", 1, {"c.csv": 5})
    feed.withdraw("on_hand", "a.csv", 0)                             # its earliest dates go too
    check(feed)
    feed.put("on_hand", 2, {"a.csv": 6})                             # the same name again, later
    check(feed)
    assert inc.compact_states(spark, feed.path) == 1 and inc.compact_states(spark, feed.path) == 0
    check(feed)
    feed.put("on_hand", 1, {"c.csv": 5}, again=2)                    # replay of a batch that the snapshot holds
    feed.put("customer_orders", 1, {"d.csv": 8})
    feed.withdraw("on_hand", "b.csv", 2)
    check(feed)
    assert inc.compact_states(spark, feed.path) == 2
    check(feed)
    assert snapshots.expired(spark, feed.path) == [feed.path + "_snapshots/version=1"]


def test_update_replaces_only_buckets_of_changed_keys(spark, tmp_dir):
    feed, grid_path = Feed(spark, os.path.join(tmp_dir, "states")), os.path.join(tmp_dir, "grid")
    feed.put("on_hand", 0, {f"f{i}.csv": i for i in range(4)})
    feed.put("open_orders", 0, {"o.csv": 9})
    inc.write_grid(inc.incremental_grid(spark, feed.path, target(spark)), grid_path)

    def stored():
        return inc.read_grid(spark, grid_path, feed.rebuild()).drop("bucket")

    def files():
        return {f for f in glob.glob(f"{grid_path}/bucket=*/*.parquet")}

    assert rows_of(stored()) == rows_of(feed.rebuild())
    before = files()
    one = spark.createDataFrame([("2910", "10013700", 40.0, 2.0, 1.0, day(3)), ("2910", "new", 1.0, None, None, None)], OH_SCHEMA)
    one = one.withColumn("_source_file", F.lit("one.csv"))
    feed.rows["on_hand", 1, "one.csv"] = one
    inc.write_states(one, "on_hand", 1, feed.path)
    n = inc.update_grid(spark, feed.path, grid_path, target(spark), inc.changed_keys(spark, feed.path, "on_hand", [1]))
    assert 1 <= n <= 2 and rows_of(stored()) == rows_of(feed.rebuild())
    gone = {os.path.dirname(f) for f in before - files()}
    assert len(gone) <= 2 and len(before & files()) >= len(before) - 4
    changed = inc.changed_keys(spark, feed.path, "on_hand", files=["one.csv"])
    feed.withdraw("on_hand", "one.csv", 1)                           # the key "new" has no states any more
    inc.update_grid(spark, feed.path, grid_path, target(spark), changed)
    assert rows_of(stored()) == rows_of(feed.rebuild())
    assert inc.update_grid(spark, feed.path, grid_path, target(spark), changed.where("false")) == 0


def test_drop_folder_keeps_states(spark, tmp_dir):
    from test_files import write_uploads
    up, drop = os.path.join(tmp_dir, "up"), os.path.join(tmp_dir, "drop")
    os.makedirs(up)
    os.makedirs(drop)
    write_uploads(up)
    states = os.path.join(tmp_dir, "states")
    for n, name in enumerate(["OH2910.csv", "OH20.csv", "OH2930.csv"]):
        with open(os.path.join(up, name)) as src, open(os.path.join(drop, name), "w") as dst:
            dst.write(src.read())
        ingest.ingest_drop_folder(spark, drop, "on_hand", os.path.join(tmp_dir, "t"), os.path.join(tmp_dir, "ck"), states_path=states)
    rows = ingest.read_kind_table(spark, os.path.join(tmp_dir, "t"), "on_hand")
    assert rows_of(inc.incremental_grid(spark, states, target(spark))) == rows_of(ordering_grid(tag_sources(None, rows, None), target(spark)))
    assert spark.read.parquet(states).select("batch_id").distinct().count() == 3


def test_override_log_compaction(spark, tmp_dir):
    """Late and replayed events, compaction between batches: always the latest edit by (ts, event_id)."""
    from stockgrid.operators.overrides import latest_overrides
    src, log, ck = (os.path.join(tmp_dir, x) for x in ("src", "log", "ck"))
    events = []

    def send(rows):
        events.extend(rows)
        spark.createDataFrame(rows, ingest.OVERRIDE_EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        ingest.stream_overrides(spark, src, log, ck)

    def check_log():
        all_events = spark.createDataFrame(events, ingest.OVERRIDE_EVENT_SCHEMA)
        assert rows_of(ingest.latest_from_log(spark, log)) == rows_of(latest_overrides(all_events))

    send([(i, day(i), "2910", f"m{i % 5}", float(i), f"n{i}") for i in range(20)])
    assert ingest.compact_overrides(spark, log) == 1
    check_log()
    send([(100, day(2), "2910", "m4", -1.0, "late"), (101, day(60), "2910", "m1", 7.0, "new"), (102, day(1), None, "x", 3.0, None)])
    check_log()
    # the replay of a batch that the snapshot holds
    first = spark.read.schema(ingest.LOG_SCHEMA).parquet(log).where("_batch = 0")
    snapshots.write_batch(spark.createDataFrame(first.collect(), ingest.LOG_SCHEMA), log, ["_batch"])
    check_log()
    assert ingest.compact_overrides(spark, log) == 2 and ingest.compact_overrides(spark, log) == 0
    check_log()
    # a version without its pointer row does not count
    spark.createDataFrame([("2910", "m1", day(99), 999, 0.0, "torn", 9)], ingest.LOG_SCHEMA).write.parquet(log + "_snapshots/version=3")
    check_log()
    # read cost: keys of the snapshot and no batch before it
    plan = ingest.latest_from_log(spark, log)._jdf.queryExecution().executedPlan().toString()
    assert "version=2" in plan and spark.read.parquet(log + "_snapshots/version=2").count() == 6
    send([(200, day(90), "2910", "m2", 5.0, "after")])
    check_log()


def test_kinds_share_bucket_of_a_key(spark):
    df = spark.createDataFrame([("2910", "m"), (None, "m"), ("", "m"), ("2910", None)], "Plant string, Material string")
    got = df.select(inc.bucket_of().alias("b")).collect()
    assert all(0 <= r.b < inc.BUCKETS for r in got) and got[1] != got[2]
    assert set(inc.SUMS) == {*inc.ON_HAND_SUMS, *inc.CUSTOMER_ORDER_SUMS, *inc.open_order_sums()} and len(config.KINDS) == 3
