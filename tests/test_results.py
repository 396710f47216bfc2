"""Results addressed by their inputs: the same inputs compute nothing, any changed one does."""
from __future__ import annotations

import os

import pytest
from test_files import MASTER, write_uploads

from stockgrid import refresh as rf
from stockgrid.sources import results
from stockgrid.streaming.ingest import LOG_SCHEMA


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_unchanged_inputs_compute_nothing(spark, tmp_dir, monkeypatch):
    up, master, cache = (os.path.join(tmp_dir, x) for x in ("up", "master.csv", "cache"))
    os.makedirs(up)
    write_uploads(up)
    with open(master, "w") as fh:
        fh.write(MASTER)
    runs, compute = [], rf.compute

    def counted(*args):
        runs.append(1)
        return compute(*args)

    monkeypatch.setattr(rf, "compute", counted)

    def run(**how):
        return rf.refresh(spark, up, master, allow_invalid=True, cache=cache, **how)

    first = run()
    again = run()
    assert len(runs) == 1
    for name in ("grid", "variances", "report", "duplicates", "manifest", "plant_violations"):
        assert rows_of(first[name]) == rows_of(again[name])
    # overrides are applied to the stored result
    log = os.path.join(tmp_dir, "log")
    spark.createDataFrame([("2910", "10000", None, 1, 5.0, "note", 0)], LOG_SCHEMA).write.partitionBy("_batch").parquet(log)
    row = run(overrides=log)["grid"].where("Plant = '2910' and Material = '10000'").first()
    assert row.Manual_Override == 5.0 and len(runs) == 1
    # a file written again with the same bytes is the same input; one other byte is not
    path = os.path.join(up, "OH20.csv")
    with open(path, "rb") as fh:
        text = fh.read()
    with open(path, "wb") as fh:
        fh.write(text)
    run()
    assert len(runs) == 1
    with open(path, "wb") as fh:
        fh.write(text.replace(b",5,", b",6,", 1))
    changed = run()
    assert len(runs) == 2 and rows_of(changed["grid"]) != rows_of(first["grid"])
    with open(path, "wb") as fh:
        fh.write(text)
    run()
    assert len(runs) == 2                        # the first result is still there
    with open(master, "a") as fh:
        fh.write("S,2930,1,1,1,1,\n")
    run()
    assert len(runs) == 3
    monkeypatch.setattr(rf.config, "SAFETY_STOCK_PCT", 0.3)
    run()
    assert len(runs) == 4
    # an invalid folder that is not allowed has a key of its own and stores nothing
    with pytest.raises(rf.UploadsInvalid):
        rf.refresh(spark, up, master, cache=cache)
    assert len(os.listdir(os.path.join(cache, "entries"))) >= 4


def test_an_unfinished_result_does_not_count(spark, tmp_dir):
    cache = os.path.join(tmp_dir, "cache")
    key = results.key_of({"a": "1"}, {"x": [1, 2]})
    assert key != results.key_of({"a": "2"}, {"x": [1, 2]}) and key != results.key_of({"a": "1"}, {"x": [2, 1]})

    def torn(write):
        write(spark.range(2), "one")
        write(spark.range(3).selectExpr("raise_error('torn') as x"), "two")

    def whole(write):
        write(spark.range(2), "one")
        assert write(spark.range(4), "two").count() == 4
        return ["one", "two"]

    with pytest.raises(Exception, match="torn"):
        results.stored(spark, cache, key, torn)
    assert results.found(spark, cache, key) is None
    good = results.stored(spark, cache, key, whole)
    assert good["two"].count() == 4 and results.stored(spark, cache, key, lambda write: 1 / 0)["one"].count() == 2
