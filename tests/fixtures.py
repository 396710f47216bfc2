"""Hand-built source frames with the golden key 2910/10013700."""
from __future__ import annotations

import datetime as dt

from stockgrid.operators.aggregate import tag_sources

CO_SCHEMA = "Plant string, Material string, order_qty double, confirmed_qty double"
OH_SCHEMA = "Plant string, Material string, unrestricted double, quality double, blocked double, expiry timestamp_ntz"
OO_SCHEMA = ("Plant string, Material string, open_po_qty double, po_qty double, po_request_qty double, "
             "inbound_qty double, delivery_date timestamp_ntz")
TARGET_SCHEMA = "Plant string, Material string, Supplier string, TOL_Material string, Description string, Target_Stock double"


def d(s):
    return dt.datetime.fromisoformat(s)


def customer_orders(spark, rows=None):
    rows = rows or [("2910", "10013700", 10.0, 8.0), ("2910", "10013700", 5.0, 5.0),
                    ("2920", "10013700", 20.0, 15.0), ("2910", "10099999", 3.0, 3.0)]
    return spark.createDataFrame(rows, CO_SCHEMA)


def on_hand(spark, rows=None):
    rows = rows or [("2910", "10013700", 40.0, 2.0, 1.0, d("2026-12-01")),
                    ("2910", "10013700", 10.0, 0.0, 0.0, d("2026-06-01")),
                    ("2920", "10013700", 5.0, 0.0, 0.0, None)]
    return spark.createDataFrame(rows, OH_SCHEMA)


def open_orders(spark, rows=None):
    rows = rows or [("2910", "10013700", 12.0, 12.0, 10.0, 0.0, d("2026-09-01")),
                    ("2920", "10013700", 8.0, 8.0, 6.0, 2.0, d("2026-08-25"))]
    return spark.createDataFrame(rows, OO_SCHEMA)


def target(spark, rows=None):
    rows = rows or [("2910", "10013700", "Alimentias", "13700", "TEST PRODUCT", 50.0),
                    ("2920", "10013700", "Alimentias", "13700", "TEST PRODUCT", 30.0)]
    return spark.createDataFrame(rows, TARGET_SCHEMA)


def tagged(spark, co=None, oh=None, oo=None):
    return tag_sources(co if co is not None else customer_orders(spark),
                       oh if oh is not None else on_hand(spark),
                       oo if oo is not None else open_orders(spark))


def row(df, plant, material):
    from pyspark.sql import functions as F
    cond = F.col("Plant").eqNullSafe(plant) & F.col("Material").eqNullSafe(material)
    rows = df.filter(cond).collect()
    assert len(rows) == 1, rows
    return rows[0]
