"""Scaling run: the cleaning pipeline on k unioned copies of orders (keys shifted).

Usage: python tools/scale_bench.py [sf_dir] [k ...]   prints one JSON line per k.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from scrubspark.catalog import fixtures as fx  # noqa: E402
from scrubspark.catalog import specs  # noqa: E402
from scrubspark.catalog.queries import CLEAN_PLAN  # noqa: E402
from scrubspark.operators import clip, dedup, fill  # noqa: E402
from scrubspark.operators import grade as grading  # noqa: E402
from scrubspark.operators import profile as profiling  # noqa: E402
from scrubspark.plans.clean import clean  # noqa: E402
from scrubspark.session import get_spark  # noqa: E402
from scrubspark.sources.tables import read_table, spread_small_scan  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    ks = [int(x) for x in sys.argv[2:]] or [1, 2, 4]
    spark = get_spark(shuffle_partitions=16)
    base = read_table(spark, sf_dir, "orders", spread=False)
    span = base.agg(F.max("o_orderkey")).first()[0] + 1
    for k in ks:
        parts = [base.withColumn("o_orderkey", F.col("o_orderkey") + F.lit(i * span)) for i in range(k)]
        orders = parts[0]
        for p in parts[1:]:
            orders = orders.unionByName(p)
        d = fx.dirty_orders(spark, sf_dir, spread_small_scan(orders))
        out = {}

        def t(name, fn):
            t0 = time.perf_counter()
            fn()
            out[name] = round(time.perf_counter() - t0, 3)

        def sink(df):
            df.write.format("noop").mode("overwrite").save()

        t("profile", lambda: profiling.profile(d).collect())
        t("dedup", lambda: sink(dedup.remove_duplicates(d)))
        t("fill_median", lambda: sink(fill.fill_nulls(d, "o_totalprice", "median")))
        t("clip_iqr", lambda: sink(clip.clip_outliers(d, "o_totalprice", "iqr")))
        t("grade", lambda: grading.grade(d, specs.ORDERS_SPEC).collect())
        t("full_clean", lambda: sink(clean(d, CLEAN_PLAN, specs.ORDERS_SPEC)[0]))
        rows = d.count()
        print(json.dumps({"copies": k, "rows": rows, "sec": out, "total": round(sum(out.values()), 3)}))


if __name__ == "__main__":
    main()
