"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (table folder), BENCH_CPUS (local cores), BENCH_ONLY (comma list of queries).
Each query runs once to warm up and then BENCH_RUNS times; the best time counts.
"""

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from pixelquarry.operators import kernels, pixels as px, stats  # noqa: E402
from pixelquarry.plans import views  # noqa: E402
from pixelquarry.plans.all_queries import REGISTRY  # noqa: E402
from pixelquarry.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))
COPIES = int(os.environ.get("BENCH_COPIES", "30"))

HEADLINE = [
    "hist_exact", "bw_points", "night_score", "catalog_sort", "position_of_n", "next_prev", "rename_template", "format_by_magic", "playlist_resolve",
    "param_lookup", "param_merge", "rule_resolve", "effective_params", "exif_extract", "px_rotate90", "px_apply_lut", "px_resize_hq", "px_gauss",
    "px_density_correct", "pixel_hash", "stream_hash", "duplicate_content", "strings_reconcile", "translation_progress",
]


def copies(px):
    """Every image COPIES times under a new id, so that pixel rates mean something."""
    px = px.repartition(int(CPUS) * 2, "image_id")
    return px.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).withColumn("image_id", F.expr(f"image_id * {COPIES} + _k")).drop("_k")


def big_hist(spark, d):
    return stats.hist_exact(copies(views.pixels(spark, d)))


def big_resize(spark, d):
    px = copies(views.pixels32(spark, d))
    images = spark.range(1).selectExpr("32 AS w", "32 AS h")
    return kernels.resize(px, "11", "14", "quality", 0.15, images=images)


def giant(spark, d, width=2000, height=1500):
    """One image of 2000x1500 from the vectors' values, beside the 32x32 ones."""
    rows = copies(views.pixels(spark, d)).selectExpr("image_id * 64 + y * 8 + x AS n", "b", "g", "r").filter(f"n < {width * height}")
    one = rows.selectExpr("-1L AS image_id", f"{width} AS w", f"{height} AS h", f"cast(n % {width} AS int) AS x", f"cast(n div {width} AS int) AS y", "b", "g", "r")
    small = views.pixels32(spark, d).select(*one.columns)
    return one.unionByName(small)


def giant_resize(spark, d):
    images = spark.sql("SELECT * FROM VALUES (2000, 1500), (32, 32) AS t(w, h)")
    return kernels.resize(giant(spark, d), "w div 4", "h div 4", "quality", 0.15, images=images)


def giant_rotated(spark, d):
    images = spark.sql("SELECT -1L AS image_id, 2000 AS w, 1500 AS h")
    return px.rotate_bicubic(giant(spark, d), images, "0.3D", "1500", "1500", (0, 0, 0), kernels.bicubic_phases())


EXTRA = {"giant_resize": giant_resize, "giant_rotated": giant_rotated, "hist_exact_many": big_hist, "px_resize_hq_many": big_resize}


def main():
    spark = build_session("bench", master=f"local[{CPUS}]", shuffle_partitions=int(CPUS) * 2)
    spark.sparkContext.setLogLevel("ERROR")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    todo = {n: REGISTRY.queries[n] for n in HEADLINE} | EXTRA
    times = {}
    spark.range(1000).selectExpr("sum(id)").collect()
    for name, query in todo.items():
        if only and name not in only:
            continue
        best = None
        for run in range(RUNS + 1):
            start = time.perf_counter()
            query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if run > 0:
                best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    scale = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(scale.group(1)) if scale else None, "cpus": int(CPUS), "copies": COPIES,
    }))
    spark.stop()


main()
