"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from tempfile import mkdtemp

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from mortonlake.operators import batch, joins, search  # noqa: E402
from mortonlake.operators.index import PointIndex  # noqa: E402
from mortonlake.sources import points as src  # noqa: E402

LAT, LNG = -23.5505, -46.6333


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    bulk, dense, world, centers = (f(spark, sf_dir) for f in (src.bulk_points, src.dense_points, src.world_points, src.query_points))
    points = bulk.repartition(int(cpus)).persist()
    n = points.count()
    folder = mkdtemp()
    built = []

    def build() -> None:
        built.append(PointIndex.create(spark).add_batch(points).build(int(cpus)).save(f"{folder}/{len(built)}"))

    build()
    build_s = min(_timed(build) for _ in range(3))
    index = built[-1]
    encoded = PointIndex.create(spark).add_batch(world).build(int(cpus), persist=True)
    encoded.frame.count()
    dense_index = PointIndex.create(spark).add_batch(dense).build(int(cpus), persist=True)
    dense_index.frame.count()
    run = {
        "encode": lambda: batch.encode_batch(points).agg(F.max("z_ord")).collect(),
        "decode": lambda: batch.decode_batch(index.frame).agg(F.max("point.lat"), F.max("point.lng")).collect(),
        "haversine": lambda: batch.haversine_batch(points, LAT, LNG).agg(F.max("distance_km")).collect(),
        "fast_distance": lambda: batch.fast_distance_batch(points, LAT, LNG).agg(F.max("distance_km")).collect(),
        "filter_radius": lambda: batch.matches(batch.filter_radius(points, LAT, LNG, 2000.0)).collect(),
        "radius_50km": lambda: search.radius_search(index, LAT, LNG, 50.0).count(),
        "radius_1000km": lambda: search.radius_search(index, LAT, LNG, 1000.0).count(),
        "radius_dense_5km": lambda: search.radius_search(dense_index, LAT, LNG, 5.0).count(),
        "bbox": lambda: search.bbox_search(index, -56, 13, -82, -34).count(),
        "knn_10": lambda: search.knn_search(index, LAT, LNG, 10, 1000.0).collect(),
        "distance_join": lambda: joins.distance_join(centers, encoded, 1000.0).count(),
        "knn_join": lambda: joins.knn_join(centers, encoded, 5, 2000.0).count(),
        "radius_sweep": lambda: joins.radius_sweep(index, LAT, LNG, [100.0, 500.0, 1000.0, 2000.0, 5000.0]).collect(),
    }
    seconds = {"index_build": round(build_s, 4)}
    for name, f in run.items():
        f()
        best = min(_timed(f) for _ in range(3))
        seconds[name] = round(best, 4)
    rates = {k: round(n / seconds[k]) for k in ("encode", "decode", "haversine", "fast_distance", "filter_radius", "index_build")}
    pairs = run["distance_join"]()
    print(json.dumps({"metric": "total_time", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": float(sf_dir.rstrip("/").rpartition("sf")[2] or 0), "rows": n, "rows_per_second": rates, "join_pairs_per_second": round(pairs / seconds["distance_join"])}))
    spark.stop()


def _timed(f) -> float:
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


if __name__ == "__main__":
    main()
