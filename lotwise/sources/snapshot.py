"""Result snapshots: the dashboard's six start-up results, kept per ``as_of``.

The dashboard keeps its six start-up query results in a 12-hour in-process
cache.  Here each result is written as parquet under
``<root>/<name>/as_of=<date>/version=<id>/``, and a manifest row that names the
version, its rows and its schema is appended last.  Only what the manifest names
is ever read: a failed job leaves files that no reader sees, a rerun for the same
day adds a version without touching the files that a reader has open, and a read
prunes to the partitions of one version.  A version is fresh for ``MAX_AGE``.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from lotwise.operators import activity, inventory, segmentation

# ---- fixed values: how long a result is served before it is computed again ----
MAX_AGE = dt.timedelta(seconds=43200)
# -------------------------------------------------------------------------------

SNAPSHOT_NAMES = ("live_inventory", "purchase_history", "dealer_segmentation", "dealer_activity",
                  "recent_views", "recent_filters")
PARTITIONS = ("as_of", "version")
MANIFEST = "manifest"
MANIFEST_SCHEMA = "as_of date, name string, version string, n_rows long, columns string, written_at timestamp"


def _files(spark: SparkSession, root: str, entry: Row) -> DataFrame:
    """The partitions of one manifest entry; the schema comes from the manifest, so empty results read too."""
    schema = T.StructType.fromJson(json.loads(entry["columns"]))
    for name, kind in zip(PARTITIONS, (T.DateType(), T.StringType())):
        schema = schema.add(name, kind)
    rows = spark.read.schema(schema).parquet(f"{root}/{entry['name']}")
    return (rows.where((F.col("as_of") == F.lit(entry["as_of"])) & (F.col("version") == F.lit(entry["version"])))
            .drop(*PARTITIONS))


def manifest(spark: SparkSession, root: str, as_of: dt.date | None = None) -> DataFrame:
    """The latest committed version of each result, per ``as_of`` (of one day, if given)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{MANIFEST}")
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/{MANIFEST}")
    if as_of is not None:
        rows = rows.where(F.col("as_of") == F.lit(as_of))
    latest = Window.partitionBy("as_of", "name").orderBy(F.col("written_at").desc(), "version")
    return rows.withColumn("r", F.row_number().over(latest)).where("r = 1").drop("r")


def write_snapshot(frames: dict[str, DataFrame], root: str, as_of: dt.date, now: dt.datetime) -> list[str]:
    """Write each frame as a new version and commit them together; returns the names."""
    if not frames:
        return []
    root, version = root.rstrip("/"), uuid.uuid4().hex
    entries = []
    for name, df in frames.items():
        spark = df.sparkSession
        (df.withColumns({"as_of": F.lit(as_of), "version": F.lit(version)})
         .write.mode("append").partitionBy(*PARTITIONS).parquet(f"{root}/{name}"))
        entry = Row(as_of=as_of, name=name, version=version, n_rows=0, columns=df.schema.json(), written_at=now)
        entries.append({**entry.asDict(), "n_rows": _files(spark, root, entry).count()})
    order = [f.split()[0] for f in MANIFEST_SCHEMA.split(", ")]
    (spark.createDataFrame([tuple(e[c] for c in order) for e in entries], MANIFEST_SCHEMA).coalesce(1)
     .write.mode("append").partitionBy("as_of").parquet(f"{root}/{MANIFEST}"))
    return list(frames)


def read_snapshot(spark: SparkSession, root: str, name: str, as_of: dt.date, now: dt.datetime | None = None,
                  max_age: dt.timedelta = MAX_AGE) -> DataFrame:
    """The latest version of one day's result, pruned to its partitions.

    ``LookupError`` if none is committed or, with ``now``, if it is older than
    ``max_age``.
    """
    root = root.rstrip("/")
    found = manifest(spark, root, as_of).where(F.col("name") == F.lit(name)).collect()
    if not found:
        raise LookupError(f"no snapshot of {name} for {as_of}")
    if now is not None and now - found[0]["written_at"] >= max_age:
        raise LookupError(f"the snapshot of {name} for {as_of} is older than {max_age}")
    return _files(spark, root, found[0])


def snapshot(frames: dict[str, DataFrame], root: str, as_of: dt.date, now: dt.datetime,
             max_age: dt.timedelta = MAX_AGE) -> dict[str, DataFrame]:
    """The frames as read back; those without a fresh version are computed and written first."""
    spark = next(iter(frames.values())).sparkSession
    root = root.rstrip("/")
    fresh = {r["name"] for r in manifest(spark, root, as_of).collect() if now - r["written_at"] < max_age}
    write_snapshot({name: df for name, df in frames.items() if name not in fresh}, root, as_of, now)
    return {name: read_snapshot(spark, root, name, as_of) for name in frames}


def dashboard_frames(tables, as_of: dt.date, events_as_of: dt.date | None = None
                     ) -> dict[str, DataFrame]:
    """The six start-up results from contract tables (an object with attributes)."""
    ev = events_as_of or as_of
    return {
        "live_inventory": inventory.live_inventory(tables.vehicle_history, tables.requests,
                                                   as_of),
        "purchase_history": inventory.purchase_history(tables.requests, tables.vehicle_history,
                                                       tables.car_status,
                                                       tables.publishing_logs),
        "dealer_segmentation": segmentation.dealer_segmentation(tables.requests, tables.dealers,
                                                                as_of, ordered=False),
        "dealer_activity": activity.dealer_activity(tables.dealers_activity, ev, ordered=False),
        "recent_views": activity.recent_views(tables.view_events, ev, ordered=False),
        "recent_filters": activity.recent_filters(tables.filter_events, ev, ordered=False),
    }
