"""Where documents live: Parquet and JSON folders under one root.

A catalogue stands for a document store. Tables are folders; what is stored is
identified by its content key, and rows whose key exists aren't written again. Large
fields can live in child tables of their own, bucketed by key like their parent
(``write_split``), so that reading a field back needs no shuffle and reading the rest doesn't touch it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import new_only

READERS = ("parquet", "json", "orc")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder of this machine stands in on a
    local master, where driver and executors are one; elsewhere it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = have.get() if have.isDefined() else None
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sparlattice-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@dataclass(frozen=True)
class Catalogue:
    root: str
    form: str = "parquet"

    def __post_init__(self):
        if self.form not in READERS:
            raise ValueError(f"unknown store format {self.form!r}; one of {', '.join(READERS)}")

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def exists(self, spark: SparkSession, name: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        """The table, or an empty one of the schema where nothing is stored yet."""
        if not self.exists(spark, name):
            return spark.createDataFrame([], schema)
        return spark.read.format(self.form).schema(schema).load(self.path(name))

    def append_new(self, df: DataFrame, name: str, key: Sequence[str], schema: str) -> None:
        """Append the rows whose key isn't stored, of each key the first as text."""
        rows = new_only(df, self.read(df.sparkSession, name, schema), key)
        rows.write.mode("append").format(self.form).save(self.path(name))

    def rewrite_without(self, df: DataFrame, name: str) -> str:
        """Write what a deletion leaves beside the table, and return that path: nothing is overwritten."""
        path = f"{self.path(name)}-{uuid.uuid4().hex}"
        df.write.format(self.form).save(path)
        return path


    # ---- large fields in child tables

    def write_split(self, df: DataFrame, name: str, key: str, large: Sequence[str], buckets: int | None = None) -> str:
        """Write ``df`` as a parent without the ``large`` fields and a child (key, field) for each.

        All are bucketed and sorted by ``key``, one file a bucket, in a folder
        of this version; a manifest row, written last, makes the version readable. Rows without the field
        have no row in its child. ValueError if a key is null or occurs twice.
        """
        spark = df.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        bad = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1))
        if not bad.isEmpty():
            raise ValueError(f"{key} is null or occurs twice")
        version = uuid.uuid4().hex
        parts = {"parent": df.drop(*large)} | {field: df.select(key, field).where(F.col(field).isNotNull()) for field in large}
        for part, rows in parts.items():
            table = _bucketed_name(version, part)
            rows.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{self.path(name)}/{version}/{part}").saveAsTable(table)
        number = self.read_manifest(spark, name).agg(F.coalesce(F.max("number"), F.lit(-1)).alias("n")).first()["n"] + 1
        entry = [(number, version, key, buckets, part, _columns(rows)) for part, rows in parts.items()]
        spark.createDataFrame(entry, MANIFEST).coalesce(1).write.mode("append").json(f"{self.path(name)}/manifest")
        return version

    def read_manifest(self, spark: SparkSession, name: str) -> DataFrame:
        if not self.exists(spark, f"{name}/manifest"):
            return spark.createDataFrame([], MANIFEST)
        return spark.read.schema(MANIFEST).json(f"{self.path(name)}/manifest")

    def read_split(self, spark: SparkSession, name: str, fields: Sequence[str] = ()) -> DataFrame:
        """The latest version's parent with the large ``fields`` asked for; null where a row has none.

        Tables are joined bucket by bucket as they lie: no exchange, and children that aren't asked
        for aren't read. LookupError if nothing is stored or there is no such field.
        """
        rows = self.read_manifest(spark, name)
        entries = {r["part"]: r for r in rows.where(F.col("number") == rows.agg(F.max("number")).first()[0]).collect()}
        if absent := [p for p in ("parent", *fields) if p not in entries]:
            raise LookupError(f"{name} has no {', '.join(absent)}")
        for part in ("parent", *fields):
            r = entries[part]
            known = f"CREATE TABLE IF NOT EXISTS {_bucketed_name(r['version'], part)} ({r['columns']}) USING parquet CLUSTERED BY (`{r['key']}`) SORTED BY (`{r['key']}`) INTO {r['buckets']} BUCKETS LOCATION '{self.path(name)}/{r['version']}/{part}'"
            spark.sql(known)
        key, version = entries["parent"]["key"], entries["parent"]["version"]
        out = spark.table(_bucketed_name(version, "parent"))
        for field in fields:
            out = out.join(spark.table(_bucketed_name(version, field)).hint("merge"), key, "left")
        return out


#: A row for each table of a version of a split table; versions are numbered from 0.
MANIFEST = "number long, version string, key string, buckets int, part string, columns string"


def _bucketed_name(version: str, part: str) -> str:
    return f"`split_{version}_{part.lower()}`"


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def json_lookup(spark: SparkSession, path: str, key: str | None = None, value: str | None = None) -> DataFrame:
    """(key, value) pairs of a JSON file: one object, or with the names given a list of records."""
    if key is None:
        whole = spark.read.text(path, wholetext=True)
        return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    records = spark.read.schema(f"`{key}` string, `{value}` string").option("multiLine", True).json(path)
    return records.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(value).alias("value"))


def merged_lookup(*lookups: DataFrame) -> DataFrame:
    """One value for each key; ValueError if two lookups, or one, give a key different values."""
    rows = lookups[0]
    for other in lookups[1:]:
        rows = rows.unionByName(other)
    agg = rows.groupBy("key").agg(F.min("value").alias("value"), F.max("value").alias("__max"))
    if not agg.where("value <> __max").isEmpty():
        raise ValueError("a key has different values")
    return agg.select("key", "value")


def write_results(df: DataFrame, path: str, partition: str) -> None:
    """Results as JSON in a folder for each partition value; an existing target is refused."""
    df.write.mode("errorifexists").partitionBy(partition).json(path)
