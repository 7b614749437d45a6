"""Tables in key buckets: a batch rewrites only the buckets that it touches, and one small file makes them current.

Layout: ``data/<write>/_bucket=<b>`` holds the rows of one bucket as one write left them; ``manifests/<number>.json`` names the current
folder of every bucket and each writer's last batch. A commit is one rename to the next number, which fails if another writer was faster;
readers take the highest number, so they see the table before a batch or after it. A batch that failed before its commit
left folders that no manifest names; a batch that comes again after its commit does nothing.

Written are the buckets with a key of the batch: for a small batch about one bucket a key, whatever the size of the table. Folders that the
last manifests don't name go by ``vacuum``.

Defined results: rows without a key column are an error of Spark's; null keys are keys like others; of rows with equal keys the latest by the
order stays, a row of the batch before one of the table where they are equal; an empty batch commits its number only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.grouping import first_per_key


class BucketTable:
    """A keyed table under ``path``; ``buckets`` holds for a new table, an existing one keeps its own."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.n = spark, path.rstrip("/"), list(keys), buckets
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if state := self.state():
            if state["keys"] != self.keys:
                raise ValueError(f"the table's keys are {state['keys']}")
            self.n = state["n"]

    # ---- manifests ----

    def _numbers(self) -> list[int]:
        folder = self._at(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and not x.startswith("."))

    def _read(self, number: int) -> dict:
        stream = self._fs.open(self._at(f"{self.path}/manifests/{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def state(self) -> dict | None:
        """The current manifest, with its number."""
        numbers = self._numbers()
        return {**self._read(numbers[-1]), "number": numbers[-1]} if numbers else None

    def _commit(self, before: dict | None, schema: StructType, folders: dict[str, str], writers: dict[str, int]) -> None:
        number = before["number"] + 1 if before else 0
        said = json.dumps({"keys": self.keys, "n": self.n, "schema": schema.jsonValue(), "folders": folders, "writers": writers})
        draft, final = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}"), self._at(f"{self.path}/manifests/{number:012d}.json")
        out = self._fs.create(draft)
        out.write(bytearray(said.encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"another writer has made version {number} of {self.path}")

    # ---- reading ----

    def _load(self, state: dict, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        paths = [f"{self.path}/{state['folders'][b]}" for b in buckets if b in state["folders"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """All rows of the current version."""
        state = self.state()
        if state is None:
            raise ValueError(f"there is no table in {self.path}")
        return self._load(state, [*state["folders"]])

    # ---- writing ----

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int")

    def _write(self, rows: DataFrame, n: int) -> dict[str, str]:
        """Write rows, a folder a bucket; says which."""
        name = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self.bucket()).repartition(max(1, n), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        found = [f.getPath().getName() for f in self._fs.listStatus(self._at(f"{self.path}/{name}"))]
        return {x[8:]: f"{name}/{x}" for x in found if x.startswith("_bucket=")}

    def replace(self, rows: DataFrame) -> None:
        """All rows anew, as one commit; writers start over."""
        self._commit(self.state(), rows.schema, self._write(rows, self.n), {})

    def _touched(self, rows: DataFrame) -> list[str]:
        return [str(r[0]) for r in rows.select(self.bucket()).distinct().collect()]  # at most n numbers

    def _done(self, state: dict | None, writer: str, batch: int) -> bool:
        return state is not None and batch <= state["writers"].get(writer, -1)

    def merge(self, rows: DataFrame, order: list[str], batch: int, writer: str = "merge") -> int:
        """Last write of each key wins, the latest by ``order``; the number of buckets written. A batch that ``writer`` has committed is left alone."""
        state = self.state()
        if self._done(state, writer, batch):
            return 0
        entries = first_per_key(rows, self.keys, [F.desc(c) for c in order])
        touched = self._touched(entries)
        schema = StructType.fromJson(state["schema"]) if state else rows.schema
        entries = entries.select(schema.names)
        if state:
            old = self._load(state, touched)
            both = old.withColumn("_new", F.lit(0)).unionByName(entries.withColumn("_new", F.lit(1)))
            merged = first_per_key(both, self.keys, [*[F.desc(c) for c in order], F.desc("_new")]).drop("_new")
        else:
            merged = entries
        new = self._write(merged, len(touched)) if touched else {}
        self._commit(state, schema, {**(state["folders"] if state else {}), **new}, {**(state["writers"] if state else {}), writer: batch})
        return len(touched)

    def update(self, values: DataFrame, column: str, batch: int, writer: str = "update") -> int:
        """``column`` replaced where ``values`` (keys, ``column``) has the key; other rows stay, keys that the table lacks are left out."""
        state = self.state()
        if state is None:
            raise ValueError(f"there is no table in {self.path}")
        if self._done(state, writer, batch):
            return 0
        touched = self._touched(values)
        old, schema = self._load(state, touched), StructType.fromJson(state["schema"])
        new = values.dropDuplicates(self.keys).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], F.col(column).alias("_v"), F.lit(True).alias("_hit"))
        same = F.lit(True)
        for i, k in enumerate(self.keys):
            same = same & old[k].eqNullSafe(new[f"_k{i}"])
        merged = old.join(new, same, "left").withColumn(column, F.when(F.col("_hit"), F.col("_v")).otherwise(F.col(column))).select(schema.names)
        folders = self._write(merged, len(touched)) if touched else {}
        self._commit(state, schema, {**state["folders"], **folders}, {**state["writers"], writer: batch})
        return len(touched)

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests but the last ``keep``, and folders that these don't name; the number of folders deleted. Not while another writer is at work."""
        numbers = self._numbers()
        held = {f for k in numbers[-keep:] for f in self._read(k)["folders"].values()}
        for k in numbers[:-keep]:
            self._fs.delete(self._at(f"{self.path}/manifests/{k:012d}.json"), False)
        gone = 0
        for write in self._fs.listStatus(self._at(f"{self.path}/data")):
            parts = [f.getPath().getName() for f in self._fs.listStatus(write.getPath())]
            stale = [x for x in parts if x.startswith("_bucket=") and f"data/{write.getPath().getName()}/{x}" not in held]
            for x in stale:
                self._fs.delete(self._at(f"{self.path}/data/{write.getPath().getName()}/{x}"), True)
            gone += len(stale)
        return gone


def merging_sink(table: BucketTable, order: list[str], writer: str):
    """For ``foreachBatch``: merges every batch once. ``writer`` names the stream: its batch numbers count for it alone, and may have gaps."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()  # read for its buckets and for its rows
        try:
            table.merge(batch, order, epoch, writer)
        finally:
            batch.unpersist()

    return write


def refreshed_set(tables: dict[str, DataFrame], path: str, version: str, keys: dict[str, list[str]], links: list[tuple[str, str, str, str]]) -> list[str]:
    """All tables of a set under a new version, parents first, and then one pointer to it; the order they were written in.

    ``keys``: columns that must be unique and not null; ``links``: (table, column, parent, column): every non-null value must be in the parent. The
    written version is checked before the pointer moves; a breach raises ValueError and the old version stays current.
    """
    spark = next(iter(tables.values())).sparkSession
    order: list[str] = []
    while rest := [t for t in tables if t not in order]:
        free = [t for t in rest if all(p in order or p == t or c != t for c, _, p, _ in links)]
        if not free:
            raise ValueError(f"links form a cycle among {sorted(rest)}")
        order += free
    for name in order:
        tables[name].write.mode("overwrite").parquet(f"{path}/{version}/{name}")
    new = {name: spark.read.parquet(f"{path}/{version}/{name}") for name in order}
    broken = []
    for name, columns in keys.items():
        missing = F.lit(False)
        for c in columns:
            missing = missing | F.col(c).isNull()
        n = new[name].groupBy(*columns).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | missing).count()
        broken += [f"{name}: {n} keys null or repeated"] * (n > 0)
    for name, column, parent, key in links:
        n = new[name].filter(F.col(column).isNotNull()).join(new[parent].select(F.col(key).alias(column)), column, "left_anti").count()
        broken += [f"{name}.{column}: {n} rows without {parent}.{key}"] * (n > 0)
    if broken:
        raise ValueError("; ".join(broken))
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/current")
    return order
