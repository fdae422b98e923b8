"""Keyed tables: rows are replaced by key, and only buckets that hold changed keys are written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """Rows by ``keys`` in ``buckets`` folders, each with generations. A commit is a small table of the generation of every bucket that
    stands; a reader takes the last whole commit, a write with a number that is committed already does nothing, and one that was
    broken off leaves folders that no commit names, and a retry writes over them.

    ``buckets`` is fixed when the table is made: about the rows that a bucket may rewrite for one changed key.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _names(self, folder: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def commits(self) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.path}/commits") if "_SUCCESS" in self._names(f"{self.path}/commits/{n}"))

    def _generations(self) -> dict[int, int]:
        """bucket -> number of the write that made it what it is."""
        done = self.commits()
        return dict(self.spark.read.schema("bucket int, generation int").parquet(f"{self.path}/commits/{done[-1]}").collect()) if done else {}

    def _read(self, generations: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/rows/generation={g}/bucket={b}" for b, g in generations.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        return self._read(self._generations())

    def _write(self, number: int, touched: DataFrame, merged) -> dict[int, int]:
        done = self.commits()
        standing = self._generations()
        if done and number <= done[-1]:
            return standing
        now = [r["bucket"] for r in touched.select(self._bucket().alias("bucket")).distinct().collect()]  # at most ``buckets``
        rows = merged(self._read({b: standing[b] for b in now if b in standing})).withColumn("bucket", self._bucket())
        out = f"{self.path}/rows/generation={number}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(out)
        made = {int(n.split("=")[1]) for n in self._names(out) if n.startswith("bucket=")}
        after = {b: g for b, g in standing.items() if b not in now} | {b: number for b in now if b in made}
        self.spark.createDataFrame(list(after.items()), "bucket int, generation int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{number}")
        return after

    def upsert(self, incoming: DataFrame, number: int, order: str | None = None) -> None:
        """Rows of ``incoming`` replace those of their key; with ``order`` the row with the greatest value of a key stays, whichever side has it."""
        names = [c.split(" ")[0] for c in self.schema.split(", ")]
        incoming = incoming.select(*names)

        def merged(held: DataFrame) -> DataFrame:
            both = held.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
            rank = F.struct(*([order, "_new"] if order else ["_new"]))
            return both.groupBy(*self.keys).agg(F.max_by(F.struct(*names), rank).alias("_row")).select("_row.*")

        self._write(number, incoming, merged)

    def delete(self, gone: DataFrame, number: int) -> None:
        """Rows of the given keys go."""
        keys = gone.select(*self.keys).distinct()
        self._write(number, keys, lambda held: held.join(keys, self.keys, "left_anti"))
