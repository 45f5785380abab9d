"""A keyed table that batches are merged into: one row a key, the newest wins.

Keys are dealt to buckets. A batch rewrites the buckets that it touches, each under a folder of the batch's own, and then commits a manifest that names the
folder of every bucket; the manifest appears by one rename, so readers see all of a batch or nothing. An epoch whose manifest is there is in already, so a batch
that a stream runs again changes nothing. Folders that neither of the last two manifests names are removed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class KeyedSnapshot:
    """The snapshot under ``path``; ``order`` is the column whose greatest value is the newest (ties: the later epoch), ``key`` may be null."""

    def __init__(self, spark: SparkSession, path: str, key: str = "event", order: str = "ts", buckets: int = 32):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def epochs(self) -> list[int]:
        """Committed epochs that are kept, oldest first."""
        folder = self._at("manifest")
        if not self._fs.exists(folder):
            return []
        return sorted(int(name[:-5]) for f in self._fs.listStatus(folder) if (name := f.getPath().getName()).endswith(".json") and name[:-5].isdigit())

    def _manifest(self, epoch: int) -> dict:
        stream = self._fs.open(self._at(f"manifest/{epoch:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, epoch: int, said: dict) -> None:
        draft = self._at(f"manifest/.{epoch}-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        if not self._fs.rename(draft, self._at(f"manifest/{epoch:020d}.json")):
            raise RuntimeError(f"epoch {epoch} could not be committed")

    def _rows(self, said: dict, buckets: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(said["schema"])
        folders = sorted(f for b, f in said["buckets"].items() if buckets is None or int(b) in buckets)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self) -> DataFrame:
        """The rows of the last committed epoch, with ``n_rows``, the number of rows that the key has had."""
        epochs = self.epochs()
        if not epochs:
            raise ValueError(f"no snapshot under {self.path}")
        return self._rows(self._manifest(epochs[-1]))

    def upsert(self, batch: DataFrame, epoch: int) -> bool:
        """Merge a batch; false if its epoch, or a later one, is in already."""
        epochs = self.epochs()
        if epochs and epoch <= epochs[-1]:
            return False
        before = self._manifest(epochs[-1]) if epochs else None
        columns = batch.columns
        if before and [f["name"] for f in before["schema"]["fields"]] != [*columns, "n_rows"]:
            raise ValueError(f"columns {columns} differ from the snapshot's")
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

        def newest(rows: DataFrame, *order: str) -> DataFrame:
            last = F.max_by(F.struct(*columns), F.struct(*order))
            return rows.groupBy(F.col(self.key).alias("__k"), "__bucket").agg(last.alias("s"), F.sum("n_rows").alias("n_rows")).select("s.*", "n_rows", "__bucket")

        new = newest(batch.withColumns({"n_rows": F.lit(1).cast("long"), "__bucket": bucket}), self.order)
        work = f"data/epoch={epoch}-{uuid.uuid4().hex}"
        new.write.partitionBy("__bucket").parquet(f"{self.path}/{work}/batch")
        touched = {int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(self._at(f"{work}/batch")) if "=" in s.getPath().getName()}
        new = self.spark.read.schema(new.schema).parquet(f"{self.path}/{work}/batch")
        if before:
            old = self._rows(before, touched).withColumn("__bucket", bucket)
            both = old.withColumn("__later", F.lit(0)).unionByName(new.withColumn("__later", F.lit(1)))
            new = newest(both, self.order, "__later")
        new.write.partitionBy("__bucket").parquet(f"{self.path}/{work}/merged")
        named = dict(before["buckets"]) if before else {}
        named |= {str(b): f"{work}/merged/__bucket={b}" for b in touched}
        schema = T.StructType([f for f in new.schema.fields if f.name != "__bucket"])
        self._commit(epoch, {"epoch": epoch, "schema": json.loads(schema.json()), "buckets": named})
        self._fs.delete(self._at(f"{work}/batch"), True)
        self._clean()
        return True

    def _clean(self) -> None:
        """Remove what neither of the last two manifests names."""
        epochs = self.epochs()
        for epoch in epochs[:-2]:
            self._fs.delete(self._at(f"manifest/{epoch:020d}.json"), False)
        used = {f.split("/")[1] for e in epochs[-2:] for f in self._manifest(e)["buckets"].values()} | {f"epoch={e}-" for e in epochs[-2:]}
        for s in self._fs.listStatus(self._at("data")):
            name = s.getPath().getName()
            if name not in used and int(name.split("=")[1].split("-")[0]) <= epochs[-1]:
                self._fs.delete(s.getPath(), True)
