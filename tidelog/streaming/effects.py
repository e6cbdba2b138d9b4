"""Effects of events, exactly once: processed ids, balances, consumer state and history change together or not at all.

An effect store is a folder. Every batch writes its part of four tables, ``<table>/batch=<id>``, and then one marker,
``committed/<id>``, which is made in a single atomic step. Readers see the batches that have a marker; what a lost attempt left
without one is overwritten by the next. Only then is the source's progress committed (by the stream's checkpoint), so a batch
that is replayed finds its marker and does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TABLES = {
    "processed": "event_id string, account_id string, delta long, msg_offset long",
    "balances": "account_id string, delta long",
    "history": "prev_offset long, new_offset long, seq long",
}


class EffectStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def committed(self) -> list[int]:
        """Batches in order; their number grows with the batches, not with the events."""
        fs, p = self._fs(f"{self.path}/committed")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def table(self, name: str) -> DataFrame:
        """The committed rows of a table."""
        paths = [f"{self.path}/{name}/batch={b}" for b in self.committed()]
        schema = TABLES[name]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def balances(self) -> DataFrame:
        """(account_id, balance)."""
        return self.table("balances").groupBy("account_id").agg(F.sum("delta").alias("balance"))

    def state(self) -> DataFrame:
        """(last_offset): how far effects reach; no row before the first."""
        return self.table("history").agg(F.max("new_offset").alias("last_offset")).where("last_offset IS NOT NULL")

    def apply(self, events: DataFrame, batch_id: int) -> bool:
        """Take in events (event_id, account_id, delta, msg_offset); False if the batch was taken in before.

        An event's first message counts, in this batch or an earlier one; null ids are never the same event.
        """
        fs, marker = self._fs(f"{self.path}/committed/{batch_id}")
        if fs.exists(marker):
            return False
        named = events.where("event_id IS NOT NULL").groupBy("event_id").agg(F.min_by(F.struct("account_id", "delta", "msg_offset"), "msg_offset").alias("e"))
        named = named.select("event_id", "e.*").join(self.table("processed").select("event_id"), "event_id", "left_anti")
        fresh = named.unionByName(events.where("event_id IS NULL").select(*named.columns)).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in TABLES["processed"].split(", ")])
        self._write(fresh, "processed", batch_id)
        fresh = self.spark.read.schema(TABLES["processed"]).parquet(f"{self.path}/processed/batch={batch_id}")
        self._write(fresh.groupBy("account_id").agg(F.sum("delta").alias("delta")), "balances", batch_id)
        last = self.state().agg(F.coalesce(F.max("last_offset"), F.lit(-1)).alias("prev_offset"))
        reach = events.agg(F.max("msg_offset").cast("long").alias("_new"))  # one row each
        move = last.crossJoin(reach).where("_new > prev_offset")
        self._write(move.select("prev_offset", F.col("_new").alias("new_offset"), F.lit(batch_id).cast("long").alias("seq")), "history", batch_id)
        fs.create(marker, True).close()
        return True

    def _write(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")


def consume_into(stream: DataFrame, store: EffectStore, checkpoint: str) -> StreamingQuery:
    """A stream of events into a store, until what is there has been taken in."""

    def write(batch: DataFrame, batch_id: int) -> None:
        EffectStore(batch.sparkSession, store.path).apply(batch, batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
