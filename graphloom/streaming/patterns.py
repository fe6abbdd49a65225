"""Fixed-hop pattern counts over relationships that arrive as a stream.

Each micro-batch of new relationships adds the matches that it completes, with
new relationships on either hop, so that earlier batches aren't read again but
through the join.  Batches are idempotent: a batch's counts replace those that
an earlier try of it has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def count_hops(stream: DataFrame, by: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps, under path, the number of relationships for each value of a column, a folder for each batch."""

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(by).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_two_hops(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the number of trails (a)-->(b)-->(c) for each b, from columns _id, _src and _dst.

    new x all, and old x new: each pair of relationships is counted in the batch of its later one.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.select("_id", "_src", "_dst")
        batch.write.mode("overwrite").parquet(f"{path}/rels/batch={number}")
        every = spark.read.parquet(f"{path}/rels").where(F.col("batch") <= number)
        ends = lambda df, key: df.groupBy(F.col(key).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        new_in, new_out = ends(batch, "_dst"), ends(batch, "_src")
        all_out, old_in = ends(every, "_src"), ends(every.where(F.col("batch") < number), "_dst")
        loops = batch.where("_src = _dst").groupBy(F.col("_src").alias("b")).agg((-F.count(F.lit(1))).alias("n"))  # a loop doesn't follow itself
        product = lambda x, y: x.join(y.withColumnRenamed("n", "m"), "b").select("b", (F.col("n") * F.col("m")).alias("n"))
        total = product(new_in, all_out).unionByName(product(old_in, new_out)).unionByName(loops)
        total.groupBy("b").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, by: str) -> DataFrame:
    """The sums over all batches so far."""
    return spark.read.parquet(path).groupBy(by).agg(F.sum("n").alias("n"))
