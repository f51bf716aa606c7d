"""The jobs on streams of outputs, tool events and compaction logs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..operators.dedup import REF_LENGTH, fingerprint, merge_cache, outdated, ref_token
from ..operators.events import classify, parse_events
from ..operators.metrics import savings
from ..operators.refs import known_paths
from ..plans.compact import Compaction, compact, compact_text, prepare
from ..session import TEXT_CODEC, drop_shuffles, new_dir, remove

CACHE_SCHEMA = (
    "scope string, fp string, ref string, compressed string, original_tokens long, "
    "compressed_tokens long, last_storable_seq long, created_at timestamp"
)
CONTROL_SCHEMA = "scope string, seq long, kind string"


def compact_stream(outputs: DataFrame) -> DataFrame:
    """Every output by itself; keeps no state."""
    return compact_text(outputs)


def classify_stream(events: DataFrame, wrap_marker: str | None = None, own_names: Sequence[str] = ()) -> DataFrame:
    return classify(parse_events(events), wrap_marker, own_names)


def keep_first_stream(outputs: DataFrame, delay: str) -> DataFrame:
    """The first copy of each text to arrive; state is dropped behind the watermark."""
    keyed = prepare(outputs).filter(~F.col("blank")).select(
        "output_id", "ts", "seq", "scope", fingerprint(F.col("stripped")).alias("fp"))
    return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["scope", "fp"])


def rolling_savings(log: DataFrame, length: str = "24 hours", slide: str = "1 hour",
                    delay: str = "1 hour") -> DataFrame:
    span = F.window("ts", length, slide)
    return (
        log.withWatermark("ts", delay).groupBy(span).agg(*savings())
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                "compressions", "original_tokens", "compressed_tokens", "tokens_saved", "reduction_pct")
    )


class _History:
    """What batches leave for later ones: one table per batch, merged into one every `every` batches.

    A batch that runs again replaces what it wrote and finds the same history as
    before. What a merged table holds is removed when the next batch begins, as
    its own batch cannot run again from then on.
    """

    def __init__(self, folder: str, schema: str, merge: Callable[[DataFrame], DataFrame], every: int) -> None:
        self.folder, self.schema, self.merge, self.every = folder, schema, merge, every

    def _base(self, batch_id: int) -> int:
        return (batch_id - 1) // self.every * self.every

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        if batch_id == 0:
            return None
        base = self._base(batch_id)
        paths = [f"{self.folder}/merged/{base}"] + [f"{self.folder}/batch/{i}" for i in range(base + 1, batch_id)]
        if batch_id == base + 1:
            remove(spark, [f"{self.folder}/batch/{i}" for i in range(max(0, base - self.every), base + 1)]
                   + [f"{self.folder}/merged/{base - self.every}"])
        return spark.read.schema(self.schema).parquet(*paths)

    def add(self, table: DataFrame, batch_id: int) -> DataFrame:
        """Write the batch's own rows; returns all up to and with them."""
        spark, path = table.sparkSession, f"{self.folder}/batch/{batch_id}"
        earlier = self.before(spark, batch_id)
        table.write.mode("overwrite").parquet(path)
        own = spark.read.schema(self.schema).parquet(path)
        every = self.merge(own if earlier is None else earlier.unionByName(own))
        if batch_id % self.every == 0:
            every.write.mode("overwrite").parquet(f"{self.folder}/merged/{batch_id}")
        return every


def _together(*jobs: Callable[[], object]) -> None:
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(job) for job in jobs]:
            done.result()


_LATE = "output_id long, scope string, seq long, fp string"


def dedup_batches(state_dir: str, out_dir: str, control_dir: str | None = None,
                  merge_every: int = 16) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: compact each batch against the cache of all batches before.

    Known paths are those read in the batches so far. control_dir may hold
    control events (scope, seq, kind) as they arrive; it is read for every
    batch. A batch is read from its source as often as it is needed, and kept nowhere else: sources of streams
    give the same rows again. Texts of the cache are only added to; the keys that a batch is
    compared with, the first stored position of each text and epoch, are kept apart from them.

    Rows may come behind others of higher seq. They are compared with what
    stands before them, and rows of earlier batches that have become
    references through them are written again; read_results gives the last word on each row.
    Control events and reads of files must be there with the rows that follow them.
    """
    keys = _History(
        f"{state_dir}/keys", "scope string, fp string, epoch long, last_storable_seq long",
        lambda k: k.groupBy("scope", "fp", "epoch").agg(F.min("last_storable_seq").alias("last_storable_seq")), merge_every)
    paths = _History(f"{state_dir}/known", "scope string, path string, added_seq long",
                     lambda known: known.groupBy("scope", "path").agg(F.min("added_seq").alias("added_seq")), merge_every)
    full = _History(f"{state_dir}/full", "scope string, fp string, epoch long, stale boolean, seq long, output_id long",
                    lambda rows: rows, merge_every)

    def correct(done: Compaction, batch_id: int) -> None:
        """Add the batch's keys, and write which earlier rows they make references."""
        spark = done.stored.sparkSession
        keys.add(done.stored.withColumnRenamed("seq", "last_storable_seq"), batch_id)
        earlier = full.before(spark, batch_id)
        if earlier is None:
            return
        own = spark.read.schema(keys.schema).parquet(f"{keys.folder}/batch/{batch_id}")
        seen = earlier.groupBy("scope").agg(F.max("seq").alias("_last"))
        late = own.withColumnRenamed("last_storable_seq", "seq").join(F.broadcast(seen), "scope").filter("seq < _last").drop("_last")
        if not late.isEmpty():
            outdated(earlier, late).select("output_id", "scope", "seq", "fp").write.mode("overwrite").parquet(
                f"{state_dir}/changed/batch={batch_id}")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = paths.add(known_paths(batch), batch_id)
        control = None if control_dir is None else spark.read.schema(CONTROL_SCHEMA).parquet(control_dir)
        done = compact(batch, control, known, keys.before(spark, batch_id))

        def write_texts() -> None:
            done.compacted.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}", compression=TEXT_CODEC)
            drop_shuffles(spark)
            done.cache_entries.write.mode("overwrite").parquet(f"{state_dir}/entries/batch={batch_id}", compression=TEXT_CODEC)

        # Sinks that do not depend on each other are planned and written side by side; both that may
        # shuffle texts come one behind the other, so the disk holds one such shuffle.
        _together(
            write_texts,
            lambda: correct(done, batch_id),
            lambda: full.add(done.full, batch_id))
        done.close()
        drop_shuffles(spark)

    return run


def read_results(spark: SparkSession, state_dir: str, out_dir: str) -> DataFrame:
    """The rows of all batches so far, with references where later batches made them ones."""
    rows = spark.read.parquet(f"{out_dir}/batch=*")
    try:
        changed = spark.read.schema(_LATE).parquet(f"{state_dir}/changed/batch=*")
    except AnalysisException:
        return rows
    changed = changed.select("output_id", F.lit(True).alias("_ref")).distinct()
    is_ref = F.coalesce("_ref", F.lit(False))
    return rows.join(changed, "output_id", "left").select(*[
        {"result": F.when(is_ref, ref_token(F.col("fp"))).otherwise(F.col("result")),
         "outcome": F.when(is_ref, "ref").otherwise(F.col("outcome")),
         "is_secret": ~is_ref & F.col("is_secret"),
         "comp_tokens": F.when(is_ref, token_estimate(F.lit(REF_LENGTH))).otherwise(F.col("comp_tokens")),
         }.get(c, F.col(c)).alias(c) for c in rows.columns])


def read_cache(spark: SparkSession, state_dir: str) -> DataFrame:
    """The cache that the batches so far have filled."""
    return merge_cache(None, spark.read.schema(CACHE_SCHEMA).parquet(f"{state_dir}/entries/batch=*"))


def run_parts(rows: DataFrame, parts: Sequence[Column], run: Callable[[DataFrame], None]) -> None:
    """Rows that arrive part by part: each is written by all tasks, then the stream runs over what has come."""
    spark, landing = rows.sparkSession, new_dir(rows.sparkSession, "landing")
    for part in parts:
        rows.filter(F.coalesce(part, F.lit(False))).write.mode("append").parquet(landing)
        run(spark.readStream.schema(rows.schema).parquet(landing))


class FileSink:
    """Files that a stream appends to, run after run."""

    def __init__(self, spark: SparkSession) -> None:
        self.out, self.progress = new_dir(spark, "stream"), new_dir(spark, "progress")

    def run(self, stream: DataFrame) -> DataFrame:
        """Process all that is there, and return what has been written so far."""
        query = (stream.writeStream.format("parquet").option("path", self.out)
                 .option("checkpointLocation", self.progress).trigger(availableNow=True).start())
        query.awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).parquet(self.out)


class UpdateSink:
    """The last row of every key of a stream in update mode, run after run.

    Each batch writes what it changed under its own id, so state behind the
    watermark can be dropped and a batch that runs again replaces its rows.
    """

    def __init__(self, spark: SparkSession, *keys: str) -> None:
        self.keys, self.out, self.progress = keys, new_dir(spark, "updates"), new_dir(spark, "progress")

    def run(self, stream: DataFrame) -> DataFrame:
        """Process all that is there, and return the last rows so far."""
        run_batches(stream, self.progress,
                    lambda df, i: df.write.mode("overwrite").parquet(f"{self.out}/batch={i}"), "update")
        changes = stream.sparkSession.read.option("basePath", self.out).parquet(f"{self.out}/batch=*")
        rest = [c for c in stream.columns if c not in self.keys]
        return changes.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*self.keys, "_last.*")


def run_to_end(stream: DataFrame) -> DataFrame:
    """Process all that is there, into files, and return what was written."""
    return FileSink(stream.sparkSession).run(stream)


def run_updates(stream: DataFrame, *keys: str) -> DataFrame:
    """Process all that is there in update mode; returns the last row of every key."""
    return UpdateSink(stream.sparkSession, *keys).run(stream)


def run_batches(stream: DataFrame, checkpoint: str, run: Callable[[DataFrame, int], None],
                mode: str = "append") -> None:
    (stream.writeStream.outputMode(mode).foreachBatch(run).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
