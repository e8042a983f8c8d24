"""The two incremental flows: new documents and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lithos.operators import chunking, learning
from lithos.operators.feedback import CRITERIA, bucket, fold_weights
from lithos.sources import stores


def ingest_stream(spark: SparkSession, folder: str, schema: str, chunk_folder: str, checkpoint: str) -> StreamingQuery:
    """Chunks of each new file of documents (doc_id, text, source), in a table by bucket of doc_id and batch (stores.add_new()).

    Documents that are already there are left out; a batch looks at the keys in the buckets of its documents alone and writes only its own
    rows, and one that is run again puts the same rows in their place, so that the result is that of one batch over all files.
    """

    def merge(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")  # the checkpoint's: two streams may write to one table
        stores.add_new(batch, chunk_folder, ["doc_id"], f"{query}-{number}", chunking.chunks)

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feedback_counts(events: DataFrame) -> DataFrame:
    """Running counters by bucket, for update mode."""
    return events.groupBy(bucket(F.col("status")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("novelty").alias("novelty"))


def feedback_stream(spark: SparkSession, folder: str, schema: str, log_folder: str, weight_folder: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch to the log and carries the weights on by it: a batch starts from the weights of the one before and
    writes a version of its own, so that the work is the batch's and readers (current_weights()) see no gap. Events
    that come late count when they come. A batch that is run again gives the same version."""

    def learn(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{log_folder}/batch={number}")
        before = current_weights(batch.sparkSession, weight_folder, number)
        fold_weights(batch, start=before).write.mode("overwrite").parquet(f"{weight_folder}/version={number}")

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_weights(spark: SparkSession, weight_folder: str, before: int = 1 << 62) -> DataFrame | None:
    """The newest whole version of the weights with a number under `before`; None if there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(weight_folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return None
    done = [p.getPath() for p in files.listStatus(root) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p.getPath(), "_SUCCESS"))]
    numbers = [int(p.getName().split("=")[1]) for p in done if p.getName().startswith("version=")]
    last = max((n for n in numbers if n < before), default=None)
    return None if last is None else spark.read.parquet(f"{weight_folder}/version={last}")


class LearningProcessor(StatefulProcessor):
    """learned() as keyed state of a stream. A batch reads a key's state once, takes the key's new events in order of
    (ts, event_id) and writes it back; late events count when they come. The state goes on from an initial one where there is."""

    def __init__(self, key: str, count_repeats: bool = True) -> None:
        self.key, self.count_repeats = key, count_repeats

    def init(self, handle: StatefulProcessorHandle) -> None:
        numbers = "n long, confirmed_count long, rejected_count long, " + ", ".join(f"{c} double" for c in CRITERIA)
        self.numbers = handle.getValueState("numbers", numbers)
        self.sums = handle.getMapState("sums", "bucket string, criterion string", "total double, n long")
        self.items = {b: handle.getListState(f"{b}_items", "text string, note string, n long") for b in learning.BUCKETS}

    def _load(self) -> learning.Learned:
        state = learning.Learned()
        if self.numbers.exists():
            n, confirmed, rejected, *weights = self.numbers.get()
            state.n, state.counts, state.weights = n, {"confirmed": confirmed, "rejected": rejected}, dict(zip(CRITERIA, weights, strict=True))
            state.sums |= {tuple(k): list(v) for k, v in self.sums.iterator()}
            state.items = {b: [list(i) for i in self.items[b].get()] for b in learning.BUCKETS}
        return state

    def _save(self, state: learning.Learned) -> None:
        self.numbers.update((state.n, *(state.counts[b] for b in learning.BUCKETS), *(state.weights[c] for c in CRITERIA)))
        for k, v in state.sums.items():
            if v[1]:
                self.sums.updateValue(k, tuple(v))
        for b, items in state.items.items():
            self.items[b].put([tuple(i) for i in items]) if items else self.items[b].clear()

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        state = self._load()
        for r in learning.rows_of(pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")):
            state.learn(r, self.count_repeats)
        self._save(state)
        yield pd.DataFrame([(key[0], *state.row())], columns=[self.key, *_STATE])

    def handleInitialState(self, key, initialState, timerValues):
        for r in learning.rows_of(initialState):
            self._save(learning.Learned.of(r))


_STATE = [p.split()[0] for p in learning.state_schema("", "").replace("struct<text:string,note:string,n:long>", "item").split(", ")[1:]]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def learning_stream(events: DataFrame, state_folder: str, checkpoint: str, key: str = "tenant", start: DataFrame | None = None, count_repeats: bool = True) -> StreamingQuery:
    """Events (a stream; columns as learned() takes them) to each key's state. A batch writes the states that it changed as a
    version of its own, so that one which is run again after a fault writes the same files; current_states() reads the newest of
    each key. start: states to begin with, used by the first batch alone."""
    spark = events.sparkSession
    kind = events.schema[key].dataType.simpleString()
    first = None if start is None else start.groupBy(key)
    states = learning.with_columns(events, key).groupBy(key).transformWithStateInPandas(LearningProcessor(key, count_repeats), learning.state_schema(key, kind), "Update", "None", first)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state_folder}/version={number}")

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # for this stream, which keeps its own settings
    try:
        return states.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def current_states(spark: SparkSession, state_folder: str, key: str = "tenant") -> DataFrame:
    """The newest state of each key over all versions."""
    rows = spark.read.parquet(state_folder)
    names = [c for c in rows.columns if c not in (key, "version")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "version").alias("s")).select(key, "s.*")
