"""A stream gives what one batch over all files gives."""

from pyspark.sql import functions as F

from lithos.operators import chunking, feedback
from lithos.plans import tables
from lithos.streaming import flows


def test_ingest(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(2):
        docs.filter(f"doc_id % 2 = {part}").write.mode("append").parquet(inbox)
        flows.ingest_stream(spark, inbox, "doc_id long, text string, source string", out, str(tmp_path / "cp")).awaitTermination()
    docs.filter("doc_id < 10").write.mode("append").parquet(inbox)  # known documents again
    flows.ingest_stream(spark, inbox, "doc_id long, text string, source string", out, str(tmp_path / "cp")).awaitTermination()
    key = lambda df: sorted((r["doc_id"], r["chunk_index"], r["text"]) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(chunking.chunks(docs))


def test_feedback(spark, tmp_path):
    """Batches in the order of time give what one fold over all events gives; each works on its own events only."""
    events = tables.events(spark, "/root/testdata/sf0.001").withColumn("expert_risk", F.when(F.col("event_id") % 5 == 0, F.lit(8.0)))
    inbox, log, weights = (str(tmp_path / x) for x in ("in", "log", "weights"))
    schema = events.schema.simpleString()[7:-1].replace(":", " ")
    assert flows.current_weights(spark, weights) is None
    middle = events.agg(F.percentile_approx("ts", 0.5)).first()[0]
    for part in (F.col("ts") <= F.lit(middle), F.col("ts") > F.lit(middle)):
        events.filter(part).write.mode("append").parquet(inbox)
        flows.feedback_stream(spark, inbox, schema, log, weights, str(tmp_path / "cp")).awaitTermination()
    key = lambda df: sorted((r["tenant"], r["n"], round(r["risk"], 9), round(r["novelty"], 9)) for r in df.collect())
    assert key(flows.current_weights(spark, weights)) == key(feedback.fold_weights(events))
    assert spark.read.parquet(log).count() == events.count()


def test_counts(spark):
    events = tables.events(spark, "/root/testdata/sf0.001")
    assert sum(r["n"] for r in flows.feedback_counts(events).collect()) == events.count()
