"""Learning from expert feedback. events: event_id, ts, status, and criterion scores 0 to 10 (null: none)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions import lexicons as lx
from lithos.functions import text as tx

from .retrieval import ranked

CRITERIA = ("novelty", "feasibility", "expected_value", "risk")
EXPERT_STEP, STATUS_STEP, LOW, HIGH = 0.05, 0.02, 0.05, 0.5


def bucket(status: Column) -> Column:
    """Whatever is not confirmed counts as rejected here, reviews included."""
    return F.when(status == "confirmed", "confirmed").otherwise("rejected")


def criterion_scores(hyps: DataFrame) -> DataFrame:
    """(…, criterion, score) of hypotheses; risk is the mean of two, where both are there."""
    risk = (F.col("risk_technical") + F.col("risk_economic")) / 2
    pairs = F.array(*[F.struct(F.lit(c).alias("criterion"), (risk if c == "risk" else F.col(c)).cast("double").alias("score")) for c in CRITERIA])
    keep = [c for c in hyps.columns if c not in (*CRITERIA, "risk_technical", "risk_economic")]
    return hyps.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.*").filter("score IS NOT NULL")


def profiles(scores: DataFrame) -> DataFrame:
    """sum, count and mean of each bucket and criterion. scores: status, criterion, score."""
    return scores.groupBy(bucket(F.col("status")).alias("bucket"), "criterion").agg(F.sum("score").alias("total"), F.count("*").alias("n"), F.avg("score").alias("average"))


def keyword_counts(events: DataFrame) -> DataFrame:
    """(bucket, word, n) over the first 25 words of each event's text, repeats counted."""
    words = events.select(bucket(F.col("status")).alias("bucket"), F.explode(tx.learner_words(F.col("text"))).alias("word"))
    return words.groupBy("bucket", "word").agg(F.count("*").alias("n"))


def exemplars(events: DataFrame, keep: int = 5, head: int = 80) -> DataFrame:
    """F05, aggregate form: (status, prefix, n, first_ts, rank) of texts that begin alike, the newest first seen first; `keep` of each status."""
    g = events.groupBy("status", F.substring("text", 1, head).alias("prefix")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))
    return ranked(g, ["status"], [F.desc("first_ts"), F.asc("prefix")], keep)


def hints(words: DataFrame, averages: DataFrame, exemplars: DataFrame | None = None, top: int = 5, gap: float = 1.0, examples: int = 2) -> DataFrame:
    """(kind, at, hint): the commonest words of each bucket, the criteria that confirmed ones score higher on by `gap`,
    and the newest examples to follow and to avoid (exemplars(): status, rank, prefix)."""
    common = ranked(words, ["bucket"], [F.desc("n"), F.asc("word")], top).select(F.col("bucket").alias("kind"), F.col("rank").alias("at"), F.col("word").alias("hint"))
    c, r = (averages.filter(F.col("bucket") == b).select("criterion", F.col("average").alias(b)) for b in ("confirmed", "rejected"))
    better = c.join(r, "criterion").filter(F.col("confirmed") - F.col("rejected") >= gap)
    out = common.union(ranked(better.withColumn("kind", F.lit("criterion")), ["kind"], [F.asc("criterion")]).select("kind", F.col("rank"), "criterion"))
    if exemplars is None:
        return out
    kind = F.when(F.col("status") == "confirmed", "exemplar").when(F.col("status") == "rejected", "anti_pattern")
    return out.union(exemplars.withColumn("kind", kind).filter((F.col("rank") <= examples) & F.col("kind").isNotNull()).select("kind", "rank", "prefix"))


def snapshot(counts: DataFrame, words: DataFrame, profiles: DataFrame, patterns: DataFrame, hint_rows: DataFrame, top: int = 50) -> DataFrame:
    """all that feedback has taught as one row, with defaults where nothing is there yet: counts (F10), the `top` words of
    each bucket (F04), score profiles (F02: bucket, criterion, total, n), exemplars and anti-patterns (F05), hints (F06)."""
    word = lambda b: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("bucket") == b, F.struct("word", "n"))))).alias(f"{b}_keywords")
    w = ranked(words, ["bucket"], [F.desc("n"), F.asc("word")], top).agg(word("confirmed"), word("rejected"))
    profile = lambda b: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("bucket") == b, F.struct("criterion", F.struct(F.col("total").cast("double").alias("total"), F.col("n").alias("n"))))))).alias(b)
    none = F.map_from_arrays(F.array(*[F.lit(c) for c in CRITERIA]), F.array(*[F.struct(F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n")) for _ in CRITERIA]))
    p = profiles.agg(profile("confirmed"), profile("rejected"))
    filled = lambda b: F.map_zip_with(none, b, lambda k, d, x: F.coalesce(x, d)).alias(b)
    p = p.select(F.struct(filled("confirmed"), filled("rejected")).alias("score_profiles"))
    listed = lambda s: F.sort_array(F.collect_list(F.when(F.col("status") == s, F.struct("rank", "prefix"))))["prefix"]
    e = patterns.agg(listed("confirmed").alias("exemplars"), listed("rejected").alias("anti_patterns"))
    h = hint_rows.agg(F.sort_array(F.collect_list(F.struct("kind", "at", "hint")))["hint"].alias("hints"))
    out = counts.select(F.coalesce("confirmed_count", F.lit(0)).alias("confirmed_count"), F.coalesce("rejected_count", F.lit(0)).alias("rejected_count"))
    for one in (w, p, e, h):
        out = out.join(one, F.lit(True))  # one row each
    return out


def stepped(weights: dict[str, float], status: str, expert: Mapping[str, float] | None, own: Mapping[str, float]) -> dict[str, float]:
    """one event's step: expert scores where there are some, else the hypothesis's own; clipped and normalised."""
    confirmed, w = status == "confirmed", dict(weights)
    for c, s in (expert or own).items():
        if c not in w or s is None:
            continue
        up, down = (EXPERT_STEP, EXPERT_STEP) if expert else (STATUS_STEP, STATUS_STEP / 2)
        if confirmed and s >= 7:
            w[c] = min(w[c] + up, HIGH)
        elif not confirmed and (s <= 3 if expert else s >= 7):
            w[c] = max(w[c] - down, LOW)
    total = sum(w.values())
    return {c: v / total for c, v in w.items()} if total > 0 else dict(lx.RANKING_WEIGHTS)


def fold_weights(events: DataFrame, key: str = "tenant", start: DataFrame | None = None) -> DataFrame:
    """each tenant's weights after its events in order of (ts, event_id), and how many there were. The order matters, so
    that a tenant is one fold; its events arrive sorted, batch by batch, and only the weights are held. An event with expert
    scores (columns expert_<criterion>, where events have them) moves the weights by these alone. start: an earlier result,
    from which the fold goes on."""
    experts = [f"expert_{c}" for c in CRITERIA if f"expert_{c}" in events.columns]
    cols = [key, "ts", "event_id", "status", *CRITERIA, *experts]
    rows = events.select(*cols, F.lit(None).cast("long").alias("__n"))
    if start is not None:
        fields = {f.name: f.dataType for f in rows.schema}
        own = {c: F.col(c).cast("double") for c in CRITERIA} | {key: F.col(key), "status": F.lit("start"), "__n": F.col("n")}
        rows = start.select(*[own.get(c, F.lit(None)).cast(fields[c]).alias(c) for c in rows.columns]).union(rows)
    rows = rows.repartition(key).sortWithinPartitions(key, F.col("__n").isNull(), "ts", "event_id")
    out = f"{key} {events.schema[key].dataType.simpleString()}, n long, " + ", ".join(f"{c} double" for c in CRITERIA)

    def fold(batches):
        import pandas as pd

        now, n, w, done, begun = None, 0, {}, [], False
        for b in batches:
            for r in b.itertuples(index=False):
                if begun and r[0] != now:
                    done.append((now, n, *(w[c] for c in CRITERIA)))
                if not begun or r[0] != now:
                    now, n, w, begun = r[0], 0, dict(lx.RANKING_WEIGHTS), True
                own = dict(zip(CRITERIA, r[4 : 4 + len(CRITERIA)], strict=True))
                if not pd.isna(r[-1]):
                    w, n = own, int(r[-1])
                    continue
                given = {c.removeprefix("expert_"): v for c, v in zip(cols[4:], r[4:], strict=False) if c in experts and not pd.isna(v)}
                w = stepped(w, r[3], given or None, {c: (None if pd.isna(v) else v) for c, v in own.items()})
                n += 1
        if begun:
            done.append((now, n, *(w[c] for c in CRITERIA)))
        yield pd.DataFrame(done, columns=[key, "n", *CRITERIA])

    return rows.mapInPandas(fold, out)


def profile_step(averages: DataFrame, weights: Mapping[str, float] = lx.RANKING_WEIGHTS, rate: float = EXPERT_STEP, least: float = 0.15) -> DataFrame:
    """(criterion, weight) after a step by the gap between the buckets' averages."""
    spark = averages.sparkSession
    w = spark.createDataFrame([(c, float(v)) for c, v in weights.items()], "criterion string, weight double")
    c, r = (averages.filter(F.col("bucket") == b).select("criterion", F.col("average").alias(b)) for b in ("confirmed", "rejected"))
    gap = (F.col("confirmed") - F.col("rejected")) / 10
    step = F.when(F.abs(gap) > least, F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.col("weight") + rate * gap))).otherwise(F.col("weight"))
    moved = w.join(c, "criterion", "left").join(r, "criterion", "left").select("criterion", step.alias("weight"))
    return moved.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(1))))


def patch_weights(weights: DataFrame, patch: DataFrame) -> DataFrame:
    """new values where given, normalised; weights and patch: criterion, weight."""
    m = weights.join(patch.withColumnRenamed("weight", "new"), "criterion", "left").select("criterion", F.coalesce("new", "weight").alias("weight"))
    total = F.sum("weight").over(Window.partitionBy(F.lit(1)))
    return m.withColumn("weight", F.when(total > 0, F.col("weight") / total).otherwise(F.lit(1.0 / len(CRITERIA))))


def counters(events: DataFrame) -> DataFrame:
    """reviews that are still open count in neither."""
    return events.agg(F.count_if(F.col("status") == "confirmed").alias("confirmed_count"), F.count_if(F.col("status") == "rejected").alias("rejected_count"), F.count("*").alias("events"))
