"""Feedback event by event: the fold, the stream that keeps it as state, and both against a plain version."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from lithos.functions import lexicons as lx
from lithos.operators import feedback, learning
from lithos.streaming import flows

C = feedback.CRITERIA


def sample(spark, n=600, seed=4):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        scores = [r.choice([None, 0.0, 3.0, 5.5, 7.0, 9.0, 10.0]) for _ in C]
        expert = [r.choice([None, 2.0, 8.0]) if i % 7 == 0 else None for _ in C]
        text = f"{'common beginning ' * r.choice([0, 0, 5])}{r.choice('abcdefghij')} of {r.randrange(3)}" if i % 11 else None
        rows.append((r.choice([1, 1, 1, 2, 3, None]), i // 3, i, r.choice(["confirmed", "rejected", "needs_review"]), text, r.choice([None, "m" * 150]), r.choice([None, "", "why"]), *scores, *expert))
    kinds = ", ".join(f"{c} double" for c in (*C, *[f"expert_{c}" for c in C]))
    df = spark.createDataFrame(rows, f"tenant long, ts long, event_id long, status string, text string, mechanism string, comment string, {kinds}")
    return df.withColumn("ts", F.timestamp_seconds("ts"))


def plain(events, repeats=True):
    """As a loop over dicts."""
    states = {}
    for e in sorted(events, key=lambda e: (e["ts"], e["event_id"])):
        s = states.setdefault(e["tenant"], {"w": dict(lx.RANKING_WEIGHTS), "p": defaultdict(list), "confirmed": [], "rejected": [], "n": 0, "counts": defaultdict(int)})
        s["n"] += 1
        ok = e["status"] == "confirmed"
        expert = {c: e[f"expert_{c}"] for c in C if e[f"expert_{c}"] is not None}
        for c, v in (expert or {c: e[c] for c in C if e[c] is not None}).items():
            if expert:
                s["w"][c] = min(s["w"][c] + 0.05, 0.5) if ok and v >= 7 else max(s["w"][c] - 0.05, 0.05) if not ok and v <= 3 else s["w"][c]
            elif v >= 7:
                s["w"][c] = min(s["w"][c] + 0.02, 0.5) if ok else max(s["w"][c] - 0.01, 0.05)
        total = sum(s["w"].values())
        s["w"] = {c: v / total for c, v in s["w"].items()}
        for c in C:
            if e[c] is not None:
                s["p"]["confirmed" if ok else "rejected", c].append(e[c])
        if e["status"] in ("confirmed", "rejected"):
            s["counts"][e["status"]] += 1
            text, note = e["text"] or "", (e["mechanism"] if ok else e["comment"]) or ""
            items = s[e["status"]]
            same = [i for i in items if i[0][:80] == text[:80]]
            if same:
                same[0][2] = same[0][2] + 1 if repeats else 1
                same[0][1] = note[: 120 if ok else 200] or same[0][1]
            else:
                items.insert(0, [text[: 220 if ok else 180], note[: 120 if ok else 200], 1])
                items[5:] = []
        mean = {k: sum(v) / len(v) for k, v in s["p"].items()}
        if any(k[0] == "confirmed" for k in mean) and any(k[0] == "rejected" for k in mean):
            for c in C:
                if ("confirmed", c) in mean and ("rejected", c) in mean:
                    gap = (mean["confirmed", c] - mean["rejected", c]) / 10
                    if abs(gap) > 0.15:
                        s["w"][c] = max(0.05, min(0.5, s["w"][c] + 0.05 * gap))
            total = sum(s["w"].values())
            s["w"] = {c: v / total for c, v in s["w"].items()}
    return {
        t: (s["n"], s["counts"]["confirmed"], s["counts"]["rejected"], [round(s["w"][c], 9) for c in C], s["confirmed"], s["rejected"], round(sum(s["p"]["rejected", "risk"]), 9))
        for t, s in states.items()
    }


def as_plain(df):
    out = {}
    for r in df.collect():
        lists = [[[i["text"], i["note"], i["n"]] for i in r[k]] for k in ("exemplars", "anti_patterns")]
        out[r["tenant"]] = (r["n"], r["confirmed_count"], r["rejected_count"], [round(r[c], 9) for c in C], *lists, round(r["rejected_risk_total"], 9))
    return out


def test_learned(spark):
    events = sample(spark)
    rows = [r.asDict() for r in events.collect()]
    for repeats in (True, False):
        assert as_plain(learning.learned(events, count_repeats=repeats)) == plain(rows, repeats)
    middle = 80
    first = learning.learned(events.filter(F.unix_seconds("ts") < middle))
    assert as_plain(learning.learned(events.filter(F.unix_seconds("ts") >= middle), start=first)) == plain(rows)
    assert learning.learned(events.limit(0)).count() == 0


def test_evictions_differ_from_the_aggregate(spark):
    """Texts that were put out come back as new, and repeated ones do not move: the aggregate form shows neither."""
    letters = "abcdefa" + "bb"
    rows = [(1, i, i, "confirmed", x) for i, x in enumerate(letters)]
    events = spark.createDataFrame(rows, "tenant long, ts long, event_id long, status string, text string").withColumn("ts", F.timestamp_seconds("ts"))
    got = [(r["text"], r["n"]) for r in learning.listed(learning.learned(events)).orderBy("rank").collect()]
    assert got == [("b", 2), ("a", 1), ("f", 1), ("e", 1), ("d", 1)]
    assert [(r["prefix"], r["n"]) for r in feedback.exemplars(events).orderBy("rank").collect()] != got


def test_stream(spark, tmp_path):
    """k files, two runs from one checkpoint, an event file twice in the folder's listing: what one fold gives."""
    events = sample(spark)
    inbox, states, checkpoint = (str(tmp_path / x) for x in ("in", "states", "checkpoint"))
    schema = events.schema
    bounds = [0, 60, 100, 400]
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        events.filter((F.unix_seconds("ts") >= low) & (F.unix_seconds("ts") < high)).coalesce(1).write.mode("append").parquet(inbox)
        if low != 60:  # the second and the third file come in one run
            flows.learning_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox), states, checkpoint).awaitTermination()
    want = as_plain(learning.learned(events))
    assert as_plain(flows.current_states(spark, states)) == want
    flows.learning_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox), states, checkpoint).awaitTermination()  # nothing new
    assert as_plain(flows.current_states(spark, states)) == want


def test_stream_goes_on_from_a_table(spark, tmp_path):
    events = sample(spark, 200)
    inbox = str(tmp_path / "in")
    first = learning.learned(events.filter(F.unix_seconds("ts") < 30))
    events.filter(F.unix_seconds("ts") >= 30).write.parquet(inbox)
    flows.learning_stream(spark.readStream.schema(events.schema).parquet(inbox), str(tmp_path / "states"), str(tmp_path / "cp"), start=first).awaitTermination()
    want = {k: v for k, v in as_plain(learning.learned(events)).items()}
    got = as_plain(flows.current_states(spark, str(tmp_path / "states")))
    assert got == {k: want[k] for k in got} and len(got) == len(want)
