"""All that feedback teaches, taken event by event in order (F05 exact, F07 with F08, counters, profiles).

What is learned depends on the order, so a key (tenant) is one fold. Its state is small and bounded: weights, counters,
sums of scores, and two lists of at most KEEP items. learned() folds a table; LearningProcessor is the same fold for a stream.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.functions import lexicons as lx

from .feedback import CRITERIA, EXPERT_STEP, HIGH, LOW, stepped

if TYPE_CHECKING:
    import pandas as pd

KEEP = 5
#: Texts that begin alike up to here are one item.
HEAD = 80
#: What is kept of a text and of its note (mechanism or comment), for exemplars and for anti-patterns.
LENGTHS = {"confirmed": (220, 120), "rejected": (180, 200)}
LEAST_GAP = 0.15
BUCKETS = ("confirmed", "rejected")
ITEM = "array<struct<text:string,note:string,n:long>>"
COLUMNS = ["ts", "event_id", "status", "text", "mechanism", "comment", *CRITERIA, *[f"expert_{c}" for c in CRITERIA]]


def state_schema(key: str, kind: str) -> str:
    sums = ", ".join(f"{b}_{c}_total double, {b}_{c}_n long" for b in BUCKETS for c in CRITERIA)
    return f"{key} {kind}, n long, confirmed_count long, rejected_count long, {', '.join(f'{c} double' for c in CRITERIA)}, {sums}, exemplars {ITEM}, anti_patterns {ITEM}"


@dataclass
class Learned:
    """One key's state."""

    n: int = 0
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(BUCKETS, 0))
    weights: dict[str, float] = field(default_factory=lambda: dict(lx.RANKING_WEIGHTS))
    sums: dict[tuple[str, str], list] = field(default_factory=lambda: {(b, c): [0.0, 0] for b in BUCKETS for c in CRITERIA})
    items: dict[str, list[list]] = field(default_factory=lambda: {b: [] for b in BUCKETS})

    def learn(self, event: Mapping[str, Any], count_repeats: bool = True) -> None:
        """One event: the weights' step, the profile of its bucket, its list, then the step by the profiles' gap."""
        status, own = event["status"], {c: event.get(c) for c in CRITERIA}
        expert = {c: event.get(f"expert_{c}") for c in CRITERIA if event.get(f"expert_{c}") is not None}
        self.weights = stepped(self.weights, status, expert or None, own)
        bucket = "confirmed" if status == "confirmed" else "rejected"  # reviews are in the second profile, but in no list
        for c, s in own.items():
            if s is not None:
                slot = self.sums[bucket, c]
                slot[0] += s
                slot[1] += 1
        if status in BUCKETS:
            self.counts[status] += 1
            self._list(status, event.get("text") or "", (event.get("mechanism" if status == "confirmed" else "comment")) or "", count_repeats)
        self._by_profiles()
        self.n += 1

    def _list(self, status: str, text: str, note: str, count_repeats: bool) -> None:
        """A text that begins like one in the list counts there, and stays where it is; a new one comes first, and the last of
        more than KEEP goes. One that comes again after that is new."""
        long, short = LENGTHS[status]
        items = self.items[status]
        for item in items:
            if item[0][:HEAD] == text[:HEAD]:
                item[1], item[2] = note[:short] or item[1], item[2] + 1 if count_repeats else 1
                return
        items.insert(0, [text[:long], note[:short], 1])
        del items[KEEP:]

    def _by_profiles(self) -> None:
        means = {k: total / n for k, (total, n) in self.sums.items() if n}
        if not all(any((b, c) in means for c in CRITERIA) for b in BUCKETS):
            return
        w = dict(self.weights)
        for c in CRITERIA:
            if ("confirmed", c) in means and ("rejected", c) in means:
                gap = (means["confirmed", c] - means["rejected", c]) / 10
                if abs(gap) > LEAST_GAP:
                    w[c] = max(LOW, min(HIGH, w[c] + EXPERT_STEP * gap))
        total = sum(w.values())
        self.weights = {c: v / total for c, v in w.items()} if total > 0 else dict(lx.RANKING_WEIGHTS)

    def row(self) -> tuple:
        lists = [[{"text": t, "note": m, "n": n} for t, m, n in self.items[b]] for b in BUCKETS]
        return (self.n, *(self.counts[b] for b in BUCKETS), *(self.weights[c] for c in CRITERIA), *(x for b in BUCKETS for c in CRITERIA for x in self.sums[b, c]), *lists)

    @classmethod
    def of(cls, row: Mapping[str, Any]) -> Learned:
        """The state that a row (see row()) tells."""
        return cls(
            int(row["n"]), {b: int(row[f"{b}_count"]) for b in BUCKETS}, {c: float(row[c]) for c in CRITERIA},
            {(b, c): [float(row[f"{b}_{c}_total"]), int(row[f"{b}_{c}_n"])] for b in BUCKETS for c in CRITERIA},
            {b: [[i["text"], i["note"], int(i["n"])] for i in row[k]] for b, k in zip(BUCKETS, ("exemplars", "anti_patterns"), strict=True)},
        )


def with_columns(events: DataFrame, key: str) -> DataFrame:
    """events with the key and COLUMNS alone; those that are not there are null."""
    kinds = {"ts": "timestamp", "event_id": "long"} | dict.fromkeys(("status", "text", "mechanism", "comment"), "string")
    return events.select(key, *[(F.col(c) if c in events.columns else F.lit(None)).cast(kinds.get(c, "double")).alias(c) for c in COLUMNS])


def rows_of(part: pd.DataFrame) -> Iterable[dict]:
    """Rows as dicts, missing values as None."""
    part = part.astype(object)
    return part.where(part.notna(), None).to_dict("records")


def learned(events: DataFrame, key: str = "tenant", start: DataFrame | None = None, count_repeats: bool = True) -> DataFrame:
    """F05 exact, F07 and F08: a row for each key after its events in order of (ts, event_id): n, counters, weights, sums
    and numbers of scores by bucket and criterion, exemplars and anti_patterns (newest first).

    events: key, ts, event_id, status, text, the criteria, and, where there are any, mechanism, comment, expert_<criterion>.
    start: an earlier result, from which the fold goes on. Events arrive sorted, batch by batch; only a key's state is held.
    A null key is a key. With count_repeats=False an item's n stays 1, as a merge sets it anew.
    """
    kind = events.schema[key].dataType.simpleString()
    schema = state_schema(key, kind)
    rows = with_columns(events, key).withColumn("__state", F.lit(None).cast(f"struct<{_struct(schema)}>"))
    if start is not None:
        before = start.select(F.col(key).cast(kind).alias(key), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in COLUMNS], F.struct(*start.columns).cast(f"struct<{_struct(schema)}>").alias("__state"))
        rows = before.unionByName(rows)
    rows = rows.repartition(key).sortWithinPartitions(key, F.col("__state").isNull(), "ts", "event_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        now, state, done = None, None, []
        columns = [p.split()[0] for p in schema.replace("struct<text:string,note:string,n:long>", "item").split(", ")]
        for batch in batches:
            for r in rows_of(batch):
                if state is None or r[key] != now:
                    if state is not None:
                        done.append((now, *state.row()))
                    now, state = r[key], Learned()
                if r["__state"] is not None:
                    state = Learned.of(r["__state"])
                else:
                    state.learn(r, count_repeats)
            if done:
                yield pd.DataFrame(done, columns=columns)
                done = []
        if state is not None:
            yield pd.DataFrame([(now, *state.row())], columns=columns)

    return rows.mapInPandas(fold, schema)


def _struct(schema: str) -> str:
    return ",".join(f"{name}:{kind}" for name, kind in (p.split(" ", 1) for p in schema.split(", ")))


def listed(states: DataFrame, key: str = "tenant") -> DataFrame:
    """(key, status, rank, text, note, n) of the exemplars and anti-patterns of learned()."""
    both = F.array(*[F.struct(F.lit(s).alias("status"), F.col(c).alias("items")) for s, c in zip(BUCKETS, ("exemplars", "anti_patterns"), strict=True)])
    return states.select(key, F.explode(both).alias("b")).select(key, "b.status", F.posexplode("b.items").alias("at", "i")).select(key, "status", (F.col("at") + 1).alias("rank"), "i.text", "i.note", "i.n")
