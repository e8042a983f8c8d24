"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, mix64, parquet, partitions, tidy

#: Two primes below 2^31 and a base for each: products of a power and a code point fit in 64 bits.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: A fingerprint has the prefix hashes at so many places at most.
PLACES = 64
#: The code points before a place that decide whether it is taken.
WINDOW = 8
ORDERS = 1 << 31

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_inverse = [np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of the bases; the tables double as longer texts come."""
    for k, (p, b) in enumerate(zip(PRIMES, BASES, strict=True)):
        while len(_powers[k]) < n:
            have = _powers[k]
            _powers[k] = np.concatenate([have, have * np.uint64(pow(b, len(have), p)) % np.uint64(p)])
    return _powers


def inverse_powers(n: int) -> np.ndarray:
    """Powers of the first base's inverse modulo the first prime: they move a span's hash to place 0."""
    p, b = PRIMES[0], pow(BASES[0], -1, PRIMES[0])
    while len(_inverse[0]) < n:
        have = _inverse[0]
        _inverse[0] = np.concatenate([have, have * np.uint64(pow(b, len(have), p)) % np.uint64(p)])
    return _inverse[0]


def terms(text: str, first: int = 0) -> np.ndarray:
    """(code point + 1) x base^place modulo each prime; the text begins at place `first`."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(points)
    table = powers(first + n)
    return np.stack([points * table[k][first : first + n] % np.uint64(p) for k, p in enumerate(PRIMES)]) if n else np.zeros((2, 0), np.uint64)


class PrefixHash:
    """Modular prefix arrays of one text: equality of any two spans, and their longest common extension."""

    def __init__(self, text: str) -> None:
        t = terms(text)
        self.n = t.shape[1]
        self.sums = np.concatenate([np.zeros((2, 1), np.uint64), np.cumsum(t, axis=1)], axis=1) % np.array(PRIMES, np.uint64)[:, None]

    def span(self, at: int, length: int, up: int) -> tuple[int, ...]:
        """The span's hash, multiplied by base^up."""
        return tuple((int(self.sums[k][at + length]) - int(self.sums[k][at])) * pow(BASES[k], up, p) % p for k, p in enumerate(PRIMES))

    def equal(self, at: int, other: PrefixHash, there: int, length: int) -> bool:
        return self.span(at, length, there) == other.span(there, length, at)

    def extension(self, at: int, other: PrefixHash, there: int) -> int:
        """Length of the longest common span that begins at `at` here and at `there` in other."""
        lo, hi = 0, min(self.n - at, other.n - there)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.equal(at, other, there, mid) else (lo, mid - 1)
        return lo


class Fingerprint:
    """Length, whole hash, and the prefix hashes (modulo the first prime) at places that the content chooses.

    A place ends a window of WINDOW code points; the windows whose mixed hashes are the least of the whole
    text are taken, PLACES - 1 at most, and the text's end. An edit moves only the places at it, however
    it shifts those behind. In a run of a window that repeats within n / PLACES code points (rounded up to
    a power of two), the number in the run is mixed in and
    one window of a period can be taken, so that periodic texts have places as well.
    """

    def __init__(self, n: int, whole: tuple[int, int], bound: int, places: np.ndarray, prefixes: np.ndarray, windows: np.ndarray, orders: np.ndarray) -> None:
        self.n, self.whole, self.bound = n, whole, bound
        self.places, self.prefixes, self.windows, self.orders = places, prefixes, windows, orders

    @classmethod
    def of(cls, t: np.ndarray) -> Fingerprint:
        """From terms()."""
        n, p = t.shape[1], np.uint64(PRIMES[0])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(t[0])]) % p
        whole = (int(sums[n]), int(t[1].sum() % np.uint64(PRIMES[1])))
        m = max(0, n - WINDOW + 1)
        windows = (sums[WINDOW:] + p - sums[:m]) % p * inverse_powers(m)[:m] % p if m else np.zeros(0, np.uint64)
        orders = _orders(windows, n)
        bound = ORDERS
        if m >= PLACES:
            bound = int(np.partition(orders, PLACES - 1)[PLACES - 1])
        at = np.flatnonzero(orders[: m - 1] < bound) if m else np.zeros(0, np.int64)  # the last window ends the text
        places = np.append(at + WINDOW, n)
        last = windows[-1:] if m else np.zeros(1, np.uint64)
        return cls(n, whole, bound, places, sums[places].astype(np.int64), np.append(windows[at], last).astype(np.int64), np.append(orders[at], 0).astype(np.int64))

    def __str__(self) -> str:
        data = np.concatenate([[*self.whole, self.bound], self.places, self.prefixes, self.windows, self.orders])
        return f"{self.n}:{base64.b64encode(data.astype('<u4').tobytes()).decode()}"

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        n, data = int(text.split(":")[0]), np.frombuffer(base64.b64decode(text.split(":")[1]), "<u4").astype(np.int64)
        return cls(n, (int(data[0]), int(data[1])), int(data[2]), *data[3:].reshape(4, -1))

    def spans(self, bound: int) -> Counter:
        """How often each span between neighbouring places of an order under bound stands: its length, its
        hash as if it stood at 0, and the window that it ends with."""
        keep = self.orders < bound
        keep[-1] = True
        ends, sums = self.places[keep], self.prefixes[keep]
        starts = np.append(0, ends[:-1])
        moved = (sums - np.append(0, sums[:-1])) % PRIMES[0] * inverse_powers(self.n + 1)[starts].astype(np.int64) % PRIMES[0]
        return Counter(zip((ends - starts).tolist(), moved.tolist(), self.windows[keep].tolist(), strict=True))

    def likeness(self, other: Fingerprint) -> float:
        """Share of the longer text in spans that both have, wherever they stand, 0 to 1.

        Places count where both texts would take them: the one with more of its windows taken gives up
        those beyond the other's bound. A span shorter than a window needs the same window before its end.
        """
        if (self.n, self.whole) == (other.n, other.whole):
            return 1.0
        bound = min(self.bound, other.bound)
        both = self.spans(bound) & other.spans(bound)
        return sum(key[0] * times for key, times in both.items()) / max(self.n, other.n)


def _orders(windows: np.ndarray, n: int) -> np.ndarray:
    """A number from 0 to ORDERS - 1 for each window: its mixed hash, into which its number in a run of equal windows goes."""
    mixed = mix64(windows + np.uint64(1))
    near = 1
    while n > near * PLACES:
        near *= 2
    low = np.uint64(max(1, len(windows)).bit_length())
    mask = (np.uint64(1) << low) - np.uint64(1)
    ranked = np.sort((mixed & ~mask) | np.arange(len(windows), dtype=np.uint64))
    at = (ranked & mask).astype(np.int64)
    goes_on = np.append(False, (ranked[1:] >> low == ranked[:-1] >> low) & (np.diff(at) <= near))[: len(windows)]
    if goes_on.any():
        i = np.arange(len(windows))
        number = i - np.maximum.accumulate(np.where(goes_on, 0, i))
        again = at[goes_on]
        first = mixed[again] == _least(mixed, near)[again]  # one window of a period, or its windows' places drift apart
        mixed[again] = mix64(mixed[again] + number[goes_on].astype(np.uint64))
        orders = (mixed >> np.uint64(33)).astype(np.int64)
        orders[again[~first]] = ORDERS
        return orders
    return (mixed >> np.uint64(33)).astype(np.int64)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each item and the width - 1 before it."""
    blocks = np.concatenate([x, np.full(-len(x) % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()[: len(x)]
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    out = ahead.copy()
    out[width - 1 :] = np.minimum(ahead[width - 1 :], behind[: max(0, len(x) - width + 1)])
    return out


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_following(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in buckets of descending doc_id: __bucket, __extra, doc_id, text.

    A bucket ends with the first document of the next one (the last bucket: of the first one) as an
    extra row, so that each task finds every document's follower. Null ids come last; ties by text.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    docs = docs.select(F.col("doc_id").cast("long"), "text").withColumn("__key", key)
    n = 4 * partitions(spark)
    cuts = docs.agg(F.percentile_approx("__key", [i / n for i in range(1, n)], 20 * n)).first()[0]
    bounds = sorted(set(cuts or []))
    docs = docs.withColumn("__bucket", bucket_of(F.col("__key"), bounds))
    heads = sorted(((r[0], r[1]) for r in docs.groupBy("__bucket").agg(F.max("__key")).collect()), reverse=True)  # 4 x partitions rows at most
    following = [(heads[(i + 1) % len(heads)][1], b) for i, (b, _) in enumerate(heads)]
    extra = spark.createDataFrame(following, "__key long, __bucket int")
    extras = docs.drop("__bucket").join(F.broadcast(extra), "__key").select("doc_id", "text", "__key", "__bucket", F.lit(1).alias("__extra"))
    rows = docs.withColumn("__extra", F.lit(0)).select("doc_id", "text", "__key", "__bucket", "__extra").union(extras)
    return rows.repartition("__bucket").sortWithinPartitions("__bucket", "__extra", F.desc("__key"), "text").select("__bucket", "__extra", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of docs (doc_id, text) and of their edited texts, and their likeness.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all)
    of the next document by descending doc_id (null last; after the last: the first). Null texts are
    empty; two empty texts are alike (1.0); repeated rows stand next to each other; a single document
    follows itself; an empty df gives no rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, bucket, out = None, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                b, extra, doc_id, text = (batch.column(c)[i].as_py() for c in range(4))
                if b != bucket:
                    before, bucket = None, b
                    closed = False
                if extra and closed:
                    continue
                t = terms(text or "")
                print_ = Fingerprint.of(t)
                if before is not None:
                    out.append(_row(*before, text or "", print_))
                before, closed = (None if extra else (doc_id, text or "", t, print_)), bool(extra)
                if len(out) == 500:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    return with_following(docs).mapInArrow(tidy(run), OUT)


def _row(doc_id: int | None, text: str, t: np.ndarray, own: Fingerprint, following: str, following_print: Fingerprint) -> tuple:
    n, k = len(text), len(text) // 3
    new = following[:k]
    edited = text[: n - k] + new
    changed = Fingerprint.of(np.concatenate([t[:, : n - k], terms(new, n - k)], axis=1))
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, n, sha, str(own), str(changed), own.likeness(changed), own.likeness(following_print)


_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], [x.split()[0] for x in OUT.split(", ")])


def op8_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(parquet(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op8_prefix_fingerprints": op8_prefix_fingerprints}
ORACLE_SQL: dict[str, str] = {}
