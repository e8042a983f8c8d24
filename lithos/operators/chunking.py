"""Documents to overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.functions.text import let, normalize, strip

#: A unit ends at a blank line, or else behind a sentence.
PARAGRAPH = r"\n\s*\n+"
SENTENCE = r"(?<=[.!?…])\s+(?=[А-ЯA-Z0-9])"


def chunk_array(text: Column, size: int = 1200, overlap: int = 200) -> Column:
    """Units packed greedily to `size`; longer ones are cut at steps of size - overlap; then each chunk but
    the first is led by the last `overlap` characters of the one before. The time is linear in the text's length."""
    packed = let(normalize(F.coalesce(text, F.lit(""))), lambda t: _packed(t, size, overlap))
    if overlap <= 0:
        return packed

    def led(whole: Column, c: Column, i: Column) -> Column:
        before = F.element_at(whole, F.greatest(i, F.lit(1)))
        tail = F.when(F.length(before) > overlap, F.substring(before, -overlap, overlap)).otherwise(before)
        return F.when(i == 0, c).otherwise(F.substring(strip(F.concat(tail, F.lit("\n"), c)), 1, size + overlap))

    return let(packed, lambda whole: F.transform(whole, lambda c, i: led(whole, c, i)))


def _packed(text: Column, size: int, overlap: int) -> Column:
    units = let(F.split(text, PARAGRAPH), lambda p: F.when(F.size(p) > 1, p).otherwise(F.split(text, SENTENCE)))
    units = F.filter(F.transform(units, strip), lambda u: u != "")
    none = F.array().cast("array<string>")

    def pieces(u: Column) -> Column:
        n = F.ceil((F.length(u) - size) / F.lit(size - overlap)).cast("int")
        return F.filter(F.transform(F.sequence(F.lit(0), n), lambda i: strip(F.substring(u, i * (size - overlap) + 1, F.lit(size)))), lambda p: p != "")

    def add(done: Column, chunk: Column) -> Column:
        return F.when(chunk != "", F.array_append(done, chunk)).otherwise(done)

    def step(acc: Column, u: Column) -> Column:
        done, current = acc["done"], acc["current"]
        joined = F.when(current == "", u).otherwise(F.concat(current, F.lit("\n\n"), u))
        fits = F.length(u) + F.when(current == "", 0).otherwise(F.length(current) + 2) <= size
        state = lambda d, c: F.struct(d.alias("done"), c.alias("current"))
        return (
            F.when(F.length(u) > size, state(F.concat(add(done, current), pieces(u)), F.lit("")))
            .when(fits, state(done, joined))
            .otherwise(state(add(done, current), u))
        )

    packed = F.aggregate(units, F.struct(none.alias("done"), F.lit("").alias("current")), step, lambda acc: add(acc["done"], strip(acc["current"])))
    return F.when(text == "", none).when(F.length(text) <= size, F.array(text)).otherwise(packed)


def chunks(docs: DataFrame, size: int = 1200, overlap: int = 200, text: str = "text") -> DataFrame:
    """docs with a row for each chunk: chunk_index and the chunk in place of the text. Texts without content have none."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(chunk_array(F.col(text), size, overlap)).alias("chunk_index", text))
