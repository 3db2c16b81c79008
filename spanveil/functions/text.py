"""Column helpers on strings: matches with offsets, occurrences, folds of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "\x01"
SPAN = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with one more column that later filters and projections read but never repeat: its expression stays where it is."""
    return df.withColumn(name, F.explode_outer(F.array(value)))


def places(fenced: Column) -> Column:
    """Code point offsets at which marks stand, the marks themselves not counted, in ascending order. Linear in the text."""
    plain = F.regexp_replace(fenced, f"(?s)[^{MARK}]", ".")  # one unit a code point
    at = F.filter(F.transform(F.split(plain, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: x["c"] == MARK)
    return F.transform(at, lambda x, k: x["i"] - k)


def starts_of(text: Column, pattern) -> Column:
    """Offsets at which a pattern (text or column) matches, overlapping matches included."""
    ahead = F.lit(f"(?={pattern})") if isinstance(pattern, str) else F.concat(F.lit("(?="), pattern, F.lit(")"))
    return places(F.regexp_replace(F.translate(text, MARK, " "), ahead, F.lit(MARK)))


def quoted(value: Column) -> Column:
    """A pattern that matches a string itself."""
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def find_all(text: Column, pattern: str, before: str | None = None) -> Column:
    """Non-overlapping matches with code point offsets, leftmost first: array<struct<start, end, value>>.

    With `before`, a match is that pattern followed by `pattern`, and the span is the latter part. The matches are fenced
    with a mark and the text split at it, so odd pieces are the matches; a mark already in the text counts as a blank.
    """
    clean = F.translate(text, MARK, " ")
    fenced = F.regexp_replace(clean, f"({before})({pattern})", f"$1{MARK}$2{MARK}") if before else F.regexp_replace(clean, pattern, f"{MARK}$0{MARK}")

    def spans(f: Column) -> Column:
        own = F.struct(F.split(f, MARK).alias("p"), places(f).alias("at"))
        hit = lambda o, k: F.struct(F.get(o["at"], 2 * k).alias("start"), F.get(o["at"], 2 * k + 1).alias("end"), F.get(o["p"], 2 * k + 1).alias("value"))
        return let(own, lambda o: F.transform(F.sequence(F.lit(0), (F.size(o["at"]) / 2).cast("int") - 1), lambda k: hit(o, k)))

    gate = f"(?:{before})(?:{pattern})" if before else pattern
    return F.when(F.rlike(text, F.lit(gate)), let(fenced, spans)).otherwise(F.array().cast(SPAN))


def occurrences(text: Column, value: Column) -> Column:
    """0-based starts of all occurrences of a string, overlapping ones included."""
    return F.when((F.length(value) > 0) & F.contains(text, value), starts_of(text, quoted(value))).otherwise(F.array().cast("array<int>"))


def hamming(a: Column, b: Column) -> Column:
    """Differing positions of two strings of equal length."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def first_come(spans: Column, schema: str) -> Column:
    """Keeps each span of an ordered array that overlaps none kept before it; in order of their starts.

    Spans that touch no other need no comparison: in order of starts they fall apart into runs of overlapping ones, and only
    inside a run each is held against those kept.
    """
    entry = f"struct<start:int,end:int,i:int,x:{schema[6:-1]}>"
    none = F.array().cast(schema)

    def settled(run: Column) -> Column:
        ordered = F.array_sort(F.transform(run, lambda c: F.struct(c["i"].alias("i"), c["x"].alias("x"))))
        kept = F.aggregate(ordered, none, lambda acc, c: F.when(F.exists(acc, lambda y: overlaps(c["x"], y)), acc).otherwise(F.array_append(acc, c["x"])))
        return F.when(F.size(run) == 1, F.transform(run, lambda c: c["x"])).otherwise(kept)

    state = f"struct<reach:int,run:array<{entry}>,done:{schema}>"
    start = F.struct(F.lit(-1).alias("reach"), F.array().cast(f"array<{entry}>").alias("run"), none.alias("done")).cast(state)

    def step(s: Column, c: Column) -> Column:
        fresh = (c["start"] >= s["reach"]) & (F.size(s["run"]) > 0)
        return F.struct(
            F.greatest(s["reach"], c["end"]).alias("reach"),
            F.when(fresh, F.array(c)).otherwise(F.array_append(s["run"], c)).alias("run"),
            F.when(fresh, F.concat(s["done"], settled(s["run"]))).otherwise(s["done"]).alias("done"),
        ).cast(state)

    def runs(own: Column) -> Column:
        numbered = F.transform(own, lambda x, i: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), i.alias("i"), x.alias("x")))
        return F.aggregate(F.array_sort(numbered.cast(f"array<{entry}>")), start, step, lambda s: F.concat(s["done"], settled(s["run"])))

    return let(spans, lambda own: F.when(F.size(own) < 2, own).otherwise(runs(own)))


def upper_median(values: Column) -> Column:
    """The element at position n div 2 (from 0) of the sorted array."""
    return let(F.sort_array(values), lambda s: F.get(s, (F.size(s) / 2).cast("int")))
