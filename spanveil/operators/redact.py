"""Redacted text and value-free reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.catalog import label_of
from spanveil.functions.geometry import normalised
from spanveil.functions.text import bind
from spanveil.operators import rules
from spanveil.operators.engine import KEY
from spanveil.operators.lines import synthetic_box

#: Styles that keep a line's length fill each character of a span.
FILL = {"black": "█", "background": " ", "hatch": "/", "mosaic": "▒"}


def replacement(style: Column, kind: Column, alias: Column, n: Column) -> Column:
    """What stands for a span of n characters: its label in brackets, its alias, a fill, or nothing."""
    out = F.when(style == "replace", F.coalesce(alias, label_of(kind))).when(style == "inpaint", F.lit(""))
    for name, ch in FILL.items():
        out = out.when(style == name, F.repeat(F.lit(ch), n))
    return out.otherwise(F.concat(F.lit("["), label_of(kind), F.lit("]")))


_PIECE = "struct<a:int,b:int,put:string>"


def put_into(text: Column, spans: Column) -> Column:
    """text with spans (struct<start, end, put>, ordered by start, possibly overlapping) replaced: a span starts where the one before it ended."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_PIECE}>").alias("out")).cast(f"struct<at:int,out:array<{_PIECE}>>")

    def step(s: Column, x: Column) -> Column:
        kept = F.struct(s["at"].alias("a"), F.greatest(x["start"], s["at"]).alias("b"), F.when(x["start"] >= s["at"], x["put"]).otherwise(F.lit("")).alias("put"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.array_append(s["out"], kept.cast(_PIECE)).alias("out")).cast(f"struct<at:int,out:array<{_PIECE}>>")

    def put_together(s: Column) -> Column:
        """What is kept before each span and what the span becomes, then the rest."""
        parts = F.transform(s["out"], lambda p: F.concat(F.substring(text, p["a"] + 1, p["b"] - p["a"]), p["put"]))
        return F.array_join(F.array_append(parts, F.substring(text, s["at"] + 1, F.length(text))), "")

    return F.aggregate(spans, start, step, put_together)


def redact_lines(lines: DataFrame, hits: DataFrame, style: Column | None = None) -> DataFrame:
    """lines with `redacted`. hits (KEY, start, end, type[, alias]) may overlap. Lines without hits pass unchanged.

    For hits that come from elsewhere than the line itself, such as propagated ones; `redact_own` needs no join.
    """
    with_alias = hits if "alias" in hits.columns else hits.withColumn("alias", F.lit(None).cast("string"))
    put = replacement(style if style is not None else F.lit("label"), F.col("type"), F.col("alias"), F.col("end") - F.col("start"))
    spans = with_alias.select(*KEY, F.struct(F.col("start").alias("start"), F.col("end").alias("end"), put.alias("put")).alias("s"))
    per_line = spans.groupBy(*KEY).agg(F.sort_array(F.collect_list("s")).alias("spans"))
    text = F.col("text")
    return lines.join(per_line, KEY, "left").withColumn("redacted", F.coalesce(put_into(text, F.col("spans")), text)).drop("spans")


def redacted_by_rules(text: Column, hits: Column, style: Column | None = None) -> Column:
    """text with the hits of `rules.find` replaced, in the row itself; hits of a line don't overlap."""
    put = lambda h: replacement(style if style is not None else F.lit("label"), h["type"], F.lit(None).cast("string"), h["end"] - h["start"])
    spans = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), put(h).alias("put"))))
    return F.when(F.size(hits) > 0, put_into(text, spans)).otherwise(text)


def redact_own(lines: DataFrame, style: Column | None = None, only: frozenset[int] | None = None) -> DataFrame:
    """lines with `redacted`: what the rules, or `only` those of some priorities, find in a line is replaced in its own row; no shuffle."""
    found = bind(lines, "__hits", rules.find(F.col("text"), only))
    return found.withColumn("redacted", redacted_by_rules(F.col("text"), F.col("__hits"), style)).drop("__hits")


def residual(lines: DataFrame, style: Column | None = None, only: frozenset[int] | None = None) -> DataFrame:
    """type, before, residual: hits of each type, and those that the rules, or `only` those of some priorities, find in the redacted lines; both in a line's own row."""
    found = bind(lines, "__hits", rules.find(F.col("text"), only)).where(F.size("__hits") > 0)
    again = rules.find(redacted_by_rules(F.col("text"), F.col("__hits"), style if style is not None else F.lit("black")), only)
    kinds = lambda hits, left: F.transform(hits, lambda h: F.struct(h["type"].alias("type"), F.lit(left).alias("left")))
    each = found.select(F.explode(F.concat(kinds(F.col("__hits"), 0), kinds(again, 1))).alias("h"))
    return each.groupBy(F.col("h.type").alias("type")).agg(F.count_if(F.col("h.left") == 0).alias("before"), F.count_if(F.col("h.left") == 1).alias("residual"))


def report_items(hits: DataFrame, width: float = 1200.0, height: float = 1700.0) -> DataFrame:
    """doc_id, page (from 1), type, source, box as page shares; no values."""
    box = synthetic_box(F.col("line"), F.col("start"), F.col("end") - F.col("start"))
    share = normalised(box, F.lit(width), F.lit(height))
    return hits.select("doc_id", (F.col("page") + 1).cast("long").alias("page"), "type", "source", share.alias("box"))


def page_meta(items: DataFrame) -> DataFrame:
    """Number of items per page, per document (page null), and in all (both null)."""
    return items.rollup("doc_id", "page").agg(F.count("*").alias("n"))


def counts(items: DataFrame, *keys: str) -> DataFrame:
    return items.groupBy(*keys, "type").agg(F.count("*").alias("n"))


def report_json(items: DataFrame) -> DataFrame:
    """doc_id, report: one JSON text per document with its counts and items, without values."""
    per_type = items.groupBy("doc_id", "type").agg(F.count("*").alias("n"))
    totals = per_type.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("counts"))
    listed = items.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "type", "source", "box"))).alias("items"))
    return totals.join(listed, "doc_id").select("doc_id", F.to_json(F.struct("counts", "items")).alias("report"))


def report_summary(reports: DataFrame) -> DataFrame:
    """What listings carry of reports (job_id, pages, counts, elapsed_sec, output, verification, visual_verification struct<status, pages, findings,
    model_version>, visual_concerns): states and counts, no coordinates."""
    check = F.col("visual_verification")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    short = F.when(check.isNotNull(), F.struct(check["status"].alias("status"), check["pages"].alias("pages"), check["model_version"].alias("model_version"), size(check["findings"]).alias("findings_count")))
    return reports.select("job_id", "pages", "counts", "elapsed_sec", "output", "verification", short.alias("visual_verification"), size(F.col("visual_concerns")).alias("visual_concerns_count"))


def audit(entries: DataFrame, path: str) -> None:
    """Append export records (event, job_id, pages, boxes) to a log of JSON lines, with the time and nothing of any content."""
    entries.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssZ").alias("time"), "event", "job_id", "pages", "boxes").write.mode("append").json(path)


def evidence_status(enabled: Column, applicable: Column, pages_in: Column, pages_out: Column, residual: Column) -> Column:
    """Outcome of checking the output with a model: disabled, not_applicable, error on a page mismatch, review, passed."""
    return (
        F.when(~enabled, "disabled").when(~applicable, "not_applicable").when(pages_in != pages_out, "error").when(residual > 0, "review").otherwise("passed")
    )


def verify_page(mode: Column, text_source: Column) -> Column:
    """Whether a page is read again: all, those without a text layer, or none."""
    return F.when(mode == "true", True).when(mode == "auto", text_source != "text").otherwise(False)
