"""Options and the one-call form: documents in; redacted lines, report items and aliases out."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil import catalog
from spanveil.operators import engine, lines, redact
from spanveil.session import keep

VERSION = "0.1"


class OptionsError(ValueError):
    """Code INVALID_OPTIONS."""


@dataclass(frozen=True)
class Options:
    entities: frozenset[str] = frozenset(catalog.CODES)
    default_style: str | None = None
    styles: dict[str, str] = field(default_factory=dict)
    custom_words: tuple[str, ...] = ()
    mode: str = "balanced"
    label_text: str = "type"
    dpi: int = 200
    verify: str | bool = "auto"
    keep_source: bool = False


def parse_options(text: str | None) -> Options:
    """Options from JSON. Unknown entities and styles are errors; other odd values fall back to their defaults."""
    if not text:
        return Options()
    try:
        given = json.loads(text)
    except json.JSONDecodeError as e:
        raise OptionsError("not JSON") from e
    entities = given.get("entities", catalog.CODES)
    styles = given.get("styles", {})
    if unknown := sorted((set(entities) | set(styles)) - set(catalog.CODES)):
        raise OptionsError(f"unknown entities: {', '.join(unknown)}")
    default = given.get("default_style")
    if bad := [s for s in [*styles.values(), *([default] if default is not None else [])] if s not in catalog.STYLES]:
        raise OptionsError(f"unknown styles: {', '.join(map(str, bad))}")
    one_of = lambda key, allowed, fallback: given[key] if given.get(key) in allowed else fallback
    words = [w.strip() for w in given.get("custom_words", []) if isinstance(w, str)]
    verify = given.get("verify", "auto")
    return Options(
        entities=frozenset(entities), default_style=default, styles=dict(styles), custom_words=tuple([w for w in words if len(w) >= 2][:500]),
        mode=one_of("mode", ("strict", "balanced"), "balanced"), label_text=one_of("label_text", ("type", "alias"), "type"), dpi=one_of("dpi", (150, 200, 300), 200),
        verify="auto" if verify == "auto" else bool(verify), keep_source=bool(given.get("keep_source", False)),
    )


def health() -> dict:
    return {"version": VERSION, "entities": len(catalog.CODES), "styles": len(catalog.STYLES)}


@dataclass
class Result:
    lines: DataFrame
    items: DataFrame
    aliases: DataFrame


def run(docs: DataFrame, options: Options = Options()) -> Result:  # noqa: B008 - frozen
    """docs (doc_id, text). Rules, custom words and propagation, then aliases and redaction; only `aliases` holds values.

    Hits are few against lines: they are found once, written to the shared folder, and read by all steps behind.
    """
    enabled = sorted(options.entities)
    own = lines.text_lines(docs, "doc_id")
    hits = engine.rule_hits(own, enabled)
    if options.custom_words and "CUSTOM" in options.entities:
        listed = docs.sparkSession.createDataFrame([(w,) for w in options.custom_words], "word string")  # at most 500 rows
        hits = hits.unionByName(engine.listed_hits(own, listed))
    hits = keep(hits, "hits")
    # Custom words need no seeds: all their occurrences are hits already.
    seeds = engine.collect_seeds(engine.ranked(hits).withColumn("seed", F.col("source") != "custom"), enabled=enabled)
    hits = hits.unionByName(keep(engine.propagate(own, seeds, hits), "further"))
    names = engine.aliases(engine.ranked(hits))
    with_alias = hits.join(names, ["doc_id", "type", "value"], "left")
    chosen = F.try_element_at(F.create_map(*[F.lit(x) for kv in options.styles.items() for x in kv]), F.col("type")) if options.styles else F.lit(None).cast("string")
    style = catalog.resolve_style(F.col("type"), chosen, F.lit(options.default_style).cast("string"))
    return Result(redact.redact_lines(own, with_alias, style).select(*engine.KEY, "redacted"), redact.report_items(hits), names)
