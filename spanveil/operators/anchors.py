"""Values of form fields: labels on lines, the values after or beside them, and areas to check for ink.

Lines: doc_id, page, line, text, source (text or ocr), x0s and x1s (arrays, one entry a character), y0, y1, and, where known, scores and hs, the
characters' scores and heights; without them characters are sure and as high as their line.
Everything stays inside a line's row except what looks to the right, below or along a row, which are band joins within the page.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil import lexicon
from spanveil.functions.geometry import rect
from spanveil.functions.text import bind, find_all, let, starts_of, upper_median
from spanveil.functions.validators import looks_printed, surname_start, valid
from spanveil.operators.engine import KEY

LABELS = lexicon.labels()
STOPS = lexicon.stop_words()
# Words and signs around labels, and distances in heights of a line.
SIGN_SUFFIX = ["签名", "签字", "签章"]
SIGN_NOTES = "摁手印 按手印 捺手印 摁指印 按指印 手印 指印 捺印 签名 签字 签章 盖章 签名或盖章 签字或盖章".split()
ROLE_TAILS = ["医生", "医师", "护士"]
CHECKBOX = "☑□☐☒■✓√✔"
FAR_VALUE, FAR_NAME = 2.5, 10.0
SIGN_WIDTH, OTHER_WIDTH = 24.0, 8.0


def _any(words: list[str]) -> str:
    """Alternation, longest first. Words of one character count only as whole values, not as beginnings."""
    return "(?:" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)) if len(w) >= 2) + ")"


ANY_LABEL, ANY_STOP = _any(list(LABELS)), _any(STOPS)
_SEPS, _PUNCT = re.escape(lexicon.SEPARATORS), re.escape(lexicon.PUNCTUATION)
NEXT = "array<struct<start:int,end:int,next:int,label:string,type:string,weak:boolean,ok:boolean>>"


def kind_of(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind in dict.fromkeys(LABELS.values()):
        out = F.when(label.isin(*[w for w, k in LABELS.items() if k == kind]), kind).otherwise(out)
    return out


def height(y0: Column, y1: Column) -> Column:
    return F.greatest(y1 - y0, F.lit(1.0))


def gap(i: Column, x0s="x0s", x1s="x1s", h: Column | None = None) -> Column:
    """Blank before character i (from 0) in line heights; null where there is none."""
    return (F.get(x0s, i) - F.get(x1s, i - 1)) / (h if h is not None else height(F.col("y0"), F.col("y1")))


def complete(lines: DataFrame) -> DataFrame:
    """lines with scores and hs."""
    n = F.length("text")
    if "scores" not in lines.columns:
        lines = lines.withColumn("scores", F.array_repeat(F.lit(1.0), n))
    return lines if "hs" in lines.columns else lines.withColumn("hs", F.array_repeat((F.col("y1") - F.col("y0")).cast("double"), n))


def _mean(scores: Column) -> Column:
    return F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(scores), F.lit(1))


def handwritten(i: Column, j: Column, rest: Column, surnames: list[str] | None = None) -> Column:
    """Whether the two to four characters at j, behind a common word at i, look like a handwritten name; `rest` is the line from j.

    Only in scans. With a surname first the name must end its line, be taller than the word by 15 %, or badly read; without one, it must
    end the line and be read very badly.
    """

    def judged(name: Column) -> Column:
        n, k = F.length(name), j + F.length(name)
        plausible = n.between(2, 4) & ~name.isin(*STOPS) & ~name.isin(*lexicon.NOT_NAME) & ~F.rlike(name, F.lit("^" + _any(lexicon.NOT_NAME_START)))
        ends = k >= F.length("text")
        apart = ends | F.rlike(F.substring(rest, n + 1, F.length(rest)), F.lit(f"^(?:[{_PUNCT}]|{ANY_STOP})")) | F.coalesce(gap(k) > 0.4, F.lit(False))
        score = _mean(F.slice("scores", j + 1, n))
        taller = upper_median(F.slice("hs", j + 1, n)) >= 1.15 * upper_median(F.slice("hs", i + 1, j - i))
        return plausible & F.when(surname_start(name, surnames), apart & (ends | taller | (score < 0.85))).otherwise(ends & (score < 0.8))

    run = F.regexp_extract(rest, f"^[一-龥](?:(?!{ANY_STOP})[一-龥]){{0,4}}", 0)
    return F.when((F.col("source") == "ocr") & (run != ""), let(run, judged)).otherwise(F.lit(False))


def _candidate(i: Column, surnames: list[str] | None) -> Column:
    """The label that starts at i (from 0), how the scan goes on from it, and whether it counts."""
    text = F.col("text")
    part = lambda s, n: F.substring(s, n + 1, F.length(text))

    def judge(rest: Column, lab0: Column, after: Column, suffix: Column, rest_j: Column, kind: Column, chain: Column, stop: Column, tail: Column) -> Column:
        j0 = i + F.length(lab0)
        label, j = F.concat(lab0, suffix), j0 + F.length(suffix)
        plain_stop = (F.length(stop) > F.length(lab0)) & ~stop.isin(*LABELS)
        passes_on = F.rlike(after, F.lit(f"^[{CHECKBOX}]")) | ((tail != "") & ~tail.isin(*SIGN_SUFFIX))
        generic, signs = label.isin(*lexicon.GENERIC), F.contains(label, F.lit("签"))
        person = kind.isin("PERSON", "STAFF")
        pre = (i == 0) | F.rlike(F.substring(text, i, F.lit(1)), F.lit(rf"[{_PUNCT}0-9]")) | F.coalesce(gap(i) > 0.4, F.lit(False))
        pre = pre | (F.rlike(rest_j, F.lit(f"^[{lexicon.ENDS}]")) & (signs | label.isin(*ROLE_TAILS) | (person & ~generic)))
        chained = (chain != "") & F.rlike(chain, F.lit(f"{ANY_LABEL}|{_any(SIGN_NOTES)}")) & (F.length(chain) <= 25)
        at_end = (j == F.length(text)) & (~generic | (i == 0) | signs)
        post = at_end | chained | ((F.rlike(rest_j, F.lit(f"^[{_SEPS}]")) | F.coalesce(gap(j) > 0.4, F.lit(False))) & ~(generic & F.rlike(rest_j, F.lit("^[（(]"))))
        post = post | ((i == 0) & ~generic & (F.col("source") == "ocr"))

        def outcome(pre: Column, post: Column, chained: Column, skips: Column) -> Column:
            weak = ~post & pre & person & handwritten(i, j, rest_j, surnames)
            ok = pre & (post | weak) & ~skips
            end = F.when(chained, j + F.length(chain)).otherwise(j)
            onward = F.when(passes_on, j0).when(plain_stop, i + F.length(stop)).when(ok, end).otherwise(i + 1)
            return F.struct(i.cast("int").alias("start"), end.cast("int").alias("end"), onward.cast("int").alias("next"), label.alias("label"), kind.alias("type"), weak.alias("weak"), ok.alias("ok"))

        tests = F.struct(pre.alias("pre"), post.alias("post"), chained.alias("chained"), (passes_on | plain_stop).alias("skips"))
        return let(tests, lambda t: outcome(t["pre"], t["post"], t["chained"], t["skips"]))

    def parts(rest: Column, lab0: Column, after: Column, suffix: Column) -> Column:
        def more(rest_j: Column) -> Column:
            own = F.struct(
                kind_of(lab0).alias("kind"),
                F.regexp_extract(rest_j, f"^(?:[/／、（）()或及和 ]|{ANY_LABEL}|(?<=[（(]){_any(SIGN_NOTES)})+[{lexicon.ENDS}]", 0).alias("chain"),
                F.regexp_extract(rest, "^" + ANY_STOP, 0).alias("stop"),
                F.regexp_extract(after, f"^({ANY_LABEL})[{lexicon.ENDS}]", 1).alias("tail"),
            )
            return let(own, lambda o: judge(rest, lab0, after, suffix, rest_j, o["kind"], o["chain"], o["stop"], o["tail"]))

        return let(part(after, F.length(suffix)), more)

    def labelled(rest: Column, lab0: Column) -> Column:
        suffix = lambda after: F.when(F.contains(lab0, F.lit("签")), F.lit("")).otherwise(F.regexp_extract(after, "^" + _any(SIGN_SUFFIX), 0))
        return let(part(rest, F.length(lab0)), lambda after: let(suffix(after), lambda x: parts(rest, lab0, after, x)))

    return let(
        part(text, i), lambda rest: let(F.regexp_extract(rest, "^" + ANY_LABEL, 0), lambda lab0: F.when(lab0 != "", labelled(rest, lab0)))
    )


def find_labels(lines: DataFrame, surnames: list[str] | None = None) -> DataFrame:
    """KEY and start, end, label, type, weak of the labels of each line, in one scan from left to right."""
    own = complete(lines).where(F.rlike("text", F.lit(ANY_LABEL)))
    all_ = F.transform(starts_of(F.col("text"), ANY_LABEL), lambda i: _candidate(i, surnames))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(NEXT).alias("acc"))
    step = lambda s, c: F.when(
        c["start"] >= s["at"],
        F.struct(c["next"].alias("at"), F.when(c["ok"], F.array_append(s["acc"], c)).otherwise(s["acc"]).alias("acc")),
    ).otherwise(s)
    kept = own.select(*KEY, F.explode(F.aggregate(all_, start, step, lambda s: s["acc"])).alias("l"))
    return kept.select(*KEY, "l.start", "l.end", "l.label", "l.type", "l.weak")


#: Characters that a value of a type may have; others end it.
VALUE_CHARS = {"PERSON": "一-龥·•", "STAFF": "一-龥·•", "PHONE": r"0-9A-Za-z\-－— _·•", "MEDICAL_ID": r"0-9A-Za-z\-－— _·•", "BANK_CARD": r"0-9A-Za-z\-－— _·•", "ID_CARD": r"\p{L}\p{N}\-－— _·•", "PLATE": r"\p{L}\p{N}\-－— _·•"}


def take_value(rest: Column, kind: Column) -> Column:
    """struct<skip, value>: what stands after a label, without separators, up to a stop word, punctuation or the type's length."""
    seps = F.length(F.regexp_extract(rest, f"^[{_SEPS}]*", 0))
    body = F.substring(rest, seps + 1, F.length(rest))
    out = F.lit("")
    for name in [*dict.fromkeys(LABELS.values())]:
        ch = f"[{VALUE_CHARS[name]}]" if name in VALUE_CHARS else "[^，。；;,|｜]"
        limit = lexicon.MAX_LENGTH.get(name, 20)
        pattern = f"^{ch}(?:(?!{ANY_STOP}){ch}){{0,{limit - 1}}}"
        value = F.regexp_extract(body, pattern, 0)
        if name in ("PERSON", "STAFF"):
            latin = F.regexp_extract(body, "^[A-Za-z](?:[A-Za-z]| (?=[A-Za-z])){0,29}", 0)
            long = F.regexp_extract(body, f"^{ch}(?:(?!{ANY_STOP}){ch}){{0,14}}", 0)
            value = F.when(latin != "", latin).when(F.rlike(F.substring(body, 1, 9), F.lit("[·•]")), long).otherwise(value)
        out = F.when(kind == name, value).otherwise(out)
    starts_with_label = F.rlike(body, F.lit("^" + ANY_STOP))
    return F.struct(seps.alias("skip"), F.when(starts_with_label, F.lit("")).otherwise(out).alias("value"))


def _cut_at_gap(start: Column, value: Column, kind: Column, x0s="x0s", x1s="x1s", h: Column | None = None) -> Column:
    """The value up to the first wide blank inside it."""
    wide = F.when(kind.isin("ADDRESS", "ORG"), 2.5).otherwise(1.6)
    inner = F.when(F.length(value) > 1, F.sequence(F.lit(1), F.length(value) - 1))
    first = F.array_min(F.filter(inner, lambda i: F.coalesce(gap(start + i, x0s, x1s, h) > wide, F.lit(False))))
    return F.coalesce(F.substring(value, F.lit(1), first), value)


def _isolated(text: Column, k: Column, n: Column, after_gap: Column) -> Column:
    """The n characters at k stand for themselves: two to four, and behind them the end, punctuation, a stop word or a blank."""
    after = F.substring(text, k + n + 1, F.length(text))
    return n.between(2, 4) & ((k + n >= F.length(text)) | F.rlike(after, F.lit(f"^(?:[{_PUNCT}]|{ANY_STOP})")) | F.coalesce(after_gap > 1.0, F.lit(False)))


def _too_far(kind: Column, far: Column, named: Column) -> Column:
    """A name's distance from its label, in heights, that only an isolated word or a surname may have, and one that nothing may."""
    return kind.isin("PERSON", "STAFF") & F.coalesce((far > FAR_NAME) | ((far > FAR_VALUE) & ~named), F.lit(False))


def _seed(label: Column, kind: Column, weak: Column, value: Column, surnames: list[str] | None) -> Column:
    return ~weak & (~label.isin(*lexicon.GENERIC) | ~kind.isin("PERSON", "STAFF") | surname_start(value, surnames))


def _no_field(value: Column) -> Column:
    return F.rlike(value, F.lit("^" + _any(lexicon.NOT_NAME_START)))


def anchor(lines: DataFrame, enabled: list[str], surnames: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, fields). hits: KEY, type, source, prio, start, end, value, seed. fields: KEY, type, label, right_rect, below_rect.

    A value on the label's line wins; else the nearest line to the right in its height band; else, and always for
    signatures, an area to check for ink: on the right to the row's next stop (`row_stops`) or to printed text that is too far to be
    the value, and the cell below, but not below signatures with a value.
    """
    lines = complete(lines)
    labels = find_labels(lines, surnames)
    on = labels.join(lines.select(*KEY, "text", "x0s", "x1s", "y0", "y1", "source", "scores", "hs"), KEY)
    sig, text = F.contains("label", F.lit("签")), F.col("text")
    on = on.where(F.col("type").isin(*enabled) | (sig & F.lit("SIGNATURE" in enabled)))
    taken = take_value(F.substring(text, F.col("end") + 1, F.length("text")), F.col("type"))
    h = F.greatest(upper_median(F.slice("hs", F.col("start") + 1, F.col("end") - F.col("start"))), F.lit(1.0))
    on = bind(on, "t", taken).withColumn("k", F.col("end") + F.col("t.skip"))
    on = bind(on, "v0", _cut_at_gap(F.col("k"), F.col("t.value"), F.col("type"))).withColumns({"h": h, "lab_x1": F.coalesce(F.get("x1s", F.col("end") - 1), F.lit(0.0))})
    n = F.length("v0")
    far = F.when(n > 0, (F.get("x0s", F.col("k")) - F.col("lab_x1")) / F.col("h"))
    named = _isolated(text, F.col("k"), n, gap(F.col("k") + n)) | surname_start(F.col("v0"), surnames)
    on = bind(on, "away", _too_far(F.col("type"), far, named))
    behind = F.substring(text, F.col("k") + 1, F.length("text"))
    printed = looks_printed(behind, F.slice("scores", F.col("k") + 1, F.length("text")))
    on = bind(on, "limit", F.when(F.col("away") & printed, F.get("x0s", F.col("k")) - 0.3 * F.col("h")))
    on = bind(on, "v", F.when(F.col("away"), F.lit("")).otherwise(F.col("v0"))).where(~_no_field(F.col("v")))
    on = bind(on, "good", valid(F.col("type"), F.col("v")) & F.col("type").isin(*enabled))
    hit = lambda df, line, k, v, seed: df.select(
        "doc_id", "page", F.col(line).alias("line"), "type", F.lit("anchor").alias("source"), F.lit(0).alias("prio"),
        F.col(k).cast("int").alias("start"), (F.col(k) + F.length(v)).cast("int").alias("end"), F.col(v).alias("value"), seed.alias("seed"),
    )
    direct = hit(on.where("good"), "line", "k", "v", _seed(F.col("label"), F.col("type"), F.col("weak"), F.col("v"), surnames))
    open_ = on.where("NOT good")
    o_box = {"o_line": "line", "o_text": "text", "o_x0s": "x0s", "o_x1s": "x1s", "o_y0": "y0", "o_y1": "y1", "o_scores": "scores"}
    other = lines.where(F.length("text") > 0).select("doc_id", "page", *[F.col(c).alias(k) for k, c in o_box.items()], F.get("x0s", F.lit(0)).alias("o_x0"))
    band = open_.where("limit IS NULL").join(other, ["doc_id", "page"]).where(
        (F.col("o_line") != F.col("line")) & F.col("o_x0").between(F.col("lab_x1") - 0.5 * F.col("h"), F.col("lab_x1") + 10 * F.col("h"))
        & ((F.col("o_y0") + F.col("o_y1")) / 2).between(F.col("y0") - 0.3 * F.col("h"), F.col("y1") + 0.3 * F.col("h"))
    )
    key = [*KEY, "start", "label", "type", "weak", "h", "lab_x1"]
    nearest = band.groupBy(*key).agg(F.min_by(F.struct("o_x0", *o_box), F.struct("o_x0", "o_line")).alias("o")).select(*key, "o.*")
    o_h, o_text = height(F.col("o_y0"), F.col("o_y1")), F.col("o_text")
    side = bind(nearest, "t", take_value(o_text, F.col("type"))).withColumn("k", F.col("t.skip"))
    side = bind(side, "v0", _cut_at_gap(F.col("k"), F.col("t.value"), F.col("type"), "o_x0s", "o_x1s", o_h))
    m = F.length("v0")
    near = _isolated(o_text, F.col("k"), m, gap(F.col("k") + m, "o_x0s", "o_x1s", o_h)) | surname_start(F.col("v0"), surnames)
    side = bind(side, "away", _too_far(F.col("type"), (F.col("o_x0") - F.col("lab_x1")) / F.col("h"), near))
    side = side.withColumn("o_limit", F.when(F.col("away") & looks_printed(o_text, F.col("o_scores")), F.col("o_x0") - 0.3 * F.col("h")))
    side = bind(side, "v", F.when(F.col("away"), F.lit("")).otherwise(F.col("v0")))
    side = bind(side, "took", valid(F.col("type"), F.col("v")) & F.col("type").isin(*enabled))
    beside = hit(side.where("took"), "o_line", "k", "v", ~F.col("weak") & surname_start(F.col("v"), surnames))
    seen = open_.join(side.select(*KEY, "start", "took", "o_limit"), [*KEY, "start"], "left").withColumn("limit", F.coalesce("limit", "o_limit"))
    took = F.coalesce("took", F.lit(False))
    left = seen.where(~took | sig).withColumn("below", ~took).drop("took", "o_limit")
    shown = on.where(F.col("good") & sig).withColumn("below", F.lit(False))
    return direct.unionByName(beside), field_rects(left.unionByName(shown), lines)


def row_stops(lines: DataFrame) -> DataFrame:
    """doc_id, page, s_y0, s_y1, s_x: where a fill-in area on the line's row ends - at stop words, at signs of printed forms, and at printed text
    that begins the line or stands behind a wide blank."""
    lines, text = complete(lines), F.col("text")
    signs = re.escape(lexicon.TEMPLATE_CHARS.replace(" ", ""))
    words = starts_of(text, f"{ANY_STOP}|[{signs}]")
    heads = F.filter(F.sequence(F.lit(0), F.length("text") - 1), lambda i: (i == 0) | F.coalesce(gap(i) > 1.5, F.lit(False)))
    printed = F.filter(heads, lambda i: looks_printed(F.substring(text, i + 1, F.length(text)), F.slice("scores", i + 1, F.length(text))))
    at = lines.where(F.length("text") > 0).select("doc_id", "page", "y0", "y1", "x0s", F.explode(F.array_distinct(F.concat(words, printed))).alias("i"))
    return at.select("doc_id", "page", F.col("y0").alias("s_y0"), F.col("y1").alias("s_y1"), F.get("x0s", F.col("i")).alias("s_x"))


def field_rects(at: DataFrame, lines: DataFrame) -> DataFrame:
    """Areas of the labels in `at`: right of the label to the row's next stop or to `limit`, and below it for signatures and people."""
    sig = F.contains("label", F.lit("签"))
    h, x1, cy = F.col("h"), F.col("lab_x1"), (F.col("y0") + F.col("y1")) / 2
    ahead = (F.col("a.doc_id") == F.col("s.doc_id")) & (F.col("a.page") == F.col("s.page")) & cy.between(F.col("s_y0") - 0.3 * h, F.col("s_y1") + 0.3 * h) & (F.col("s_x") > x1 + 0.4 * h)
    joined = at.alias("a").join(row_stops(lines).alias("s"), ahead, "left")
    keys = [F.col("a." + k).alias(k) for k in (*KEY, "start", "label", "type", "below", "limit", "y0", "y1", "h", "lab_x1")]
    one = joined.groupBy(*keys, F.get("a.x0s", F.col("a.start")).alias("lab_x0")).agg(F.min("s_x").alias("stop"))
    width = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in lexicon.FIELD_WIDTH.items() for x in (k, float(v))]), F.col("type")), F.lit(OTHER_WIDTH))
    right = F.least(x1 + F.when(sig, SIGN_WIDTH).otherwise(width) * h, F.coalesce("limit", F.lit(1e9)), F.coalesce(F.col("stop") - 0.25 * h, F.lit(1e9)))
    right_rect = F.when(right - x1 > 1.2 * h, rect(x1 + 0.15 * h, cy - 0.8 * h, right, cy + 0.8 * h))
    below = F.when(F.col("below") & (sig | F.col("type").isin("PERSON", "STAFF")), rect(F.col("lab_x0") - 0.4 * h, F.col("y1") + 0.15 * h, x1 + 0.4 * h, F.col("y1") + 2.3 * h))
    kind = F.when(sig, "SIGNATURE").otherwise("HANDWRITTEN_FIELD")
    return one.select(*KEY, kind.alias("type"), "label", right_rect.alias("right_rect"), below.alias("below_rect")).where("right_rect IS NOT NULL OR below_rect IS NOT NULL")


#: A line that is a field's name only, or begins with one and a colon.
LABEL_LINE = f"^(?>{ANY_LABEL}|{ANY_STOP})(?:[：: ]*$|[：: ]*{_any(SIGN_SUFFIX)}[：: ]*$|[{lexicon.ENDS}]|{_any(SIGN_SUFFIX)}[{lexicon.ENDS}])"


def table_signatures(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """KEY, type, label, rect: the cells below a signature label that heads a table's column. pages: doc_id, page, width.

    The label must fill its line and have other short lines on its row. Rows are told by the other columns' lines, as signatures are often not
    read at all; the table ends where the distance of rows jumps. A cell begins right of what its row's lines left of the column reach to.
    """
    lines = complete(lines).where(F.length("text") > 0)
    box = lines.select(*KEY, "text", F.array_min("x0s").alias("x0"), F.array_max("x1s").alias("x1"), "y0", "y1")
    found = find_labels(lines).where(F.contains("label", F.lit("签"))).join(box, KEY)
    head = found.where(F.length(F.trim(F.col("text"), F.lit("：: "))) == F.col("end") - F.col("start")).withColumns({"h": height(F.col("y0"), F.col("y1")), "cy": (F.col("y0") + F.col("y1")) / 2})
    o = box.select("doc_id", "page", *[F.col(c).alias("o_" + c) for c in ("line", "text", "x0", "x1", "y0", "y1")])
    on_page = head.join(o, ["doc_id", "page"]).where("o_line <> line")
    key = [*KEY, "start", "label", "x0", "y0", "x1", "y1", "h"]
    beside = on_page.where((F.abs((F.col("o_y0") + F.col("o_y1")) / 2 - F.col("cy")) < 0.6 * F.col("h")) & (F.length("o_text") <= 12))
    heads = beside.groupBy(*key).agg(F.max(F.when(F.col("o_x1") <= F.col("x0"), F.col("o_x1"))).alias("before"), F.min(F.when(F.col("o_x0") >= F.col("x1"), F.col("o_x0"))).alias("after"), F.min("o_x0").alias("first"))
    h, x0, x1 = F.col("h"), F.col("x0"), F.col("x1")
    column = heads.join(pages.select("doc_id", "page", "width"), ["doc_id", "page"]).withColumns({
        "col_l": F.coalesce((F.col("before") + x0) / 2, x0 - 2 * h),
        "col_r": F.coalesce(F.col("after") - 0.3 * h, F.least(F.col("width").cast("double"), x1 + 4 * (x1 - x0))),
        "table_l": F.least("first", "x0") - h,
    })
    mid = (F.col("o_x0") + F.col("o_x1")) / 2
    others = column.join(o, ["doc_id", "page"]).where(
        (F.col("o_line") != F.col("line")) & (F.col("o_y0") >= F.col("y1") - 0.2 * h) & (((mid >= F.col("table_l")) & (mid < F.col("col_l"))) | (mid > F.col("col_r"))) & ~F.rlike("o_text", F.lit(LABEL_LINE))
    )
    reach = F.when(F.col("o_x1") <= x0 + 0.5 * h, F.col("o_x1") + 0.3 * h)
    entry = F.struct(F.col("o_y0").cast("double").alias("top"), F.col("o_y1").cast("double").alias("bottom"), F.coalesce(reach, F.lit(-1e9)).cast("double").alias("left"))
    per_head = others.groupBy(*KEY, "start", "label", "y1", "h", "col_l", "col_r").agg(F.sort_array(F.collect_list(entry)).alias("ls"))
    kind = "array<struct<top:double,bottom:double,left:double>>"

    def into_rows(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.struct(F.least(last["top"], x["top"]).alias("top"), F.greatest(last["bottom"], x["bottom"]).alias("bottom"), F.greatest(last["left"], x["left"]).alias("left"))
        return F.when((F.size(acc) > 0) & (x["top"] < last["bottom"] - 0.3 * h), F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), joined)).otherwise(F.array_append(acc, x))

    rows = bind(per_head, "rows", F.aggregate("ls", F.array().cast(kind), into_rows))
    size = F.size("rows")
    steps = F.sort_array(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.get("rows", i)["top"] - F.get("rows", i - 1)["top"]))
    pitch = F.when(size >= 3, F.get(steps, (size / 2).cast("int") - 1)).otherwise(3 * h)
    rows = bind(rows, "jump", F.greatest(1.8 * pitch, 3 * h))
    ends = F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.get("rows", i)["top"] - F.when(i == 0, F.col("y1")).otherwise(F.get("rows", i - 1)["top"]) > F.col("jump"))
    cells = rows.select(*KEY, "label", "h", "col_l", "col_r", F.explode(F.slice("rows", F.lit(1), F.coalesce(F.array_min(ends), size))).alias("r"))
    area = rect(F.greatest(F.col("col_l"), F.col("r.left")), F.col("r.top") - 0.35 * h, F.col("col_r"), F.col("r.bottom") + 0.35 * h)
    return cells.select(*KEY, F.lit("SIGNATURE").alias("type"), "label", area.alias("rect"))


# Fixed value: the shape of dates, the day being optional.
LOOSE_DATE = r"(?:19|20)\d{2}\s*[.\-/年]\s*\d{1,2}(?:\s*[.\-/月]\s*(?:\d{1,2}日?)?)?(?:\s*\d{1,2}[:：]\d{2})?"
AFTER_DATE = "入院 出院 手术 查房 记录 复查 复诊 首次 日常 抢救 会诊 转科 交班 接班 死亡 讨论 小结 病程 术后 术前 上午 下午 晚上 夜间 凌晨".split()


def date_signatures(lines: DataFrame) -> DataFrame:
    """KEY, label, rect: the area right of a date that ends a scanned line, or is followed by at most four name-like characters.

    The label tells whether the date lacks its day. Areas that hold another line of five characters or more are dropped.
    """
    at = lines.where("source = 'ocr'").select(*KEY, "text", "x0s", "x1s", "y0", "y1", F.explode(find_all(F.col("text"), LOOSE_DATE)).alias("d"))
    tail = F.substring("text", F.col("d.end") + 1, F.length("text"))
    named = F.rlike(tail, F.lit("^[一-龥]{0,4}$")) & ~F.rlike(tail, F.lit("^" + _any([*AFTER_DATE, *lexicon.NOT_NAME_START]))) & ~tail.isin(*STOPS)
    h, x1 = height(F.col("y0"), F.col("y1")), F.get("x1s", F.col("d.end") - 1)
    cy = (F.col("y0") + F.col("y1")) / 2
    area = rect(x1 + 0.2 * h, cy - 1.1 * h, F.greatest(x1 + 8 * h, F.element_at("x1s", -1) + 0.5 * h), cy + 1.1 * h)
    whole = F.rlike("d.value", F.lit(r"\d{4}\s*[.\-/年]\s*\d{1,2}\s*[.\-/月]\s*\d{1,2}日?$"))
    own = at.where(named).select(*KEY, F.when(whole, "日期").otherwise("日期缺日").alias("label"), area.alias("rect"))
    o = lines.where(F.length("text") >= 5).select(F.col("doc_id").alias("od"), F.col("page").alias("op"), F.col("line").alias("ol"), F.get("x0s", F.lit(0)).alias("ox0"), F.element_at("x1s", -1).alias("ox1"), F.col("y0").alias("oy0"), F.col("y1").alias("oy1"))
    r = F.col("rect")
    hit = (F.col("doc_id") == F.col("od")) & (F.col("page") == F.col("op")) & (F.col("line") != F.col("ol")) & (r["x0"] < F.col("ox1")) & (F.col("ox0") < r["x1"]) & (r["y0"] < F.col("oy1")) & (F.col("oy0") < r["y1"])
    return own.join(o, hit, "left_anti")


# Fixed value: the shape of headings of ward rounds.
ROUND = r"[一-龥]{2,4}?(?=(?:副主任|主任|主治|住院|上级|经治)(?:医师|医生)(?:首次)?查房)"


def round_names(lines: DataFrame, surnames: list[str] | None = None) -> DataFrame:
    """Names that stand before a title in the heading of a ward round."""
    at = lines.select(*KEY, F.explode(find_all(F.col("text"), r"(?:^|(?<=[\d:：，,。；;、\s]))" + ROUND)).alias("m"))
    v = F.col("m.value")
    return at.where(surname_start(v, surnames) & valid(F.lit("STAFF"), v)).select(
        *KEY, F.lit("STAFF").alias("type"), F.lit("anchor").alias("source"), F.lit(1).alias("prio"), F.col("m.start").alias("start"), F.col("m.end").alias("end"), v.alias("value"), F.lit(True).alias("seed"),
    )
