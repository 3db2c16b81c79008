"""Around a name model: segments, windows, decoding of tag probabilities, roles. The model itself is pluggable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions.validators import is_name
from spanveil.operators import quantiles
from spanveil.operators.engine import KEY

WINDOW, STRIDE = 200, 160
LEAST_SCORE = 0.85


def segments(lines: DataFrame) -> DataFrame:
    """doc_id, page, segment, first_line, text: wrapped lines joined, then those of 12 characters or more with running punctuation.

    A line goes on in the next if it reaches 85 % of the page's 80th percentile width and does not end a sentence.
    """
    order = Window.partitionBy("doc_id", "page").orderBy("line")
    p80 = quantiles.exact(lines, ["doc_id", "page"], "width", {"p80": 0.8}).drop("n")  # one value a page
    lines = lines.join(p80, ["doc_id", "page"])
    full = (F.col("width") >= 0.85 * F.col("p80")) & ~F.rlike("text", F.lit("[。；！？]$"))
    goes_on = lines.withColumn("full", full)
    fresh = goes_on.withColumn("fresh", F.coalesce((~F.lag("full").over(order)).cast("int"), F.lit(1)))
    runs = fresh.withColumn("segment", F.sum("fresh").over(order))
    joined = runs.groupBy("doc_id", "page", "segment").agg(
        F.min("line").alias("first_line"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "").alias("text")
    )
    return joined.where((F.length("text") >= 12) & F.rlike("text", F.lit("[，。；、（]")))


def windows(n: Column) -> Column:
    """Starts of the model's windows over a text of n characters."""
    return F.sequence(F.lit(0), F.greatest(n - (WINDOW - STRIDE), F.lit(1)) - 1, F.lit(STRIDE))


def stitched(probabilities: DataFrame) -> DataFrame:
    """id, pos, b, i: overlapping windows' probabilities averaged, weighted by the distance to the window's border.

    probabilities: id, start, offset, size, b, i.
    """
    weight = 1.0 + F.least(F.col("offset"), F.col("size") - F.col("offset"))
    total = F.sum(weight)
    return probabilities.groupBy("id", (F.col("start") + F.col("offset")).alias("pos")).agg((F.sum(weight * F.col("b")) / total).alias("b"), (F.sum(weight * F.col("i")) / total).alias("i"))


def decode(tags: DataFrame) -> DataFrame:
    """id, start, end, score: runs of name tags. tags: id, pos, tag (B, I or O), b, i; an I opens a run if no run is open."""
    order = Window.partitionBy("id").orderBy("pos")
    on = tags.where("tag <> 'O'").withColumn("fresh", ((F.col("tag") == "B") | F.coalesce(F.col("pos") != F.lag("pos").over(order) + 1, F.lit(True))).cast("int"))
    runs = on.withColumn("run", F.sum("fresh").over(order))
    return runs.groupBy("id", "run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.avg(F.col("b") + F.col("i")).alias("score")).drop("run")


# Words that follow a name and may be taken into it, ends of drugs' names, and words near a name that tell its bearer's role.
AFTER_NAME = "主任 代为 护士 医师 医生 大夫 教授 表示 要求".split()
DRUG_TAILS = "霉素 沙星 西林 他汀 洛尔 地平 普利 沙坦 替丁 拉唑 咪唑 硝唑 韦林 卡因 松片 片 胶囊 注射液 颗粒 口服液".split()
STAFF_CUES = "医师 医生 主任 护士长 护士 护师 教授 大夫 术者 助手 麻醉 主刀 查房 会诊 院长 药师 技师 治疗师".split()
PERSON_CUES = "患者 病人 家属 之女 之子 女儿 儿子 妻子 丈夫 母亲 父亲 配偶 陪护 陪同 亲属 监护人 代为 本人 女婿 儿媳 孙女 孙子 外甥 联系".split()
CUE_WINDOW = 8
SEED_SCORE = 0.97


def accepted(found: DataFrame, surnames: list[str] | None = None) -> DataFrame:
    """Findings (id, text, start, end, score) that are names, with `value` and `seed`.

    Ends that begin a word of AFTER_NAME are cut off; what is left must score enough, look like a name, and not be the start of a drug's.
    """
    rest = lambda e: F.substring("text", e + 1, F.length("text"))
    begins = F.lit("^(?:" + "|".join(AFTER_NAME) + ")")
    # The longest end from which on every shorter one begins such a word; at least one character stays.
    cuts = F.filter(F.sequence(F.lit(1), F.greatest(F.col("end") - F.col("start") - 1, F.lit(1))), lambda n: (F.col("end") - F.col("start") > n) & F.rlike(rest(F.col("end") - n), begins))
    whole = F.aggregate(cuts, F.lit(0), lambda a, n: F.when(n == a + 1, n).otherwise(a))
    cut = found.withColumn("end", (F.col("end") - whole).cast("int"))
    named = cut.withColumn("value", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))
    drug = F.rlike(rest(F.col("end")), F.lit("^(?:" + "|".join(DRUG_TAILS) + ")"))
    return named.where((F.col("score") >= LEAST_SCORE) & is_name(F.col("value"), surnames) & ~drug).withColumn("seed", F.col("score") >= SEED_SCORE)


def roles(names: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """names (id, start, end, text) with `type`: the nearer cue within eight characters decides, names joined by a comma or "and" share
    the nearest cue of their group; without a cue, or at equal distance, a person. A type that is not enabled becomes the other."""

    def distance(words: list[str]) -> Column:
        return F.coalesce(F.least(*[d for w in words for d in (_behind(w), _before(w))]), F.lit(99))

    def _behind(w: str) -> Column:
        at = F.instr(F.substring("text", F.col("end") + 1, F.lit(CUE_WINDOW + len(w))), w)
        return F.when(at > 0, at - 1)

    def _before(w: str) -> Column:
        n = CUE_WINDOW + len(w)
        head = F.substring("text", F.greatest(F.col("start") - n + 1, F.lit(1)), F.least(F.col("start"), F.lit(n)))
        at = F.instr(F.reverse(head), w[::-1])
        return F.when((F.col("start") > 0) & (at > 0), at - 1)

    order = Window.partitionBy("id").orderBy("start")
    between = F.substring("text", F.lag("end").over(order) + 1, F.col("start") - F.lag("end").over(order))
    fresh = F.coalesce((~F.rlike(between, F.lit("^[、和与及]$"))).cast("int"), F.lit(1))
    grouped = names.withColumns({"s": distance(STAFF_CUES), "p": distance(PERSON_CUES)}).withColumn("fresh", fresh)
    grouped = grouped.withColumn("g", F.sum("fresh").over(order))
    by = Window.partitionBy("id", "g")
    kind = F.when(F.min("s").over(by) < F.min("p").over(by), "STAFF").otherwise("PERSON")
    if enabled is not None:
        kind = F.when(kind.isin(*enabled), kind).otherwise(F.lit("PERSON" if "PERSON" in enabled else "STAFF"))
    return grouped.withColumn("type", kind).drop("s", "p", "fresh", "g")


def split_by_line(found: DataFrame, chars: DataFrame) -> DataFrame:
    """KEY, start, end of a segment's finding on each line it touches. chars: id, pos, KEY, place."""
    inside = found.join(chars, "id").where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")))
    return inside.groupBy("id", F.col("start").alias("at"), *KEY).agg(F.min("place").alias("start"), (F.max("place") + 1).alias("end")).select(*KEY, "start", "end")
