"""Further literal cases: fill-in areas, photos, watermarks, values behind unread labels, boxes of hits, reviews, keys and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions import geometry as g
from spanveil.operators import fields, jobs, metrics, ner, redact, regions, review, templates
from tests.literal_cases import TEMPLATE, _form_lines, _template_page, case
from spanveil.sources import files


def _areas(spark, rows: list[tuple]) -> DataFrame:
    """(id, x0, y0, x1, y1) on the page of _form_lines; an area's document is its id."""
    df = spark.createDataFrame([(i, *map(float, r)) for i, *r in rows], "id int, x0 double, y0 double, x1 double, y1 double")
    return df.select(F.col("id").alias("doc_id"), F.lit(0).alias("page"), "id", g.rect(*[F.col(k) for k in g.KEYS]).alias("rect"))


FIELD_LINES = [
    (1, "2025年", "ocr", {}), (2, "覃月", "ocr", {}), (3, "入院科别", "ocr", {}), (4, "王小明", "ocr", {}), (5, "签名：2025-10-03 王一", "ocr", {}), (6, "签名：2025-10-03", "ocr", {}), (7, "印刷的句子在此", "text", {}),
    (8, "张明/李晓红", "ocr", {}), (9, "印刷的句子在此", "ocr", {}), (10, "印刷的句子在此", "ocr", {}, {k: 0.5 for k in range(7)}),
]
FIELD_AREAS = [(1, -5, -5, 200, 20), (2, -5, -5, 200, 20), (3, -5, -5, 200, 20), (4, -5, -5, 200, 20), (5, 25, 0, 260, 10), (6, 25, 0, 140, 10), (7, -5, -5, 200, 20), (8, -5, -5, 200, 20), (9, 5, -5, 200, 20), (10, -5, -5, 200, 20)]


@case("digit_areas", "id", [(1,), (5,), (6,)])
def digit_areas(spark):
    return fields.has_printed_digits(_areas(spark, FIELD_AREAS), _form_lines(spark, FIELD_LINES)).select("id")


@case("label_areas", "id", [(3,)])
def label_areas(spark):
    return fields.has_printed_labels(_areas(spark, FIELD_AREAS[:4]), _form_lines(spark, FIELD_LINES[:4])).select("id")


@case("usable_areas", "id", [(2,), (4,), (7,), (8,), (9,), (10,)])
def usable_areas(spark):
    return fields.usable(_areas(spark, FIELD_AREAS), _form_lines(spark, FIELD_LINES)).select("id")


@case("printed_in_areas", "id n", [(7, 7)])
def printed_in_areas(spark):
    """A text layer's characters, and printed lines that begin in the area; names, unsure lines and lines from outside don't count."""
    own = [r for r in FIELD_AREAS if r[0] >= 7]
    return fields.printed_boxes(_areas(spark, own), _form_lines(spark, [r for r in FIELD_LINES if r[0] >= 7])).groupBy("id").agg(F.count("*").alias("n"))


@case("after_dates", "id x0 x1", [(4, -5.0, 200.0), (5, 133.0, 260.0), (6, 133.0, 193.0)])
def after_dates(spark):
    moved = fields.after_printed_date(_areas(spark, FIELD_AREAS[3:6]), _form_lines(spark, FIELD_LINES[3:6]))
    return moved.select("id", F.round("rect.x0", 4).alias("x0"), F.round("rect.x1", 4).alias("x1"))


@case("outside_areas", "id n", [(5, 2), (6, 2)])
def outside_areas(spark):
    return fields.outside(_areas(spark, FIELD_AREAS[4:6]), _form_lines(spark, FIELD_LINES[4:6])).groupBy("id").agg(F.count("*").alias("n"))


@case("photo_lines", "text", [("新的一行",)])
def photo_lines(spark):
    known = _form_lines(spark, [(1, "已经认出的一行", "ocr", {})])
    photo = _form_lines(spark, [(1, "认出", "ocr", {}), (1, "新的一行", "ocr", {0: 200})])
    return fields.new_lines(photo, known).select("text")


@case("identity_photos", "photo", [(1,)])
def identity_photos(spark):
    rows = [(1, 0, 1, "号码11010519491231002X"), (1, 0, 1, "住址"), (1, 0, 2, "没有号码"), *[(1, 0, 3, "11010519491231002X")] * 21]
    return fields.identity_photos(spark.createDataFrame(rows, "doc_id int, page int, photo int, text string")).select("photo")


@case("removed_slanted", "text type", [("澄岚市第一人民医院", "ORG"), ("仅供参考", "WATERMARK")])
def removed_slanted(spark):
    schema = "doc_id int, page int, text string, x0 double, y0 double, x1 double, y1 double"
    own = lambda rows: spark.createDataFrame(rows, schema).select("doc_id", "page", "text", g.rect(*[F.col(k) for k in g.KEYS]).alias("rect"))
    before = own([(1, 0, "澄岚市第一人民医院", 0.0, 0.0, 90.0, 90.0), (1, 0, "仅供参考", 100.0, 0.0, 190.0, 90.0), (1, 0, "留下", 0.2, 0.0, 50.0, 50.0)])
    return fields.removed_slanted(before, own([(1, 0, "留下", 0.0, 0.3, 50.4, 50.0), (1, 1, "仅供参考", 100.0, 0.0, 190.0, 90.0)])).select("text", "type")


@case("distinct_profiles", "ord", [(1,), (3,), (4,)])
def distinct_profiles(spark):
    rows = [(1, 1, 30.0, [200.0, 200.0, 200.0]), (1, 2, 33.0, [205.0, 200.0, 210.0]), (1, 3, 36.0, [200.0, 200.0, 200.0]), (1, 4, 30.0, [200.0, 230.0, 200.0])]
    return fields.distinct_profiles(spark.createDataFrame(rows, "doc_id int, ord int, angle double, color array<double>")).select("ord")


@case("read_images", "id", [(1,)])
def read_images(spark):
    rows = [(1, 1, "text", 400.0, 300.0, False), (2, 2, "text", 400.0, 299.0, False), (3, 3, "text", 400.0, 300.0, True), (4, 4, "ocr", 400.0, 300.0, False)]
    df = spark.createDataFrame(rows, "id int, page int, src string, w double, h double, repeated boolean").withColumn("doc_id", F.lit(1))
    images = df.select("doc_id", "page", "id", g.rect(F.lit(0.0), F.lit(0.0), F.col("w"), F.col("h")).alias("rect"), "repeated")
    pages = df.select("doc_id", "page", F.col("src").alias("text_source"), F.lit(1000.0).alias("width"), F.lit(1000.0).alias("height"))
    return fields.images_to_read(images, pages).select("id")


@case("hit_rects", "id x0 y0 x1 y1", [(1, 10.0, 0.0, 40.0, 12.0), (2, 78.8, -1.2, 101.2, 11.2), (3, 97.8, -2.4, 122.2, 12.4)])
def hit_rects(spark):
    """Padding stops before neighbours on the line and before a character of the line below; anchored hits of scans get more."""
    rows = [(1, "甲乙丙丁戊", "ocr", {}), (2, "甲乙丙丁戊己庚", "text", {5: 30}), (3, "甲乙", "ocr", {0: 100})]
    lines_ = _form_lines(spark, rows)
    chars = fields.characters(lines_).select("doc_id", "page", "line", "place", F.when(F.col("doc_id") == 1, g.rect(F.col("box.x0"), F.lit(2.0), F.col("box.x1"), F.lit(12.0))).otherwise(F.col("box")).alias("box"))
    lower = spark.createDataFrame([(1, 0, 1, 0, 13.0)], "doc_id int, page int, line int, place int, y double").select("doc_id", "page", "line", "place", g.rect(F.lit(20.0), F.col("y"), F.lit(30.0), F.lit(25.0)).alias("box"))
    hits = spark.createDataFrame([(1, 1, 0, 0, 1, 4, "rule", True, True), (2, 2, 0, 0, 5, 7, "rule", False, False), (3, 3, 0, 0, 0, 2, "anchor", True, False)], "id int, doc_id int, page int, line int, start int, end int, source string, ocr boolean, strict boolean")
    found = regions.span_rects(hits, chars.unionByName(lower))
    return found.select("id", *[F.round(F.col("rect")[k], 4).alias(k) for k in g.KEYS])


@case("model_tiles", "page x0 y0 x1 y1", [(1, 0.0, 0.0, 900.0, 1000.0), (2, 0.0, 0.0, 1000.0, 1200.0), (2, 0.0, 0.0, 650.0, 780.0), (2, 350.0, 0.0, 1000.0, 780.0), (2, 0.0, 420.0, 650.0, 1200.0), (2, 350.0, 420.0, 1000.0, 1200.0)])
def model_tiles(spark):
    return regions.tiles(spark.createDataFrame([(1, 1, 900.0, 1000.0), (1, 2, 1000.0, 1200.0)], "doc_id int, page int, width double, height double")).select("page", *g.KEYS)


@case("stamp_parts", "id type", [(1, "SEAL"), (2, "SEAL"), (3, "SIGNATURE")])
def stamp_parts(spark):
    rows = [(1, 0.0, 0.0, 98.0, 98.0), (2, 85.0, 10.0, 100.0, 40.0), (3, 40.0, 40.0, 60.0, 60.0)]
    boxes = _areas(spark, rows).select(F.lit(1).alias("doc_id"), "page", "id", "rect", F.lit("SIGNATURE").alias("type"), F.lit(0.9).alias("score"))
    stamps = spark.range(1).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page"), g.rect(0, 0, 100, 100).alias("seal"))
    return regions.stamp_parts(boxes, stamps).select("id", "type")


@case("crowded_pages", "page", [(2,)])
def crowded_pages(spark):
    both = spark.range(100).select(F.lit(1).alias("page")).unionAll(spark.range(101).select(F.lit(2).alias("page")))
    return regions.too_many(both.withColumn("doc_id", F.lit(1))).select("page")


@case("bands", "k bands", [("spread", 4.0), ("one", 400 / 326)])
def bands(spark):
    rows = [("spread", i, 5) for i in range(4)] + [("one", 0, 18), ("one", 1, 1), ("one", 2, 1)]
    return regions.effective_bands(spark.createDataFrame(rows, "k string, band int, n bigint"), ["k"])


@case("template_values", "type start end value", [("ID_CARD", 4, 23, "110105198001011234")])
def template_values(spark):
    """The number behind a label that could not be read is found by its place; what lies elsewhere is not."""
    seen, own = _template_page(spark)
    x, y = 1050.0 * 0.15 + 20, 2100.0 * 0.10 + 35
    rows = [("□□□□：110105198001011234", x - 40.0, y), ("电话：13912345678", 72.0, 350.0)]
    lines_ = spark.createDataFrame([(1, 0, i, t, [a + 10.0 * k for k in range(len(t))], [a + 10.0 * k + 9 for k in range(len(t))], b, b + 21.0) for i, (t, a, b) in enumerate(rows)], "doc_id int, page int, line int, text string, x0s array<double>, x1s array<double>, y0 double, y1 double")
    return templates.recover_values(seen, own, lines_, ["PERSON", "ID_CARD", "PHONE"])[0].select("type", "start", "end", "value")


@case("template_areas", "label type", [("身份证号", "HANDWRITTEN_FIELD")])
def template_areas(spark):
    seen, own = _template_page(spark)
    none = spark.createDataFrame([], "doc_id int, page int, line int, text string, x0s array<double>, x1s array<double>, y0 double, y1 double")
    return templates.recover_values(seen, own, none, ["PERSON", "ID_CARD", "PHONE"])[1].select("label", "type")


@case("template_trial", "mode n covered", [("off", 2, 1), ("on", 2, 2)])
def template_trial(spark):
    """Values covered with and without templates."""
    hits = spark.createDataFrame([("off", 1, 0, 0.0, 0.0, 50.0, 50.0), ("on", 1, 0, 0.0, 0.0, 50.0, 50.0), ("on", 1, 0, 50.0, 50.0, 100.0, 100.0)], "mode string, doc_id int, page int, x0 double, y0 double, x1 double, y1 double")
    truth = spark.createDataFrame([(1, 0, 1, [0.1, 0.1, 0.2, 0.2]), (1, 0, 2, [0.7, 0.7, 0.8, 0.8])], "doc_id int, page int, item int, box array<double>")
    size = spark.createDataFrame([(1, 0, 100.0, 100.0)], "doc_id int, page int, width double, height double")
    return templates.covered_values(hits.select("mode", "doc_id", "page", g.rect(*[F.col(k) for k in g.KEYS]).alias("rect")), size, truth)


@case("name_findings", "id value seed", [(1, "白小山", True), (2, "林可", False)])
def name_findings(spark):
    """A title's first character is cut off a name; a drug's first half is no name."""
    rows = [(1, "白小山主任查房", 0, 4, 0.98), (2, "林可来访", 0, 2, 0.9), (3, "予林可霉素", 1, 3, 0.99), (4, "王小明", 0, 3, 0.5)]
    return ner.accepted(spark.createDataFrame(rows, "id int, text string, start int, end int, score double")).select("id", "value", "seed")


_REPORT = "job_id string, editable boolean, edits bigint, counts map<string,bigint>, evidence string"
_ITEMS = "job_id string, page int, type string, box array<double>, style string"


def _reviewed(spark):
    a, b = [0.1, 0.1, 0.4, 0.2], [0.5, 0.5, 0.9, 0.6]
    reports = spark.createDataFrame([(j, e, 1, {"PERSON": 2}, "passed") for j, e in (("open", True), ("shut", False), ("more", False), ("same", True))], _REPORT)
    old = spark.createDataFrame([(j, 1, "PERSON", a, "black") for j in ("open", "shut", "more", "same") for _ in range(2)], _ITEMS)
    one, two = (1, "PERSON", a, "black"), (2, "PHONE", b, "label")
    new = spark.createDataFrame([("open", *one), ("open", *two), ("shut", *one), ("more", *one), ("more", *one), ("more", *two), ("same", *one), ("same", *one)], _ITEMS)
    return reports, old, new


@case("review_outcomes", "job_id code edits persons evidence", [("open", None, 3, 1, "stale"), ("shut", "NOT_EDITABLE", 1, 2, "passed"), ("more", None, 2, 2, "stale"), ("same", None, 1, 2, "passed")])
def review_outcomes(spark):
    return review.applied(*_reviewed(spark)).select("job_id", "code", "edits", F.col("counts")["PERSON"].alias("persons"), "evidence")


@case("review_paint", "job_id page type", [("open", 1, "PERSON"), ("open", 2, "PHONE"), ("more", 2, "PHONE")])
def review_paint(spark):
    return review.to_paint(*_reviewed(spark)).select("job_id", "page", "type")


@case("review_finished", "job_id editable finished", [("open", False, True), ("shut", False, True), ("more", False, True), ("same", False, True)])
def review_finished(spark):
    return review.finished(_reviewed(spark)[0]).select("job_id", "editable", "finished")


@case("review_limit", "too_many", [(True,)])
def review_limit(spark):
    """At most 50 items a page and 1000."""
    return spark.range(1).select(review.too_many_items(spark.range(1051), 1))


@case("truth_boxes", "image_id category_id x", [(2, 15, 20.0)])
def truth_boxes(spark):
    rows = [(1, "SIGNATURE", "redact"), (2, "SIGNATURE", "redact"), (2, "SEAL", "keep"), (2, "PERSON", "redact")]
    truth = spark.createDataFrame([(p, t, r, [0.1, 0.2, 0.3, 0.4]) for p, t, r in rows], "page int, type string, role string, box array<double>")
    pages = spark.createDataFrame([(1, 200.0, 300.0, "text"), (2, 200.0, 300.0, "ocr")], "page int, width double, height double, text_source string")
    return review.truth_coco(truth, pages)[1].select("image_id", "category_id", F.col("bbox")[0].alias("x"))


@case("report_summaries", "job_id status findings concerns", [("a", "review", 2, 1), ("b", None, None, 0)])
def report_summaries(spark):
    schema = "job_id string, pages int, counts map<string,bigint>, elapsed_sec double, output string, verification string, visual_verification struct<status:string,pages:int,findings:array<int>,model_version:string>, visual_concerns array<int>"
    df = spark.createDataFrame([("a", 1, {"PERSON": 1}, 2.0, "x.pdf", "passed", ("review", 1, [1, 2], "v"), [7]), ("b", 1, {}, 1.0, "y.pdf", None, None, None)], schema)
    v = F.col("visual_verification")
    return redact.report_summary(df).select("job_id", v["status"].alias("status"), v["findings_count"].alias("findings"), F.col("visual_concerns_count").alias("concerns"))


def _keys(spark):
    schema = "id string, name string, prefix string, key_hash string, created double, last_used double, revoked double"
    return spark.createDataFrame([("a", "n", "key_x", "h1", 1.0, None, None), ("b", "n", "key_y", "h2", 1.0, 100.0, 5.0), ("c", "n", "key_z", "h3", 1.0, 100.0, None)], schema)


@case("key_creation", "id name prefix known", [("d", "ward", "key_abcde", True), ("f", "unnamed", "key_vwxyz", True)])
def key_creation(spark):
    """A secret whose hash exists gives no key."""
    rows = [("d", "  ward ", "key_abcdefgh", 9.0), ("e", "twice", "key_known", 9.0), ("f", "  ", "key_vwxyz12", 9.0)]
    known = spark.range(1).select(F.sha2(F.lit("key_known"), 256).alias("key_hash"))
    made = jobs.new_keys(spark.createDataFrame(rows, "id string, name string, secret string, created double"), known)
    return made.select("id", "name", "prefix", (F.length("key_hash") == 64).alias("known"))


@case("key_revocation", "id revoked", [("a", 7.0), ("b", 5.0), ("c", None)])
def key_revocation(spark):
    return jobs.revoke(_keys(spark), ["a", "b"], 7.0).select("id", "revoked")


@case("key_last_used", "id last_used", [("a", 71.0), ("b", 100.0), ("c", 161.0)])
def key_last_used(spark):
    uses = spark.createDataFrame([("a", 10.0), ("a", 60.0), ("a", 70.0), ("a", 71.0), ("c", 130.0), ("c", 160.0), ("c", 161.0), ("c", 200.0)], "key_id string, at double")
    return jobs.last_used(_keys(spark), uses).select("id", "last_used")


@case("key_usage", "id active jobs", [("a", True, 2), ("b", False, 1), ("c", True, 0)])
def key_usage(spark):
    return jobs.usage(_keys(spark), spark.createDataFrame([("a",), ("a",), ("b",), ("x",)], "owner string"))


@case("job_migration", "id owner name", [("1", None, None), ("2", "k", "f.pdf")])
def job_migration(spark):
    old = spark.createDataFrame([("1", "queued")], "id string, status string")
    return jobs.migrate(old, spark.createDataFrame([("2", "queued", "k", "f.pdf")], "id string, status string, owner string, name string")).select("id", "owner", "name")


@case("visible_jobs", "who id", [("all", "1"), ("all", "2"), ("k", "2")])
def visible_jobs(spark):
    df = spark.createDataFrame([("1", None), ("2", "k")], "id string, owner string")
    return jobs.visible(df, None).select(F.lit("all").alias("who"), "id").unionByName(jobs.visible(df, "k").select(F.lit("k").alias("who"), "id"))


@case("variant_costs", "variant extras sec_per_page", [("scan", 1, 2.1), ("text", 2, 0.2)])
def variant_costs(spark):
    rows = [("scan", 4, 8.0, 1), ("scan", 6, 13.0, 0), ("text", 10, 2.0, 2)]
    return metrics.variant_costs(spark.createDataFrame(rows, "variant string, pages int, elapsed double, extras int"))


@case("image_digests", "id digest", [(1, "86f7e437faa5a7fc"), (2, "e9d71f5ee7c92d6d"), (3, "86f7e437faa5a7fc")])
def image_digests(spark):
    df = spark.createDataFrame([(1, bytearray(b"a")), (2, bytearray(b"b")), (3, bytearray(b"a"))], "id int, content binary")
    return df.select("id", files.image_digest(F.col("content")).alias("digest"))


@case("digests_so_far", "id first later", [(1, True, False), (2, True, True), (3, False, False)])
def digests_so_far(spark):
    """Recurring digests as the first pass over pages knows them, and as the second does."""
    df = spark.createDataFrame([(1, 0, "x"), (2, 1, "x"), (3, 1, "y")], "id int, page int, digest string").withColumn("doc_id", F.lit(1))
    both = regions.repeated_digests(df).withColumn("first", F.lit(True))
    return regions.repeated_so_far(df).join(both, ["doc_id", "digest"], "left").select("id", F.coalesce("first", F.lit(False)).alias("first"), F.col("repeated").alias("later"))


@case("printed_share", "id share", [(1, 0.5), (2, 0.0)])
def printed_share(spark):
    """How much of a model's box printed characters take up."""
    boxes = _areas(spark, [(1, 0, 0, 20, 10), (2, 0, 50, 20, 60)]).withColumn("doc_id", F.lit(1))
    chars = spark.range(1).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page"), g.rect(0, 0, 10, 10).alias("rect"))
    return regions.covered_share(boxes, chars).select("id", "share")


@case("verify_modes", "mode source again", [("true", "text", True), ("auto", "text", False), ("auto", "ocr", True), ("false", "ocr", False)])
def verify_modes(spark):
    df = spark.createDataFrame([("true", "text"), ("auto", "text"), ("auto", "ocr"), ("false", "ocr")], "mode string, source string")
    return df.select("mode", "source", redact.verify_page(F.col("mode"), F.col("source")).alias("again"))


@case("template_shares", "text x0 y1", [("姓名", 0.05, 0.06)])
def template_shares(spark):
    name, text, kind, (a, b, c, d) = TEMPLATE[0]
    own = spark.range(1).select(F.lit(name).alias("name"), F.lit(text).alias("text"), F.lit(kind).alias("type"), g.rect(1000 * a, 2000 * b, 1000 * c, 2000 * d).alias("rect"), F.lit(1000.0).alias("width"), F.lit(2000.0).alias("height"))
    return templates.build(own).select("text", F.col("box")[0].alias("x0"), F.col("box")[3].alias("y1"))
