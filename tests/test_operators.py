"""Properties that hold for any input, sources and sinks, and streams."""

import json
import re
import time
from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanveil.operators import engine, lines, redact, rules
from spanveil.sources import files
from spanveil.streaming import limits

_PIECES = ["13800138000", "11010519491231002X", "4111111111111111", "a.b@example.com", "京E·31979", "电话", "患者", "2025年08月02日", "20250802", "某某市第一人民医院", " ", "，", "x", "9", "\x01", "0539-8591248转7774"]
PIECES = st.sampled_from(_PIECES)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECES, max_size=8).map("".join), min_size=20, max_size=40))
def test_hits_never_overlap_and_redaction_leaves_none(spark, texts):
    own = spark.createDataFrame([(i, 0, 0, t) for i, t in enumerate(texts)], "doc_id int, page int, line int, text string")
    for r in own.select("text", rules.find(F.col("text")).alias("h")).collect():
        spans = sorted((h["start"], h["end"]) for h in r["h"])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        clean = r["text"].replace("\x01", " ")
        assert all(clean[h["start"] : h["end"]] == h["value"] for h in r["h"])
    hits = engine.rule_hits(own)
    black = redact.redact_lines(own, hits, F.lit("black"))
    assert all(len(r["redacted"]) == len(r["text"]) for r in black.collect())


def test_gates_lose_nothing(spark):
    """Every rule finds with its gate what it finds without, on plates of all provinces and on all pieces side by side."""
    places = re.findall("[一-龥]", rules.PLATE_HEAD)
    texts = [f"车{p}A12345。" for p in places] + [a + b for a in _PIECES for b in _PIECES]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(8)
    gated = {r["id"]: r["c"] for r in df.select("id", rules.candidates(F.col("text")).alias("c")).collect()}
    gates, rules.GATES = rules.GATES, dict.fromkeys(rules.GATES, "")
    try:
        open_ = {r["id"]: r["c"] for r in df.select("id", rules.candidates(F.col("text")).alias("c")).collect()}
    finally:
        rules.GATES = gates
    assert len(places) == 31 and gated == open_ and all(gated[i] for i in range(31))


def test_one_long_line(spark):
    text = " ".join("4111111111111111" if i % 4 == 0 else "wörd" for i in range(20_000))
    own = spark.createDataFrame([(1, 0, 0, text)], "doc_id int, page int, line int, text string")
    hits = engine.rule_hits(own)
    seeds = spark.createDataFrame([(1, "wörd wörd", "CUSTOM", 1)], "doc_id int, value string, type string, ord int")
    assert redact.redact_lines(own, hits.unionByName(engine.propagate(own, seeds, hits))).first()["redacted"] == " ".join("[银行卡号] [已删除] wörd" for _ in range(5000))


def test_a_document_of_many_lines(spark):
    """Numbering of seeds and aliases over blocks of lines, and propagation, on one large document beside a small one."""
    n = 50_000
    number = F.lpad(F.col("id").cast("string"), 6, "0")
    big = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page"), F.col("id").cast("int").alias("line"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("mail u"), number, F.lit("@a.example"))).otherwise(F.concat(F.lit("to u"), F.lpad((F.col("id") - F.col("id") % 10).cast("string"), 6, "0"), F.lit("@a"))).alias("text"))
    own = big.unionByName(spark.createDataFrame([(2, 0, 0, "x@y.example")], "doc_id int, page int, line int, text string")).repartition(8)
    hits = engine.rule_hits(own)
    names = {(r["doc_id"], r["value"]): r["alias"] for r in engine.aliases(engine.ranked(hits)).collect()}
    assert len(names) == n // 10 + 1 and all(names[1, f"u{i:06}@a.example"] == f"邮箱{i // 10 + 1}" for i in range(0, n, 10)) and names[2, "x@y.example"] == "邮箱1"
    ranked = engine.ranked(hits).withColumns({"seed": F.lit(True), "type": F.lit("MEDICAL_ID"), "value": F.substring_index("value", ".", 1)})
    seeds = engine.collect_seeds(ranked)
    assert [r["ord"] for r in seeds.where("doc_id = 1").orderBy("ord").collect()] == list(range(1, n // 10 + 1))
    more = engine.propagate(own, seeds.where("ord <= 600"), hits)
    assert more.count() == 600 * 9


def test_dates_are_never_hit(spark):
    dates = ["2025-08-02", "2025年08月02日", "20250802", "2025/8/2 12:03:39", "20250802120339"]
    df = spark.createDataFrame([(d,) for d in dates], "text string")
    assert df.where(F.size(rules.find(F.col("text"))) > 0).count() == 0


def test_aliases_are_one_to_one(spark):
    own = lines.text_lines(spark.createDataFrame([(1, "a@b.example\nc@d.example a@b.example\ne@f.example"), (2, "a@b.example")], "doc_id int, text string"), "doc_id")
    rows = engine.aliases(engine.ranked(engine.rule_hits(own))).collect()
    assert sorted((r["doc_id"], r["value"], r["alias"]) for r in rows) == [(1, "a@b.example", "邮箱1"), (1, "c@d.example", "邮箱2"), (1, "e@f.example", "邮箱3"), (2, "a@b.example", "邮箱1")]


def test_reports_hold_no_values(spark):
    own = lines.text_lines(spark.createDataFrame([(1, "mail secret.person@example.com")], "doc_id int, text string"), "doc_id")
    report = redact.report_json(redact.report_items(engine.rule_hits(own))).first()["report"]
    assert "secret.person" not in report and json.loads(report)["counts"] == {"EMAIL": 1}
    assert "value" not in redact.report_items(engine.rule_hits(own)).columns


def test_styles(spark):
    own = lines.text_lines(spark.createDataFrame([(1, "to a@b.example now")], "doc_id int, text string"), "doc_id")
    hits = engine.rule_hits(own)
    out = {s: redact.redact_lines(own, hits, F.lit(s)).first()["redacted"] for s in ("label", "black", "inpaint", "replace")}
    assert out == {"label": "to [邮箱] now", "black": "to " + "█" * 11 + " now", "inpaint": "to  now", "replace": "to 邮箱 now"}


def test_files_and_templates(spark, tmp_path):
    (tmp_path / "a.txt").write_text("你好", encoding="utf-8")
    (tmp_path / "b.bin").write_bytes(b"%PDF-1.4")
    assert {r["path"].rsplit("/", 1)[1]: r["kind"] for r in files.read_files(spark, str(tmp_path)).collect()} == {"a.txt": "txt", "b.bin": "pdf"}
    folder = tmp_path / "templates"
    folder.mkdir()
    (folder / "ok.json").write_text(json.dumps({"name": "t", "labels": [{"text": "姓名", "type": "PERSON", "box": [0, 0, 1, 1]}]}))
    (folder / "bad.json").write_text("{not json")
    (folder / "none.json").write_text('{"name": "u", "labels": []}')
    assert [r["name"] for r in files.read_templates(spark, str(folder)).collect()] == ["t"]


def test_html_cleaning():
    assert files.clean_html('<p onclick="x">a<script>b</script><a href="u">c</a><img src="http://x/y.png" alt="x"><img src="file:///z"></p>') == "<p>a<a>c</a>[图片：x][图片]</p>"
    assert files.clean_html('<td colspan="2" style="x">1 &lt; 2</td><img src="data:image/png;base64,AA">') == '<td colspan="2">1 &lt; 2</td><img src="data:image/png;base64,AA">'
    assert files.clean_html(None) is None


def test_limiter_decisions():
    rows = [(float(i), False) for i in range(3)] + [(3.0, True), (4.0, False), (11.5, True)]
    got, times = limits.decide([], rows, seconds=10, limit=3)
    assert got == ["rejected"] * 3 + ["limited", "limited", "accepted"] and times == [2.0]


def finish(query) -> None:
    """A stream that reads what is there must end by itself."""
    ended = query.awaitTermination(120)
    query.stop()
    assert ended


def fed(spark, rows, schema, path):
    """A stream of one file a batch, in order."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(path))
        time.sleep(1.1 if i + 1 < len(rows) else 0)  # files are read in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))


def test_limiter_stream(spark, tmp_path):
    schema = "client string, seq long, at double, ok boolean"
    first = [("a", i, 1000.0 + i, False) for i in range(4)] + [("b", 9, 1001.0, True)]
    stream = fed(spark, [first, [("a", 10, 1050.0, True), ("a", 11, 1300.0, True)], [("a", 12, 1301.0, False)]], schema, tmp_path / "in")
    limited = limits.limiter(stream, seconds=100, limit=3)
    finish(limited.writeStream.format("memory").queryName("decisions").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    rows = sorted((r["client"], r["seq"], r["decision"]) for r in spark.table("decisions").collect())
    assert rows == [("a", 0, "rejected"), ("a", 1, "rejected"), ("a", 2, "rejected"), ("a", 3, "limited"), ("a", 10, "limited"), ("a", 11, "accepted"), ("a", 12, "rejected"), ("b", 9, "accepted")]


def test_expiry_stream(spark, tmp_path):
    at = lambda s: datetime(2025, 1, 1, 0, 0, s)
    schema = "job_id string, ts timestamp, status string, expires timestamp"
    first = [("due", at(0), "succeeded", at(10)), ("open", at(0), "running", at(10)), ("later", at(0), "failed", at(59)), ("gone", at(0), "failed", at(10)), ("gone", at(1), "deleted", at(10))]
    rest = [[("clock", at(30), "queued", at(59))], [("open", at(31), "succeeded", at(10))], [("clock", at(40), "queued", at(59))]]
    due = limits.expire(fed(spark, [first, *rest], schema, tmp_path / "in"), "1 second")
    finish(due.writeStream.format("memory").queryName("due").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    assert sorted((r["job_id"], r["expires"]) for r in spark.table("due").collect()) == [("due", at(10)), ("open", at(10))]


def test_redaction_stream(spark, tmp_path):
    stream = fed(spark, [[(1, "x a@b.example y"), (2, "card 4111111111111111")]], "doc_id int, text string", tmp_path / "in")
    finish(limits.redact_stream(stream, lambda df, n: df.write.mode("append").json(str(tmp_path / "out")), str(tmp_path / "c")))
    assert sorted(r["redacted"] for r in spark.read.json(str(tmp_path / "out")).collect()) == ["card [银行卡号]", "x [邮箱] y"]


def test_empty_and_null_lines(spark):
    own = lines.text_lines(spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string"), "doc_id")
    assert engine.rule_hits(own).count() == 0 and redact.redact_lines(own, engine.rule_hits(own)).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
