"""Functions in SQL, queue, progress and the data source."""

import os
import random

import pytest
from pyspark.sql import functions as F

from spanveil import lexicon, sql
from spanveil.functions import validators as v
from spanveil.operators import rules
from spanveil.sources import tagged
from spanveil.streaming import progress, queue
from tests.literal_cases import RULE_LINES

SF = "/root/testdata/sf0.001"


def test_every_surname(spark):
    rows = spark.createDataFrame([(s + "小明",) for s in [*lexicon.SURNAMES, *lexicon.COMPOUND_SURNAMES]] + [("乜翀",), ("小",), (None,)], "name string")
    found = rows.select("name", v.surname_start(F.col("name")).alias("ok"), v.is_name(F.col("name")).alias("is")).collect()
    assert [r["ok"] for r in found] == [True] * 413 + [False] * 3 and len(set(lexicon.SURNAMES)) == 397
    assert sum(r["is"] for r in found) >= 400


def test_table_function_equals_the_rules(spark):
    sql.register(spark)
    rng = random.Random(3)
    piece = lambda: rng.choice(["13800138000", "11010519491231002X", "4111111111111111", "4111 1111 1111 1111", "a.b@c.de", "010-12345678", "电话", "京A12345", "北京协和医院", "澄岚晨星科技有限公司", "患者在", "转入", " ", "x", "护照E12345678", "91350100M000100Y43", "20250802", "银行卡", "建设银行"])
    texts = [t for _, t in RULE_LINES] + ["".join(piece() for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(9999, None)], "id int, text string")
    rows.createOrReplaceTempView("some_lines")
    got = spark.sql("SELECT id, d.type, d.start, d.`end` FROM some_lines, LATERAL detect_entities(text) d").collect()
    want = rows.select("id", F.explode(rules.find(F.col("text"))).alias("h")).select("id", "h.type", "h.start", "h.end").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 300


def test_checks_in_sql_equal_the_columns(spark):
    sql.register(spark)
    rng = random.Random(4)
    ids = ["11010519491231002X", "11010519491231002x", "110105194902310028", None, ""] + ["1101051949" + "".join(rng.choice("0123456789") for _ in range(8)) for _ in range(300)] + ["110105" + f"19{k:02d}0101{k:03d}" + c for k in range(20) for c in "0123456789X"]
    codes = ["91350100M000100Y43"] + ["91350100M000100Y4" + c for c in v.USCC_ALPHABET] + ["91350100M000100YIO"]
    rows = spark.createDataFrame([(x,) for x in ids + codes], "s string")
    rows.createOrReplaceTempView("some_values")
    got = spark.sql("SELECT id_card_ok(s) AS a, uscc_ok(s) AS b, luhn_ok(s) AS c FROM some_values").collect()
    want = rows.select(v.id_card_ok(F.col("s")).alias("a"), v.uscc_ok(F.col("s")).alias("b"), v.luhn_ok(F.col("s")).alias("c")).collect()
    assert got == want and sum(r["a"] for r in got) > 10 and sum(r["b"] for r in got) >= 2


def _inbox(spark, tmp_path) -> tuple[str, object]:
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    orders.repartition(6, "o_orderkey").write.parquet(f"{tmp_path}/inbox")
    return f"{tmp_path}/inbox", orders


def test_queue_killed_and_started_again_ends_as_a_clean_run(spark, tmp_path):
    inbox, orders = _inbox(spark, tmp_path)
    work = lambda rows: rows.withColumn("fee", F.round(F.col("o_totalprice") * 0.1, 2))
    schema = work(orders).schema
    run = lambda name, before=None: queue.work_off(spark, inbox, orders.schema, work, f"{tmp_path}/{name}", f"{tmp_path}/{name}-checkpoint", 2, before=before)
    assert run("clean").awaitTermination(120)
    want = sorted(map(tuple, queue.finished(spark, f"{tmp_path}/clean", schema).drop("batch").collect()))
    assert want == sorted(map(tuple, work(orders).collect()))

    def die(number: int) -> None:
        if number == 1:
            raise RuntimeError("killed")

    # First it dies with a batch half-written, then before its commit, after the rows are whole.
    os.makedirs(f"{tmp_path}/killed/batch=1")
    orders.limit(3).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/killed/batch=1")
    os.remove(f"{tmp_path}/killed/batch=1/_SUCCESS")
    with pytest.raises(Exception, match="killed"):
        run("killed", die).awaitTermination(120)
    assert not queue.done(spark, f"{tmp_path}/killed", 1)
    assert run("killed").awaitTermination(120)
    found = queue.finished(spark, f"{tmp_path}/killed", schema)
    assert sorted(map(tuple, found.drop("batch").collect())) == want
    again = orders.limit(1).withColumn("fee", F.lit(0.0))
    assert not queue.put_batch(again, f"{tmp_path}/killed", 1)  # a batch that is run again changes nothing
    assert sorted(map(tuple, queue.finished(spark, f"{tmp_path}/killed", schema).drop("batch").collect())) == want
    assert queue.finished(spark, f"{tmp_path}/nothing", schema).count() == 0


def test_throttle():
    told, now = [], [0.0]
    throttle = progress.Throttle(lambda p, m: told.append((p, m)), lambda: now[0])
    for at, share in ((0.0, 0.0), (0.1, 0.1), (0.39, 0.2), (0.5, 0.12345), (0.6, 0.5), (0.61, 0.99), (0.62, 1.0)):
        now[0] = at
        throttle(share, str(share))
    assert told == [(0.0, "0.0"), (0.123, "0.12345"), (0.99, "0.99"), (1.0, "1.0")]


def test_listener_counts_what_a_stream_observes(spark, tmp_path):
    inbox, orders = _inbox(spark, tmp_path)
    told = []
    listener = progress.Listener("watched", orders.count(), lambda p, m: told.append((p, m)), iter(range(1000)).__next__)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 2).parquet(inbox).observe("watched", F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))
        assert stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
        import time

        for _ in range(100):
            if told and told[-1][1] == "done":
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.sums == {"n": orders.count(), "keys": orders.agg(F.sum("o_custkey")).first()[0]} and told[-1] == (1.0, "done") and told[0][1] == "started"


def test_tagged_round_trip_and_abort(spark, tmp_path):
    tagged.register(spark)
    rows = [(str(k), t, [(0, 1, "X")] * (k % 3)) for k, t in enumerate(["a\nb", "é李\U0001f600", "", "long " * 900] * 50)] + [(None, None, [])]
    df = spark.createDataFrame(rows, tagged.SCHEMA).repartition(5)
    path = f"{tmp_path}/corpus"
    key = lambda d: sorted(((r["id"], r["text"], [tuple(e) for e in r["entities"]]) for r in d.collect()), key=str)
    want = key(df)
    df.write.format("tagged").mode("append").save(path)
    assert key(spark.read.format("tagged").load(path)) == want
    small = spark.read.format("tagged").option("piece", 1000).load(path)  # lines across many stretches
    assert small.rdd.getNumPartitions() > 100 and key(small) == want
    before = sorted(os.listdir(path))

    @F.udf("string")
    def broken(x):
        if x == "7":
            raise ValueError("stop")
        return x

    with pytest.raises(Exception, match="stop"):
        df.withColumn("id", broken("id")).write.format("tagged").mode("append").save(path)
    assert sorted(os.listdir(path)) == before  # an aborted write leaves nothing
    df.limit(3).write.format("tagged").mode("overwrite").save(path)
    assert spark.read.format("tagged").load(path).count() == 3
    os.makedirs(f"{tmp_path}/none")
    assert spark.read.format("tagged").load(f"{tmp_path}/none").count() == 0
    with open(f"{tmp_path}/bad.jsonl", "w") as f:
        f.write("not json\n")
    with pytest.raises(Exception, match="no tagged line"):
        spark.read.format("tagged").load(f"{tmp_path}/bad.jsonl").collect()
