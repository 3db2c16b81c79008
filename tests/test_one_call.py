"""The one-call form against a slow version over whole tables: rules, seeds, propagation with differences, labels."""

import json
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from spanveil import api, catalog, sql
from spanveil.operators import engine, lines, redact
from spanveil.plans.registry import queries
from spanveil.session import table

SF = "/root/testdata/sf0.001"
LABELS = {e[0]: e[1] for e in catalog.ENTITIES}
SEEDS = [t for t in engine.SEED_TYPES if t not in ("PERSON", "STAFF")]


def differences(a, b):
    return sum(x != y for x, y in zip(a, b))


def slow_hits(texts):
    """(page, line, type, start, end, value, further) of one document's lines."""
    own, seeds = [], {}
    for k, line in enumerate(texts):
        for prio, kind, a, b in sorted(sql.entities(line)):
            own.append((k, kind, a, b, line[a:b]))
            least = {"ORG": 4, "ADDRESS": 8}.get(kind, 5)
            if kind in SEEDS and b - a >= least:
                seeds.setdefault(line[a:b], kind)
    further = []
    for k, line in enumerate(texts):
        taken = [(a, b) for j, _, a, b, _ in own if j == k]
        for value, kind in seeds.items():
            n, near = len(value), max(1, len(value) // 6)
            places = [(0, i) for i in range(len(line) - n + 1) if line[i : i + n] == value]
            if kind == "ORG" and n >= 6:
                places += [(1, i) for i in range(len(line) - n + 1) if line[i + n - 1] == value[-1] and 1 <= differences(line[i : i + n], value) <= near]
            for _, i in places:
                if not any(i < b and a < i + n for a, b in taken):
                    taken.append((i, i + n))
                    further.append((k, kind, i, i + n, value))
    return own, further


def slow_lines(text):
    own, further = slow_hits(text.split("\n"))
    out = []
    for k, line in enumerate(text.split("\n")):
        at, made = 0, ""
        for a, b, kind in sorted((a, b, kind) for j, kind, a, b, _ in own + further if j == k):
            made += f"{line[at:a]}[{LABELS[kind]}]"
            at = b
        out.append(made + line[at:])
    return out


def with_companies(spark):
    """The documents, and some that name companies rightly and with a sign or two changed."""
    rng = random.Random(5)
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    name = lambda n: "".join(rng.choice("澄岚晨星瑶光昭华锦程") for _ in range(n))
    for k in range(30):
        orgs = [name(rng.choice([3, 6, 10])) + rng.choice(["有限公司", "人民政府", "第一人民医院"]) for _ in range(3)]
        rows = []
        for _ in range(12):
            o = list(rng.choice(orgs))
            for _ in range(rng.randrange(4)):
                o[rng.randrange(len(o))] = rng.choice("口日甲")
            rows.append(rng.choice(["见 ", "x", ""]) + "".join(o) + rng.choice(["，", " 4111111111111111", " a.b@c.de", ""]))
        docs.append((100_000 + k, "\n".join([*orgs, *rows])))
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    return with_companies(spark)


def test_propagation_with_many_seeds_a_document(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    own = lines.text_lines(df, "doc_id")
    hits = engine.rule_hits(own)
    seeds = engine.collect_seeds(engine.ranked(hits).withColumn("seed", F.lit(True)))
    found = engine.propagate(own, seeds, hits).select("doc_id", "line", "type", "start", "end", "value").collect()
    want = sorted((d, *h) for d, t in docs if t is not None for h in slow_hits(t.split("\n"))[1])
    assert sorted(map(tuple, found)) == want and len(want) > 30
    assert sum(len(set(s["value"] for s in found if s["doc_id"] == d)) > 1 for d in {r["doc_id"] for r in found}) > 3


def test_redacted_lines_of_the_one_call_form(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = api.run(df, api.Options(default_style="label")).lines.select("doc_id", "line", "redacted").collect()
    assert sorted(map(tuple, found)) == sorted((d, k, x) for d, t in docs if t is not None for k, x in enumerate(slow_lines(t)))


def test_reports_hold_the_counts_and_no_values(spark):
    found = {r["doc_id"]: json.loads(r["report"]) for r in queries()["report_json"](spark, SF).collect()}
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    want = {}
    for d, t in docs.items():
        for _, kind, _, _, _ in slow_hits((t or "").split("\n"))[0]:
            want.setdefault(d, {}).setdefault(kind, 0)
            want[d][kind] += 1
    assert {d: r["counts"] for d, r in found.items()} == want
    for d, report in found.items():
        assert len(report["items"]) == sum(want[d].values()) and all(set(i) == {"page", "type", "source", "box"} for i in report["items"])
        assert not any(v in json.dumps(report) for _, _, _, _, v in slow_hits(docs[d].split("\n"))[0])


def test_redaction_by_rules_needs_no_exchange(spark):
    plan = queries()["redact_label"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    df = spark.createDataFrame([(1, 0, 0, "mail a@b.com, card 4111111111111111."), (1, 0, 1, None), (1, 0, 2, "none")], "doc_id int, page int, line int, text string")
    assert [r["redacted"] for r in redact.redact_own(df).orderBy("line").collect()] == [r["redacted"] for r in redact.redact_lines(df, engine.rule_hits(df)).orderBy("line").collect()]


class Words(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.tags, self.attributes = [], set(), set()

    def handle_starttag(self, tag, attrs):
        self.tags.add(tag)
        self.attributes |= {k for k, _ in attrs}

    def handle_data(self, data):
        self.out += data.split()


def test_cleaned_pages_hold_their_words_and_no_scripts(spark):
    sources = {r["page_id"]: r["html"] for r in table(spark, SF, "pages").collect()}
    for r in queries()["sanitise_html"](spark, SF).collect():
        if r["html"]:
            words, whole = Words(), Words()
            words.feed(r["html"])
            whole.feed(sources[r["page_id"]])
            assert not words.tags & {"script", "style", "iframe", "object", "form", "meta", "link"} and not any(a.startswith("on") for a in words.attributes)
            body = sources[r["page_id"]].split("<article>")[1].split("</article>")[0] if "<article>" in sources[r["page_id"]] else ""
            story = Words()
            story.feed(body)
            there = iter(words.out)
            assert all(any(w == x for x in there) for w in story.out), r["page_id"]
