"""The general queries over a table that holds all rule types, against the hits of the literal cases."""

from spanveil.plans import registry
from tests.literal_cases import RULE_HITS, RULE_LINES


def test_general_queries_cover_all_rules(spark, tmp_path):
    docs = [(i, t, "en", "s", len(t or "")) for i, t in RULE_LINES]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    q = lambda name: [r.asDict() for r in registry.queries()[name](spark, str(tmp_path)).collect()]
    want = sorted((i, t, a, b, v) for i, t, a, b, v in RULE_HITS)
    types = [t for _, t, *_ in want]
    assert {"ID_CARD", "PHONE", "ORG", "PLATE"} <= set(types)
    assert sorted((r["doc_id"], r["type"], r["start"], r["end"], r["value"]) for r in q("resolved_hits")) == want
    per_type = {t: types.count(t) for t in types}
    assert {r["type"]: r["n"] for r in q("entity_counts")} == per_type
    assert {r["type"]: r["n"] for r in q("counts_by_lang")} == per_type
    assert {r["type"]: r["n"] for r in q("entity_counts_rollup") if r["doc_id"] is None} == {None: len(want)}
    assert sorted(r["type"] for r in q("report_items")) == sorted(types)
    assert max(r["n"] for r in q("page_meta")) == len(want)
    assert {r["type"]: (r["before"], r["residual"]) for r in q("residual_check")} == {t: (n, 0) for t, n in per_type.items()}
    black = {i: list(t) for i, t in RULE_LINES if t is not None}
    for i, _, a, b, _ in want:
        black[i][a:b] = "█" * (b - a)
    assert {r["doc_id"]: r["redacted"] for r in q("redact_black")} == {i: "".join(t) for i, t in black.items()}
    for name in ("redact_label", "redact_run"):
        lines = {r["doc_id"]: r["redacted"] for r in q(name)}
        assert len(lines) == len(black) and not any(v in lines[i] for i, _, _, _, v in want), name
