import pytest

from spanveil import api

TEXT = "mail a@b.example card 4111111111111111\nagain 4111111111111111 and Codename\nnothing"


def test_options():
    assert api.parse_options(None) == api.Options() and api.parse_options("{}") == api.Options()
    o = api.parse_options('{"entities": ["EMAIL"], "default_style": "black", "styles": {"EMAIL": "hatch"}, "custom_words": [" ab ", "c", 5], "mode": "odd", "dpi": 300, "verify": false}')
    assert (o.entities, o.default_style, o.styles, o.custom_words, o.mode, o.dpi, o.verify) == (frozenset({"EMAIL"}), "black", {"EMAIL": "hatch"}, ("ab",), "balanced", 300, False)
    for bad in ("{", '{"entities": ["X"]}', '{"default_style": "x"}', '{"styles": {"X": "black"}}', '{"styles": {"EMAIL": "x"}}'):
        with pytest.raises(api.OptionsError):
            api.parse_options(bad)


def test_run(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None)], "doc_id int, text string")
    out = api.run(docs, api.parse_options('{"custom_words": ["Codename"], "styles": {"BANK_CARD": "replace"}}'))
    assert [r["redacted"] for r in out.lines.orderBy("line").collect()] == ["mail [邮箱] card 银行卡号1", "again 银行卡号1 and [已删除]", "nothing"]
    assert "value" not in out.items.columns and out.items.count() == 4
    assert {r["alias"] for r in out.aliases.collect()} == {"邮箱1", "银行卡号1", "已删除1"}
    assert api.health()["entities"] == 18
