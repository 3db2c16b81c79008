"""Structured entities on one line of text: patterns by priority, first come first served. No Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions.text import find_all, first_come, let
from spanveil.functions.validators import id_card_ok, luhn_ok, uscc_ok

# Patterns of the number formats, and words around organisation names. Digits are ASCII.
ID = r"(?<![0-9A-Za-z])\d{17}[\dXx](?![0-9A-Za-z])"
USCC = r"(?<![0-9A-Z])[0-9A-HJ-NP-RTUWXY]{2}\d{6}[0-9A-HJ-NP-RTUWXY]{10}(?![0-9A-Z])"
MOBILE = r"(?<!\d)(?:\+?86[- ]?)?1[3-9]\d[- ]?\d{4}[- ]?\d{4}(?!\d)"
LANDLINE = r"(?<![\d-])0\d{2,3}[-－—]\d{7,8}(?:\s*(?:转|分机|[Ee][Xx][Tt]\.?)\s*\d{1,5})?(?!\d)"
LOOSE_CUE = r"(?:电话|联系|手机|座机|传真|[Tt][Ee][Ll])[^\d]{0,4}"
LOOSE = r"0\d{2,3}[.·_ ]\d{7,8}(?![\d.])"
BANK = r"(?<!\d)\d{16,19}(?!\d)"
BANK_GROUPED = r"(?<![\d ])\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,4})?(?!\d)"
TRAVEL_CUE = r"(?:护照|通行证|台胞证|回乡证|证件)(?:号码|号)?[^\dA-Za-z]{0,6}"
TRAVEL = r"[A-Z]{1,2}\d{7,9}(?![\dA-Za-z])"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PLATE_HEAD = r"[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼][A-HJ-NP-Z]"
PLATE = PLATE_HEAD + r"[·•.\s]?[A-HJ-NP-Z0-9]{4}[A-HJ-NP-Z0-9挂学警港澳]{1,2}"
DATE = r"(?:(?:19|20)\d{2}[-/.年]\d{1,2}[-/.月]\d{1,2}|(?:19|20)\d{6}(?:\d{4,6})?)"
HOSPITAL_SUFFIX = "(?:医院|卫生院|卫生服务中心|卫生服务站|保健院|医疗中心|医学中心|诊所|门诊部|急救中心|疾病预防控制中心|体检中心|血站|医科大学|医学院)"
ORG_SUFFIX = "(?:有限责任公司|股份有限公司|有限公司|集团|银行|保险公司|事务所|委员会|管理局|人民政府)"
BAD_PREFIX = "转入 转出 转往 送往 前往 送至 转至 就诊于 住院于 其他 上级 本院 该院 我院 贵院 外院 医嘱 转院 拟接收 接收 当地 各级 定点 基层 社区卫生 乡镇 医疗机构 同级 专科 综合 到 至 在 去 于 往 来 及 或 和 等".split()
BOUNDARY_WORDS = "患者 本人 家属 同意 告知 须知 住院 入院 出院 就诊 转诊 转往 转至 转入 转出 期间 治疗 手术 我院 本院 该院 贵院 如需 需要 以下 前往 送往 签署 协议 规定 所有".split()
BOUNDARY_CHARS = "在到于往至经由从的是请对"

HIT = "array<struct<prio:int,start:int,end:int,type:string,value:string>>"
#: A line without a trait below has no match of these priorities: each is part of all their patterns.
GATES = {"number": r"\d{4}", "mail": "@", "chinese": "[一-龥]", "plate": PLATE_HEAD, "org": HOSPITAL_SUFFIX + "|" + ORG_SUFFIX}


#: Priorities of the rules for long digit runs that pass the Luhn test and for e-mail addresses: those that SQL can state.
PLAIN = frozenset({6, 9})


def _hits(prio: int, kind: str, found: Column, ok=None) -> Column:
    kept = F.filter(found, ok) if ok else found
    return F.transform(
        kept,
        lambda x: F.struct(F.lit(prio).alias("prio"), x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("type"), x["value"].alias("value")),
    )


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _cut(span: Column, suffix: str) -> Column:
    """The span without what stands before the name: after the last boundary word or character ahead of the suffix."""
    # All boundary words are of one length, so the last to start is the last to end.
    ends = lambda head: F.greatest(*[F.length(F.regexp_extract(head, f"^.*{w}", 0)) for w in ("(?:" + "|".join(BOUNDARY_WORDS) + ")", f"[{BOUNDARY_CHARS}]")])
    return let(F.regexp_extract(span["value"], f"^(.*?){suffix}", 1), lambda head: _drop(span, ends(head)))


def _drop(span: Column, n: Column) -> Column:
    v = span["value"]
    return F.struct((span["start"] + n).alias("start"), span["end"].alias("end"), F.substring(v, n + 1, F.length(v)).alias("value"))


def _hospitals(text: Column) -> Column:
    found = find_all(text, "[一-龥]{2,20}?" + HOSPITAL_SUFFIX + "(?:[一-龥]{0,6}(?:院区|分院))?")
    named = F.transform(found, lambda s: _cut(s, HOSPITAL_SUFFIX))
    bare = F.transform(named, lambda s: _drop(s, F.length(F.regexp_extract(s["value"], "^(?:" + "|".join(BAD_PREFIX) + ")*+", 0))))
    return F.filter(bare, lambda s: F.length(F.regexp_replace(s["value"], HOSPITAL_SUFFIX + ".*$", "")) >= 2)


def _companies(text: Column) -> Column:
    named = F.transform(find_all(text, "[一-龥（）()]{2,30}?" + ORG_SUFFIX), lambda s: _cut(s, ORG_SUFFIX))
    bank_thing = lambda s: F.endswith(s["value"], F.lit("银行")) & F.substring(text, s["end"] + 1, F.lit(1)).isin("卡", "账", "帐")
    return F.filter(named, lambda s: (F.length(s["value"]) >= 5) & ~bank_thing(s))


def candidates(text: Column, only: frozenset[int] | None = None) -> Column:
    """All candidates of a line with their rule's priority, in order of priority and start; of all rules, or `only` those of some priorities."""
    none = F.array().cast(HIT)
    runs = lambda prio: only is None or prio in only
    hits = lambda prio, kind, found, ok=None: _hits(prio, kind, found(), ok) if runs(prio) else None

    def gated(gate: str, *parts: Column | None) -> Column | None:
        own = [p for p in parts if p is not None]
        return F.when(F.rlike(text, F.lit(GATES[gate])), F.concat(*own) if len(own) > 1 else own[0]).otherwise(none) if own else None

    whole_date = lambda v: F.rlike(v, F.lit(rf"\A{DATE}\z"))
    numbers = gated(
        "number",
        hits(1, "ID_CARD", lambda: find_all(text, ID), lambda x: id_card_ok(x["value"])),
        hits(2, "USCC", lambda: find_all(text, USCC), lambda x: uscc_ok(x["value"])),
        hits(3, "PHONE", lambda: find_all(text, MOBILE)),
        hits(4, "PHONE", lambda: find_all(text, LANDLINE)),
        hits(5, "PHONE", lambda: find_all(text, LOOSE, LOOSE_CUE)),
        hits(6, "BANK_CARD", lambda: find_all(text, BANK), lambda x: luhn_ok(x["value"]) & ~whole_date(x["value"])),
        hits(7, "BANK_CARD", lambda: find_all(text, BANK_GROUPED), lambda x: F.length(_digits(x["value"])).between(16, 19) & luhn_ok(_digits(x["value"]))),
        hits(8, "ID_CARD", lambda: find_all(text, TRAVEL, TRAVEL_CUE)),
    )
    plates = gated("plate", hits(10, "PLATE", lambda: find_all(text, PLATE)))
    organisations = gated("org", hits(11, "ORG", lambda: _hospitals(text)), hits(12, "ORG", lambda: _companies(text)))
    found = [numbers, gated("mail", hits(9, "EMAIL", lambda: find_all(text, EMAIL))), gated("chinese", plates, organisations)]
    return F.concat(none, *[f for f in found if f is not None])


def find(text: Column, only: frozenset[int] | None = None) -> Column:
    """Accepted hits of a line: array<struct<prio, start, end, type, value>>; a later rule never overlaps an earlier one.

    Types that a caller does not want must be filtered afterwards: they still claim their spans. Rules outside `only` don't run and claim nothing.
    A null line has no hits.
    """
    return first_come(F.array_sort(candidates(F.coalesce(text, F.lit("")), only)), HIT)
