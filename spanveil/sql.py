"""The library in SQL text: functions id_card_ok, luhn_ok, uscc_ok, and detect_entities, a table function for LATERAL.

    SELECT doc_id, d.* FROM documents, LATERAL detect_entities(text) d

The checks are SQL functions, which the optimiser puts into the query as expressions. detect_entities is a table function over Arrow batches, with the patterns of
`operators.rules` and the same order of precedence; tests hold both against each other.

Defined cases: null texts have no entities; the checks of a null value are false. Lines are parted at \\n; offsets are code points of the line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanveil.functions import validators
from spanveil.operators import rules
from spanveil.session import ship

_CHARS = "filter(split({0}, ''), c -> c <> '')"
_SUM = "aggregate(transform(slice({0}, 1, {1}), (c, i) -> {2}), 0, (a, x) -> a + x)"


def _id_card_sql() -> str:
    up = "upper(s)"
    weights = ", ".join(map(str, validators.ID_WEIGHTS))
    total = _SUM.format(_CHARS.format(up), 17, f"coalesce(try_cast(c AS INT), 0) * array({weights})[i]")
    date = f"try_to_timestamp(substring({up}, 7, 8), 'yyyyMMdd') IS NOT NULL AND try_cast(substring({up}, 7, 4) AS INT) BETWEEN 1900 AND 2100"
    return rf"coalesce(CASE WHEN {up} RLIKE '\\A[0-9]{{17}}[0-9X]\\z' THEN {date} AND substring('{validators.ID_CHECK}', pmod({total}, 11) + 1, 1) = substring({up}, 18, 1) END, false)"


def _uscc_sql() -> str:
    weights = ", ".join(str(pow(3, k, 31)) for k in range(17))
    total = _SUM.format(_CHARS.format("s"), 17, f"(locate(c, '{validators.USCC_ALPHABET}') - 1) * array({weights})[i]")
    return rf"coalesce(CASE WHEN s RLIKE '\\A[{validators.USCC_ALPHABET}]{{18}}\\z' THEN substring('{validators.USCC_ALPHABET}', pmod(31 - pmod({total}, 31), 31) + 1, 1) = substring(s, 18, 1) END, false)"


def _plain(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.A)


_ANY_CHECK = {
    "id": lambda v: _id_ok(v), "uscc": lambda v: _uscc_ok(v), "bank": lambda v: _luhn(v) and not _WHOLE_DATE.fullmatch(v), "grouped": lambda v: 16 <= len(_digits(v)) <= 19 and _luhn(_digits(v)),
}
_WHOLE_DATE = _plain(rules.DATE)
#: Priority, type, pattern, group that is the span, check of the value.
_NUMBERS = [
    (1, "ID_CARD", _plain(rules.ID), 0, "id"), (2, "USCC", _plain(rules.USCC), 0, "uscc"), (3, "PHONE", _plain(rules.MOBILE), 0, ""), (4, "PHONE", _plain(rules.LANDLINE), 0, ""),
    (5, "PHONE", _plain(f"(?:{rules.LOOSE_CUE})({rules.LOOSE})"), 1, ""), (6, "BANK_CARD", _plain(rules.BANK), 0, "bank"), (7, "BANK_CARD", _plain(rules.BANK_GROUPED), 0, "grouped"),
    (8, "ID_CARD", _plain(f"(?:{rules.TRAVEL_CUE})({rules.TRAVEL})"), 1, ""), (9, "EMAIL", _plain(rules.EMAIL), 0, ""), (10, "PLATE", _plain(rules.PLATE), 0, ""),
]
_HOSPITAL = _plain("[一-龥]{2,20}?" + rules.HOSPITAL_SUFFIX + "(?:[一-龥]{0,6}(?:院区|分院))?")
_COMPANY = _plain("[一-龥（）()]{2,30}?" + rules.ORG_SUFFIX)
_BAD = _plain("(?:" + "|".join(rules.BAD_PREFIX) + ")*+")
_BOUNDS = [_plain(f"^.*{w}") for w in ("(?:" + "|".join(rules.BOUNDARY_WORDS) + ")", f"[{rules.BOUNDARY_CHARS}]")]


def _digits(v: str) -> str:
    return re.sub("[^0-9]", "", v)


def _luhn(v: str) -> bool:
    return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(v))) % 10 == 0


def _id_ok(v: str) -> bool:
    from datetime import date

    v = v.upper()
    try:
        date(int(v[6:10]), int(v[10:12]), int(v[12:14]))
    except ValueError:
        return False
    return 1900 <= int(v[6:10]) <= 2100 and validators.ID_CHECK[sum(int(c) * w for c, w in zip(v, validators.ID_WEIGHTS)) % 11] == v[17]


def _uscc_ok(v: str) -> bool:
    letters = validators.USCC_ALPHABET
    return all(c in letters for c in v) and letters[-sum(letters.index(c) * pow(3, k, 31) for k, c in enumerate(v[:17])) % 31] == v[17]


def _organisations(line: str) -> Iterator[tuple[int, int, int]]:
    """(priority, start, end) of hospitals and companies, without what stands before the name."""
    for prio, pattern, suffix in ((11, _HOSPITAL, rules.HOSPITAL_SUFFIX), (12, _COMPANY, rules.ORG_SUFFIX)):
        for m in pattern.finditer(line):
            head = re.match(f"^(.*?){suffix}", m[0])[1]
            start = m.start() + max((len(b[0]) for p in _BOUNDS if (b := p.match(head))), default=0)
            value = line[start : m.end()]
            if prio == 11:
                start += len(_BAD.match(value)[0])
                value = line[start : m.end()]
                if len(re.sub(suffix + ".*$", "", value)) < 2:
                    continue
            elif len(value) < 5 or value.endswith("银行") and line[m.end() : m.end() + 1] in ("卡", "账", "帐"):
                continue
            yield prio, start, m.end()


def entities(line: str, only: frozenset[int] | None = None) -> list[tuple[int, str, int, int]]:
    """(priority, type, start, end) of a line: candidates by priority and start, each kept if it overlaps none before it. Rules outside `only` (priorities) don't run."""
    own = [r for r in _NUMBERS if only is None or r[0] in only]
    found = [(prio, m.start(group), m.end(group), kind) for prio, kind, pattern, group, check in own for m in pattern.finditer(line) if not check or _ANY_CHECK[check](m[group])]
    if only is None or only & {11, 12}:
        found += [(prio, a, b, "ORG") for prio, a, b in _organisations(line) if only is None or prio in only]
    kept: list[tuple[int, int, int, str]] = []
    for c in sorted(found):
        if not any(c[1] < k[2] and k[1] < c[2] for k in kept):
            kept.append(c)
    return [(prio, kind, a, b) for prio, a, b, kind in kept]


@F.udtf(returnType="line int, type string, start int, end int, value string", useArrow=True)
class DetectEntities:
    """Rows (line, type, start, end, value) of a text, of all rules or of the priorities in an array; batches travel as Arrow."""

    def eval(self, text: str, only: list[int] | None = None):
        chosen = None if only is None else frozenset(int(p) for p in only)
        for k, line in enumerate((text or "").split("\n")):
            for _, kind, a, b in sorted(entities(line, chosen), key=lambda e: e[2]):
                yield k, kind, a, b, line[a:b]


def register(spark: SparkSession) -> None:
    """Make the functions known to spark.sql, for this session."""
    ship(spark)
    for name, body in (("id_card_ok", _id_card_sql()), ("uscc_ok", _uscc_sql()), ("luhn_ok", "coalesce(luhn_check(s), false)")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS BOOLEAN RETURN {body}")
    spark.udtf.register("detect_entities", DetectEntities)
