"""DuckDB SQL of all twelve rules for structured entities.

Its patterns know no look-around. Where a rule looks around a match, either the longest runs that hold one are cut out and tried from each of their places, or the ends of
runs are marked in the text. Spans are 0-based, s to e, as in the rules.
"""

from __future__ import annotations

from spanveil.functions import validators as v
from spanveil.operators import rules

_WEIGHTS = "[" + ", ".join(map(str, v.ID_WEIGHTS)) + "]"
_POWERS = "[" + ", ".join(str(pow(3, k, 31)) for k in range(17)) + "]"
_BLANK = r"[ \t\n\x0B\f\r]"
_GROUPED = "[0-9]{4}(?:[ -][0-9]{4}){3}"
_USCC = "[0-9A-HJ-NP-RTUWXY]{2}[0-9]{6}[0-9A-HJ-NP-RTUWXY]{10}"
_MOBILE = "1[3-9][0-9][- ]?[0-9]{4}[- ]?[0-9]{4}"
_LANDLINE = "0[0-9]{2,3}[-－—][0-9]{7,8}"
_LOOSE_CUE = "(?:电话|联系|手机|座机|传真|[Tt][Ee][Ll])[^0-9]{0,4}"
_TRAVEL_CUE = "(?:护照|通行证|台胞证|回乡证|证件)(?:号码|号)?[^0-9A-Za-z]{0,6}"


def _let(name: str, value: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _fenced(text: str, pattern: str, fence: str = r"chr(1) || '\0' || chr(1)") -> str:
    """Matches of a pattern: [{s, v}]. The text is split at fences around them; the marks of runs' ends, chr(2), don't count."""
    plain = "replace({}, chr(2), '')".format
    start = f"CAST(coalesce(list_sum(list_transform(p[1:k - 1], lambda x: length({plain('x')}))), 0) AS BIGINT)"
    spans = f"list_transform(range(2, len(p), 2), lambda k: struct_pack(s := {start}, v := {plain('p[k]')}))"
    return _let("p", f"string_split(regexp_replace({text}, '{pattern}', {fence}, 'g'), chr(1))", spans)


def _tried(text: str, inside: str, core: str, more: str, behind: str) -> str:
    """Matches of core + more with no digit behind and none of a class before, leftmost first: tried from each place of the runs of a class that hold core."""
    at = f"regexp_extract(substring(r.v, i), '^({core}{more})(?:[^0-9]|$)', 1)"
    places = f"list_filter(range(1, length(r.v) + 1), lambda i: (i = 1 OR NOT regexp_matches(substring(r.v, i - 1, 1), '{behind}')) AND {at} <> '')"
    found = f"list_transform({places}, lambda i: [struct_pack(s := r.s + i - 1, v := {at})])"
    free = f"list_reduce(list_prepend([struct_pack(s := CAST(-1 AS BIGINT), v := '')], {found}), lambda a, b: CASE WHEN b[1].s >= a[-1].s + length(a[-1].v) THEN list_concat(a, b) ELSE a END)[2:]"
    return f"flatten(list_transform({_fenced(text, f'{inside}*{core}{inside}*')}, lambda r: {free}))"


def _hits(prio: int, gate: str, found: str, ok: str = "TRUE") -> str:
    """[{prio, s, e}] of what is found and passes, in texts that hold the gate's pattern."""
    return f"CASE WHEN regexp_matches(text, '{gate}') THEN list_transform(list_filter({found}, lambda h: {ok}), lambda h: struct_pack(prio := {prio}, s := h.s, e := h.s + length(h.v))) ELSE [] END"


def _luhn(d: str) -> str:
    digit = f"CAST({d}[j:j] AS INTEGER)"
    return f"list_sum(list_transform(range(1, length({d}) + 1), lambda j: CASE WHEN (length({d}) - j) % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0"


_ID_OK = f"""CASE WHEN regexp_full_match(h.v, '[0-9]{{17}}[0-9Xx]') THEN try_strptime(h.v[7:14], '%Y%m%d') IS NOT NULL AND CAST(h.v[7:10] AS INTEGER) BETWEEN 1900 AND 2100
  AND upper(h.v[18:18]) = list_extract(string_split('{v.ID_CHECK}', ''), CAST(list_sum(list_transform(range(1, 18), lambda i: CAST(h.v[i:i] AS INTEGER) * {_WEIGHTS}[i])) % 11 AS INTEGER) + 1) ELSE FALSE END"""
_USCC_OK = f"""CASE WHEN regexp_full_match(h.v, '{_USCC}') THEN strpos('{v.USCC_ALPHABET}', h.v[18:18]) - 1
  = (31 - list_sum(list_transform(range(1, 18), lambda i: (strpos('{v.USCC_ALPHABET}', h.v[i:i]) - 1) * {_POWERS}[i])) % 31) % 31 ELSE FALSE END"""
_CARD_OK = f"CASE WHEN length(h.v) <= 19 THEN {_luhn('h.v')} ELSE FALSE END"
_GROUPED_OK = _let("d", "regexp_replace(h.v, '[^0-9]', '', 'g')", f"length(d) BETWEEN 16 AND 19 AND {_luhn('d')}")


def _cut(suffix: str) -> str:
    """A span without what stands before the name: after the last boundary word or character ahead of the suffix."""
    words, chars = "|".join(rules.BOUNDARY_WORDS), rules.BOUNDARY_CHARS
    ends = f"greatest(length(regexp_extract(head, '^.*(?:{words})')), length(regexp_extract(head, '^.*[{chars}]')))"
    return _let("head", f"regexp_extract(h.v, '^(.*?){suffix}', 1)", _let("n", ends, "struct_pack(s := h.s + n, v := substring(h.v, n + 1))"))


def _organisations(pattern: str, suffix: str, dropped: str = "") -> str:
    named = f"list_transform({_fenced('text', pattern)}, lambda h: {_cut(suffix)})"
    less = _let("n", f"length(regexp_extract(h.v, '^(?:{dropped})*'))", "struct_pack(s := h.s + n, v := substring(h.v, n + 1))")
    return f"list_transform({named}, lambda h: {less})" if dropped else named


_HOSPITAL = f"[一-龥]{{2,20}}?{rules.HOSPITAL_SUFFIX}(?:[一-龥]{{0,6}}(?:院区|分院))?"
_COMPANY = f"[一-龥（）()]{{2,30}}?{rules.ORG_SUFFIX}"
_PLATE = rules.PLATE.replace(r"\s", r" \t\n\x0B\f\r")
_EMAIL = rules.EMAIL.replace("'", "''")
_CUED = r"'\1' || chr(1) || '\2' || chr(1)"
#: Where runs of digits end, if no full stop follows; where runs of digits and letters end.
_DIGITS_END = r"regexp_replace(text, '([0-9]+)([^0-9.]|$)', '\1' || chr(2) || '\2', 'g')"
_SIGNS_END = r"regexp_replace(text, '([0-9A-Za-z]+)', '\1' || chr(2), 'g')"

_RULES = [
    _hits(1, "[0-9]{17}[0-9Xx]", _fenced("text", "[0-9A-Za-z]*[0-9]{17}[0-9Xx][0-9A-Za-z]*"), _ID_OK),
    _hits(2, _USCC, _fenced("text", f"[0-9A-Z]*{_USCC}[0-9A-Z]*"), _USCC_OK),
    _hits(3, _MOBILE, _tried("text", "[0-9+ -]", rf"(?:\+?86[- ]?)?{_MOBILE}", "", "[0-9]")),
    _hits(4, _LANDLINE, _tried("text", rf"[0-9－—转分机EeXxTt. \t\n\x0B\f\r-]", _LANDLINE, rf"(?:{_BLANK}*(?:转|分机|[Ee][Xx][Tt]\.?){_BLANK}*[0-9]{{1,5}})?", "[0-9-]")),
    _hits(5, f"{_LOOSE_CUE}0[0-9]{{2,3}}[.·_ ]", _fenced(_DIGITS_END, rf"({_LOOSE_CUE})(0[0-9]{{2,3}}\x02?[.·_ ][0-9]{{7,8}}\x02)", _CUED)),
    _hits(6, "[0-9]{16}", _fenced("text", "[0-9]{16,}"), _CARD_OK),
    _hits(7, _GROUPED, _tried("text", "[0-9 -]", _GROUPED, "(?:[ -][0-9]{1,4})?", "[0-9 ]"), _GROUPED_OK),
    _hits(8, f"{_TRAVEL_CUE}[A-Z]{{1,2}}[0-9]{{7}}", _fenced(_SIGNS_END, rf"({_TRAVEL_CUE})([A-Z]{{1,2}}[0-9]{{7,9}}\x02)", _CUED)),
    _hits(9, "@", _fenced("text", _EMAIL)),
    _hits(10, rules.PLATE_HEAD, _fenced("text", _PLATE)),
    _hits(11, rules.HOSPITAL_SUFFIX, _organisations(_HOSPITAL, rules.HOSPITAL_SUFFIX, "|".join(rules.BAD_PREFIX)), f"length(regexp_replace(h.v, '{rules.HOSPITAL_SUFFIX}.*$', '')) >= 2"),
    _hits(12, rules.ORG_SUFFIX, _organisations(_COMPANY, rules.ORG_SUFFIX), "length(h.v) >= 5 AND NOT (suffix(h.v, '银行') AND substring(text, h.s + length(h.v) + 1, 1) IN ('卡', '账', '帐'))"),
]

#: Continues a WITH clause that has lines as ln(doc_id, page, line, text): all_hits(doc_id, page, line, prio, s, e), no hit overlapping one of an earlier rule.
ALL_HITS = f"""
clean AS (SELECT doc_id, page, line, translate(text, chr(1) || chr(2), ' ' || chr(3)) AS text FROM ln WHERE regexp_matches(text, '[0-9]{{4}}|@|[一-龥]')),
found AS (SELECT doc_id, page, line, list_sort(flatten([{(", ").join(_RULES)}])) AS c FROM clean),
kept AS (SELECT doc_id, page, line, CASE WHEN len(c) < 2 THEN c ELSE list_reduce(list_prepend(CAST([] AS STRUCT(prio INTEGER, s BIGINT, e BIGINT)[]), list_transform(c, lambda x: [x])),
  lambda a, b: CASE WHEN len(list_filter(a, lambda k: k.s < b[1].e AND b[1].s < k.e)) > 0 THEN a ELSE list_concat(a, b) END) END AS c FROM found WHERE len(c) > 0),
all_hits AS (SELECT doc_id, page, line, h.prio, h.s, h.e FROM (SELECT doc_id, page, line, unnest(c) AS h FROM kept))"""
