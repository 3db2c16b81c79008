"""Checks on candidate values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil import lexicon
from spanveil.functions.text import let

# Weights and alphabets of the national number formats.
ID_WEIGHTS = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]
ID_CHECK = "10X98765432"
USCC_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"


def _weighted(s: Column, weights: list[int], value) -> Column:
    digits = F.filter(F.split(s, ""), lambda c: c != "")
    products = F.zip_with(F.slice(digits, 1, len(weights)), F.array(*[F.lit(w) for w in weights]), lambda c, w: value(c) * w)
    return F.aggregate(products, F.lit(0), lambda a, x: a + x)


def id_card_ok(s: Column) -> Column:
    """18 characters, a real date from 1900 to 2100 in the middle, and the mod-11 check character."""
    up = F.upper(s)
    shaped = F.rlike(up, F.lit(r"\A[0-9]{17}[0-9X]\z"))
    year = F.try_to_number(F.substring(up, 7, 4), F.lit("9999"))
    date = F.try_to_timestamp(F.substring(up, 7, 8), F.lit("yyyyMMdd"))
    total = _weighted(up, ID_WEIGHTS, lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    check = F.substring(F.lit(ID_CHECK), F.pmod(total, F.lit(11)).cast("int") + 1, F.lit(1))
    return F.coalesce(F.when(shaped, date.isNotNull() & year.between(1900, 2100) & (check == F.substring(up, 18, 1))), F.lit(False))


def luhn_ok(s: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", s), F.lit(False))


def uscc_ok(s: Column) -> Column:
    """18 characters without I, O, S, V, Z and the mod-31 check character."""
    shaped = F.rlike(s, F.lit(rf"\A[{USCC_ALPHABET}]{{18}}\z"))
    return F.coalesce(F.when(shaped, uscc_check_character(s) == F.substring(s, 18, 1)), F.lit(False))


def surname_start(v: Column, surnames: list[str] | None = None) -> Column:
    """The first character is a surname, or the first two are a compound one."""
    return F.coalesce(F.substring(v, 1, 1).isin(*(surnames or lexicon.SURNAMES)) | F.substring(v, 1, 2).isin(*lexicon.COMPOUND_SURNAMES), F.lit(False))


def count_chars(v: Column, pattern: str) -> Column:
    return F.regexp_count(v, F.lit(pattern))


def _starts_with_any(v: Column, words: list[str]) -> Column:
    return F.rlike(v, F.lit(r"\A(?:" + "|".join(words) + ")"))


# Shapes of names with a dot, of Latin names, and of military documents.
DOT_NAME = r"[一-龥]{1,8}(?:[·•][一-龥]{1,8}){1,3}"
LATIN_NAME = r"[A-Z][a-z]+(?: ?[A-Z][a-z]+){1,2}"
MILITARY_ID = r"[军士兵警文]{1,2}字?第?[0-9]{6,9}号?"


def valid(kind: Column, v: Column) -> Column:
    """Whether a value is plausible for its type; types without a test accept every value that is not empty."""
    bare = F.regexp_replace(v, "[·•]", "")
    stops = lexicon.stop_words()
    heads = sorted({w[:n] for w in stops for n in range(2, len(w))})
    name = F.when(F.rlike(v, F.lit(rf"\A(?:{DOT_NAME}|{LATIN_NAME})\z")), True).otherwise(
        F.rlike(v, F.lit(r"\A[一-龥·•]{2,5}\z"))
        & ~v.isin(*stops)
        & ~_starts_with_any(v, lexicon.NOT_NAME)
        & ~v.isin(*heads)
        & ~((F.length(bare) >= 5) & ~F.substring(v, 1, 2).isin(*lexicon.COMPOUND_SURNAMES) & (bare == v))
    )
    odd = lambda: count_chars(v, "[^0-9A-Za-z-]")
    alnum = count_chars(v, r"[\p{L}\p{N}]")
    digits = count_chars(v, r"\p{Nd}")
    real = F.length(F.translate(v, lexicon.TEMPLATE_CHARS, ""))
    place = (F.length(v) >= 4) & (real >= 3)
    return F.when(F.coalesce(v, F.lit("")) == "", False).otherwise(
        F.when(kind.isin("PERSON", "STAFF"), name)
        .when(kind == "ID_CARD", F.rlike(v, F.lit(rf"\A{MILITARY_ID}\z")) | ((odd() <= 2) & (alnum >= 6)))
        .when(kind == "PHONE", (digits >= 7) | F.rlike(v, F.lit(r"\A[A-Za-z][A-Za-z0-9_-]{4,29}\z")))
        .when(kind == "BANK_CARD", digits >= 12)
        .when(kind == "PLATE", (F.length(v) >= 6) & (alnum >= 5))
        .when(kind == "MEDICAL_ID", (alnum >= 1) & (odd() <= 1) & ~v.isin("-", "无"))
        .when(kind == "ORG", place)
        .when(kind == "ADDRESS", place & F.rlike(v, F.lit(f"[{lexicon.ADDRESS_CHARS}]")))
        .otherwise(True)
    )


def is_name(v: Column, surnames: list[str] | None = None) -> Column:
    """A model's finding that looks like a name: 2 to 4 characters, a surname first, no common word."""
    core = F.regexp_replace(v, "[·•]", "")
    return F.rlike(core, F.lit(r"\A[一-龥]{2,4}\z")) & surname_start(v, surnames) & ~v.isin(*lexicon.stop_words()) & ~_starts_with_any(v, lexicon.NOT_NAME_START)


def names_only(text: Column, surnames: list[str] | None = None) -> Column:
    """Nothing but names of 2 to 4 characters, set apart by a slash, a comma or a blank."""
    return F.rlike(text, F.lit(r"\A[一-龥]{2,4}(?:[/、，, ]+[一-龥]{2,4})*\z")) & F.forall(F.split(text, "[/、，, ]+"), lambda p: surname_start(p, surnames))


def looks_printed(text: Column, scores: Column) -> Column:
    """At least four characters, recognised with a mean score of 0.9 or more."""
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(scores), F.lit(1))
    return (F.length(text) >= 4) & (mean >= 0.9)


def is_slanted(angle: Column) -> Column:
    return let(F.pmod(F.abs(angle), F.lit(180.0)), lambda a: a.between(15, 75) | a.between(105, 165))


def clean_name(name: Column) -> Column:
    """Last path segment, printable characters only, at most 200; null if nothing is left."""
    last = F.substring_index(F.translate(name, "\\", "/"), "/", -1)
    return F.nullif(F.substring(F.trim(F.regexp_replace(last, r"\p{C}", "")), 1, 200), F.lit(""))


def is_job_id(s: Column) -> Column:
    return F.rlike(s, F.lit(r"\Ajob_[0-9a-z]{20}\z"))


def id_check_character(body: Column) -> Column:
    """Check character of the 17 digits before it."""
    total = _weighted(body, ID_WEIGHTS, lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    return F.substring(F.lit(ID_CHECK), F.pmod(total, F.lit(11)).cast("int") + 1, F.lit(1))


def uscc_check_character(body: Column) -> Column:
    """Check character of the first 17 characters, of the alphabet."""
    place = lambda c: F.call_function("locate", c, F.lit(USCC_ALPHABET)) - 1
    total = _weighted(body, [pow(3, k, 31) for k in range(17)], place)
    return F.substring(F.lit(USCC_ALPHABET), F.pmod(F.lit(31) - F.pmod(total, F.lit(31)), F.lit(31)).cast("int") + 1, F.lit(1))


def luhn_digit(body: Column) -> Column:
    """The digit that makes body + digit pass the Luhn test."""
    tries = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string"))
    return F.filter(tries, lambda d: F.call_function("luhn_check", F.concat(body, d)))[0]


# Numerals and units of amounts in words.
NUMERALS, UNITS = "零壹贰叁肆伍陆柒捌玖", ["", "拾", "佰", "仟", "万", "拾", "佰", "仟"]


def amount_in_words(cents: Column) -> Column:
    """An amount below 100 million, in cents, in formal numerals: 1230268 is 壹万贰仟叁佰零贰元陆角捌分."""
    yuan, jiao, fen = F.floor(cents / 100).cast("string"), F.floor(F.pmod(cents, F.lit(100)) / 10).cast("int"), F.pmod(cents, F.lit(10)).cast("int")
    word = lambda d: F.substring(F.lit(NUMERALS), d + 1, F.lit(1))
    n = F.length(yuan)
    units = F.array(*[F.lit(u) for u in UNITS])
    kind = "struct<zero:boolean,out:string>"
    start = F.struct(F.lit(False).alias("zero"), F.lit("").alias("out")).cast(kind)

    def step(s: Column, i: Column) -> Column:
        d, place = F.substring(yuan, i, F.lit(1)).cast("int"), n - i
        spoken = F.concat(s["out"], F.when(s["zero"], F.lit("零")).otherwise(F.lit("")), word(d), F.get(units, place))
        skipped = F.concat(s["out"], F.when(place == 4, F.lit("万")).otherwise(F.lit("")))
        return F.when(d == 0, F.struct(F.lit(True).alias("zero"), skipped.alias("out"))).otherwise(F.struct(F.lit(False).alias("zero"), spoken.alias("out"))).cast(kind)

    whole = F.concat(F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["out"]), F.lit("元"))
    small = F.concat(F.when(jiao > 0, F.concat(word(jiao), F.lit("角"))).otherwise(F.lit("零")), F.when(fen > 0, F.concat(word(fen), F.lit("分"))).otherwise(F.lit("")))
    return F.concat(whole, F.when((jiao == 0) & (fen == 0), F.lit("整")).otherwise(small))
