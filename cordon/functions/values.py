"""Dates, numbers and money read from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cordon.functions.match import let
from cordon.functions.text import first_match
from cordon.refdata import fixed as V


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _int(col: Column) -> Column:
    return F.nullif(col, F.lit("")).try_cast("int")


def _date(y: Column, m: Column, d: Column, h=None, mi=None, s=None) -> Column:
    zero = F.lit(0)
    parts = [y, m, d, h if h is not None else zero, mi if mi is not None else zero, s if s is not None else zero]
    return F.call_function("try_make_timestamp_ntz", *parts[:5], parts[5].cast("decimal(8,6)"))


def parse_date(c) -> Column:
    """First of five notations that gives a real date: ISO, d.m.y, d/m/y, d-m-y,
    month by name. An impossible date falls through to the next notation."""
    t = _c(c)
    iso = r"(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2}))?)?"

    def g(pattern, i):
        return _int(F.regexp_extract(t, pattern, i))

    tries = [
        _date(g(iso, 1), g(iso, 2), g(iso, 3), F.coalesce(g(iso, 4), F.lit(0)), F.coalesce(g(iso, 5), F.lit(0)), F.coalesce(g(iso, 6), F.lit(0)))
    ]
    for pattern in (r"(\d{1,2})\.(\d{1,2})\.(\d{2,4})", r"(\d{1,2})/(\d{1,2})/(\d{2,4})"):
        y = g(pattern, 3)
        tries.append(_date(F.when(y < 100, y + 2000).otherwise(y), g(pattern, 2), g(pattern, 1)))
    dash = r"(\d{1,2})-(\d{1,2})-(\d{4})"
    tries.append(_date(g(dash, 3), g(dash, 2), g(dash, 1)))
    word = r"[a-zA-ZÀ-ž]+"
    named = rf"(\d{{1,2}})\s+({word})\s+(\d{{4}})|({word})\s+(\d{{1,2}}),?\s+(\d{{4}})"
    months = F.create_map(
        *[F.lit(x) for num, names in V.MONTHS.items() for name in dict.fromkeys(names) for x in (name, num)]
    )
    month = F.try_element_at(
        months, F.lower(F.concat(F.regexp_extract(t, named, 2), F.regexp_extract(t, named, 4)))
    )
    tries.append(_date(F.coalesce(g(named, 3), g(named, 6)), month, F.coalesce(g(named, 1), g(named, 5))))
    return F.coalesce(*tries)


def extract_date(*cols) -> Column:
    """Date of the first field that holds one."""
    return F.coalesce(*[parse_date(c) for c in cols])


def parse_number(c) -> Column:
    """European or English number text to a double; a lone dot is a decimal point."""
    def read(s):
        comma, dot = F.contains(s, F.lit(",")), F.contains(s, F.lit("."))
        no_dots, no_commas = F.translate(s, ".", ""), F.translate(s, ",", "")
        last_comma = F.instr(F.reverse(s), ",")
        last_dot = F.instr(F.reverse(s), ".")
        both = F.when(last_comma < last_dot, F.replace(no_dots, F.lit(","), F.lit("."))).otherwise(no_commas)
        one_comma = (F.length(s) - F.length(no_commas) == 1) & (last_comma <= 3)
        only = F.when(one_comma, F.replace(s, F.lit(","), F.lit("."))).otherwise(no_commas)
        text = F.when(comma & dot, both).when(comma, only).otherwise(s)
        return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), text).try_cast("double")

    return let(F.translate(F.trim(_c(c)), "  \n\t", ""), read)


_NUM = r"\d++(?:[\s.,]++\d++)*+"  # as far as the last digit, without a step back


def money_eur(c) -> Column:
    """Largest amount of money in the text, in EUR to the cent. One scan finds a
    mark before or after a number; the mark found names the currency, so two
    currencies never claim one number."""
    marks = "|".join(m for ms in V.CURRENCY_MARKS.values() for m in ms)
    scan = rf"(?iu)((?:{marks})\s?(?:{_NUM})|(?:{_NUM})\s?(?:{marks}))|{_NUM}"  # a number without a mark is passed over whole
    codes = F.array(*[F.struct(F.lit(f"(?iu)({'|'.join(m)})").alias("mark"), F.lit(V.FX_TO_EUR[k]).alias("rate")) for k, m in V.CURRENCY_MARKS.items()])

    def worth(piece):
        amount = parse_number(F.regexp_extract(piece, f"({_NUM})", 1))
        code = F.element_at(F.filter(codes, lambda k: F.regexp_like(piece, k["mark"])), 1)
        return F.when(amount > 0, F.round(amount * code["rate"], 2))

    found = F.regexp_extract_all(_c(c), F.lit(scan), F.lit(1))
    best = F.array_max(F.filter(F.transform(found, worth), lambda x: x.isNotNull()))
    return F.when(_c(c).rlike("[0-9]"), best)  # spares texts without a number the scan


def registry_amount(c) -> Column:
    """First amount beside EUR, PLN or GBP, in that order of patterns; the text's
    own currency decides the rate."""
    t = _c(c)
    raw = F.coalesce(
        first_match(t, r"([\d.,]+)\s*(?:EUR|eur|€)", 1),
        first_match(t, r"(?:EUR|eur|€)\s*([\d.,]+)", 1),
        first_match(t, r"([\d.,]+)\s*(?:PLN|pln|zł|zl)", 1),
        first_match(t, r"([\d.,]+)\s*(?:GBP|gbp|£)", 1),
    )
    comma, dot = F.contains(raw, F.lit(",")), F.contains(raw, F.lit("."))
    plain = (
        F.when(comma & dot & (F.instr(F.reverse(raw), ",") < F.instr(F.reverse(raw), ".")),
               F.replace(F.translate(raw, ".", ""), F.lit(","), F.lit(".")))
        .when(comma & dot, F.translate(raw, ",", ""))
        .when(comma, F.replace(raw, F.lit(","), F.lit(".")))
        .otherwise(raw)
    )
    amount = F.when(plain.rlike(r"^(\d+\.?\d*|\.\d+)$"), plain).try_cast("double")
    rate = F.when(t.rlike("PLN|pln|zł|zl"), V.FX_TO_EUR["PLN"]).when(t.rlike("GBP|gbp|£"), V.FX_TO_EUR["GBP"]).otherwise(1.0)
    return F.round(amount * rate, 2)


def fx_eur(amount, currency) -> Column:
    """Static-rate conversion; EUR and missing currency pass, unknown is 1:1."""
    rates = F.create_map(*[F.lit(x) for kv in V.FX_TO_EUR.items() for x in kv])
    cur = _c(currency)
    rate = F.coalesce(F.try_element_at(rates, F.upper(cur)), F.lit(1.0))
    return F.when(cur.isNull() | cur.isin("", "EUR"), _c(amount).cast("double")).otherwise(
        F.round(_c(amount).cast("double") * rate, 2)
    )
