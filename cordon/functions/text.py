"""Text clean-up, personal data, wording, names. Column in, Column out."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cordon.refdata import fixed as V

U = "(?U)"  # word boundaries and digits follow Unicode


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- markup and whitespace ---------------------------------------------------

@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if x is not None and "&" in x else x)


def strip_html(c) -> Column:
    """Tags to blanks, entities to characters, whitespace collapsed."""
    bare = F.regexp_replace(_c(c), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(_unescape(F.coalesce(bare, F.lit(""))), r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def normalise_text(c) -> Column:
    """NFC; hard blanks and tabs to blanks; runs collapsed; at most one empty line."""
    t = F.translate(_nfc(_c(c)), " \t", "  ")
    t = F.regexp_replace(F.regexp_replace(t, " {2,}", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def shortened(c, n: int | None) -> Column:
    """The first ``n`` characters; all of them where no limit is given."""
    return _c(c) if n is None else F.substring(_c(c), 1, n)


def norm_country(c) -> Column:
    return F.substring(F.upper(F.trim(_c(c))), 1, 2)


def to_utc(c) -> Column:
    """ISO text to UTC ISO; text that is not a timestamp stays as it is."""
    raw = _c(c)
    iso = raw.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$")
    ts = F.when(iso, F.expr(f"try_cast({_sql(c)} as timestamp)")) if isinstance(c, str) else F.when(iso, F.try_to_timestamp(raw))
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), raw)


def _sql(name: str) -> str:
    return f"`{name}`"


def origin(c) -> Column:
    """Publisher named after the last " - " of a feed title."""
    t = _c(c)
    return F.when(F.contains(t, F.lit(" - ")), F.trim(F.substring_index(t, " - ", -1))).otherwise(F.lit(""))


# --- personal data -----------------------------------------------------------

def scrub_pii(c) -> Column:
    """The six kinds in fixed order; phones go first and may swallow long ids. All need a digit but mail
    addresses, which need an at sign; most texts have neither and are spared the patterns."""
    def scrubbed(*kinds):
        out = _c(c)
        for kind in kinds:
            pattern, token = V.PII[kind]
            out = F.regexp_replace(out, U + pattern, token)
        return out

    every = scrubbed("phone", "email", "pesel", "nip", "card", "iban")
    if not isinstance(c, str):  # an expression would be evaluated for each use
        return every
    return F.when(_has_digit(c), every).when(_has_at(c), scrubbed("email")).otherwise(_c(c))


def _has_digit(c) -> Column:
    return _c(c).rlike(U + r"\d")


def _has_at(c) -> Column:
    return F.contains(_c(c), F.lit("@"))


def scrub_plates(c, official=None) -> Column:
    pattern, token = V.PII["plate"]
    clean = F.regexp_replace(_c(c), U + pattern, token)
    if official is None:
        return clean
    return F.when(F.coalesce(_c(official), F.lit(False)), _c(c)).otherwise(clean)


def has_pii(c) -> Column:
    def hit(kind):
        return _c(c).rlike(U + V.PII[kind][0])

    return F.coalesce(_has_digit(c) & (hit("phone") | hit("pesel")) | (_has_at(c) & hit("email")), F.lit(False))


def pii_counts(c) -> dict[str, Column]:
    """How much each pattern finds on the untouched text (kinds overlap)."""
    def n(kind):
        return F.coalesce(F.regexp_count(_c(c), F.lit(U + V.PII[kind][0])), F.lit(0))

    return {
        "removed_phones": n("phone"),
        "removed_emails": n("email"),
        "removed_ids": n("pesel") + n("nip") + n("card"),
        "removed_plates": n("plate"),
        "original_length": F.coalesce(F.length(_c(c)), F.lit(0)),
        "anonymized_length": F.coalesce(F.length(scrub_pii(c)), F.lit(0)),
    }


def scrub_social(c, mentions: bool = False) -> Column:
    out = F.coalesce(_c(c), F.lit(""))
    for kind in ("phone", "email") + (("mention",) if mentions else ()) + ("user",):
        pattern, token = V.SOCIAL[kind]
        out = F.regexp_replace(out, U + pattern, token)
    return out


def pseudonym(kind, user_id, title=None) -> Column:
    """Channels keep their public title; people become ten hex digits."""
    k = _c(kind)
    name = _c(title) if title is not None else F.lit(None).cast("string")
    person = F.concat(F.lit("user:"), F.substring(F.sha2(_c(user_id).cast("string"), 256), 1, 10))
    return (
        F.when(k == "channel", F.concat(F.lit("channel:"), F.coalesce(name, F.lit("unknown"))))
        .when(k == "group", F.concat(F.lit("group:"), F.coalesce(name, F.lit("unknown"))))
        .when(_c(user_id).isNull(), F.lit("anonymous"))
        .otherwise(person)
    )


def redact_persons(c) -> Column:
    """Two capitalised words in a row become a token, unless the first is a
    common opener."""
    skip = "|".join(V.NOT_FIRST_NAMES)
    return F.regexp_replace(
        _c(c),
        rf"(?U)\b(?!(?:{skip})\s)[A-ZÀ-ɏ][a-zÀ-ɏ]{{1,20}}\s+[A-ZÀ-ɏ][a-zÀ-ɏ]{{1,20}}\b",
        "[osoba]",
    )


# --- wording and company names -----------------------------------------------

def neutralise(c, compat: bool = False) -> Column:
    """Accusing words to neutral ones. By default whole words, longest first;
    ``compat`` keeps the listed order and replaces inside words too."""
    from cordon.functions.match import any_of

    out = _c(c)
    pairs = V.NEUTRAL if compat else sorted(V.NEUTRAL, key=lambda p: -len(p[0]))
    for word, neutral in pairs:
        pattern = f"(?iu){word}" if compat else rf"(?iuU)\b{word}\b"
        out = F.regexp_replace(out, pattern, neutral)
    # plain containment spares most texts the eighteen rewrites
    return F.when(any_of(_c(c), [w for w, _ in pairs]), out).otherwise(_c(c))


def mask_companies(c, region) -> Column:
    """Names with a legal form, and quoted names, become a region phrase."""
    phrase = F.concat(F.lit("firma transportowa z regionu "), F.coalesce(_c(region), F.lit("nieznany")))
    word = r"[A-ZÀ-ž][a-zÀ-ž]+"
    named = rf"(?U)\b({word}(?:\s+{word}){{0,3}})\s+(?:{'|'.join(V.LEGAL_FORMS_MASK)})\b"
    quoted = '["„“]([^"”‟]{3,50})["”‟]'
    safe = F.regexp_replace(phrase, r"([\\$])", r"\\$1")
    out = F.regexp_replace(_c(c), F.lit(named), safe)
    return F.regexp_replace(out, F.lit(quoted), F.concat(F.lit('"'), safe, F.lit('"')))


@F.pandas_udf(StringType())
def _title_words(s: pd.Series) -> pd.Series:
    def fix(x):
        if x is None:
            return x
        return " ".join(w if w.isupper() and len(w) > 1 else w.title() for w in x.split())

    return s.map(fix)


def company_key(c) -> Column:
    """Comparable company name: legal form and prefix off, quotes off, title case."""
    n = F.trim(_nfc(F.coalesce(_c(c), F.lit(""))))
    n = F.trim(F.regexp_replace(n, rf"(?iuU)\b(?:{'|'.join(V.LEGAL_FORMS_END)})\s*$", ""))
    n = F.trim(F.regexp_replace(n, rf"(?iuU)^(?:{'|'.join(V.NAME_PREFIXES)})\s+", ""))
    quotes = "\"'„“”»«"
    n = F.regexp_replace(n, f"^[{quotes}]+|[{quotes}]+$", "")
    return F.trim(_title_words(F.regexp_replace(n, r"(?U)\s+", " ")))


# --- small extractions -------------------------------------------------------

def first_match(c, pattern: str, group: int = 0) -> Column:
    """First match or null (Spark's extract gives an empty string)."""
    return F.nullif(F.regexp_extract(_c(c), pattern, group), F.lit(""))


def road_km(c) -> Column:
    """Road code, with its kilometre mark when one follows."""
    pattern = r"(?i)\b([AEDSB]\d{1,3})\b(?:\s*km\s*(\d{1,4}(?:[.,]\d)?))?"
    road, km = F.upper(first_match(c, pattern, 1)), first_match(c, pattern, 2)
    return F.when(km.isNotNull(), F.concat(road, F.lit(" km "), km)).otherwise(road)


def host_of(c) -> Column:
    """Host of a URL without a leading www."""
    url = _c(c)
    host = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"://([^/?#]*)", 1)).otherwise(
        F.regexp_extract(url, r"^([^?#]*)", 1)
    )
    return F.regexp_replace(host, r"^www\.", "")


def ordered_cases(text: Column, cases, default: str | None) -> Column:
    """First case with any of its words in ``text``."""
    from cordon.functions.match import any_of

    out = None
    for label, words in cases:
        cond = any_of(text, words)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(F.lit(default)) if default is not None else out


def debt_type(c) -> Column:
    return ordered_cases(_c(c), V.DEBT_TERMS, "debt")


def debt_event(kind: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in V.DEBT_EVENT.items() for x in kv])
    return F.coalesce(F.try_element_at(m, kind), F.lit("payment_issue"))


def licence_decision(c) -> Column:
    return ordered_cases(_c(c), V.LICENCE_TERMS, "license_change")


def licence_number(c) -> Column:
    return first_match(c, r"(?iu)(?:licencja|zezwolenie)\s*(?:nr\.?|numer)?\s*([A-Z0-9/\-]+)", 1)


def proceeding_type(c) -> Column:
    return ordered_cases(_c(c), [(p, [p]) for p in V.PROCEEDINGS], None)


COURTS = {
    "DE": r"(?:Amtsgericht|AG)\s+[\w\-äöüÄÖÜß]+",
    "AT": r"(?:Bezirksgericht|BG|Landesgericht|LG|Handelsgericht|HG)\s+[\w\-äöüÄÖÜß]+",
}


def court_name(c, country: str = "DE") -> Column:
    return first_match(c, COURTS[country], 0)
