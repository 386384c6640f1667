"""Text profile: companies, places, dates, amounts, vehicles, cargo, keywords,
sentiment and transport details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordon.functions.match import any_of, groups_hit, let
from cordon.functions.phrases import in_terms, of_language
from cordon.functions.text import first_match
from cordon.refdata import fixed as V

CAP = r"[A-ZÀ-ɏ][\wÀ-ɏ-]*"
QUOTES = '"„“”«»'


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def ent_companies(text: Column) -> Column:
    """Capitalised words before a legal form, then quoted names, without repeats. Of a run of capitalised words, all up
    to the last legal form; a run without one is passed over whole, as its later words hold none either. Repeats are
    possessive: others take a stack frame a word, and a run of some thousand words ends the JVM."""
    cap, form = rf"{CAP}+", rf"(?:{'|'.join(V.LEGAL_FORMS_ENTITY)})"
    up_to = rf"(?:\s++(?!{form}){cap})*+\s++"
    named = _found(text, rf"(?U)({cap}(?:{up_to}(?={form}){cap}(?={up_to}{form}))*+{up_to}{form})|{cap}(?:\s++{cap})*+")
    quoted = _found(text, f"[{QUOTES}]([^{QUOTES}]{{3,60}})[{QUOTES}]")
    trim = lambda a: F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: F.length(x) > 3)
    upper = F.filter(trim(quoted), lambda x: F.substring(x, 1, 1).rlike(r"^\p{Lu}"))
    return F.array_distinct(F.concat(trim(named), upper))


def ent_locations(text: Column) -> Column:
    """Road codes, country names, capitalised words that are not common openers."""
    roads = _found(text, r"(?U)\b([ABEMDNS]\d{1,4})\b")
    names = F.array(*map(F.lit, sorted(set(V.COUNTRY_WORDS))))
    countries = let(F.lower(F.coalesce(text, F.lit(""))), lambda t: F.filter(names, lambda n: F.contains(t, F.lower(n))))
    words = _found(text, r"(?U)\b([A-ZÀ-ɏ][a-zÀ-ɏ]{2,}(?:\s[A-ZÀ-ɏ][a-zÀ-ɏ]{2,})?)\b")
    skip = F.array(*map(F.lit, V.NOT_PLACES))
    words = F.filter(words, lambda w: ~F.array_contains(skip, w))
    return F.array_distinct(F.concat(roads, countries, words))


def ent_dates(text: Column) -> Column:
    plain = _found(text, r"(?U)(\b\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}\b|\b\d{4}[./\-]\d{1,2}[./\-]\d{1,2}\b)")
    iso = _found(text, r"(?U)(\b\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2})?)?)")
    return F.concat(plain, iso)


def ent_amounts(text: Column) -> Column:
    codes = "EUR|USD|GBP|PLN|CZK|HUF|RON|SEK|NOK|DKK|CHF|TRY|BGN|HRK"
    num = r"\d++(?:[\s.,]++\d++)*+"  # as far as the last digit; a number without a currency is passed over whole
    pattern = rf"(?iu)((?:{codes})\s?{num}|{num}\s?(?:{codes}|€|\$|£|z[lł]|K[cč]|Ft|lei|kr|Fr|TL|лв|kn))|{num}"
    return F.transform(F.filter(_found(text, pattern), lambda x: x != ""), lambda x: F.trim(x))


PLATE = r"(?U)\b([A-Z]{2,3}[-\s]?\d{3,5}[-\s]?[A-Z]{0,3}|[A-Z]{1,3}\s?\d{1,4}\s?[A-Z]{1,3}|[A-Z]{2}\d{4}[A-Z]{2})\b"


def _own_and_english(lang, hits: str = "_hits") -> Column:
    """Found words of the row's language, then English ones; an English row has its words twice."""
    return F.concat(of_language(hits, lang if isinstance(lang, Column) else F.col(lang)), of_language(hits, F.lit("en")))


def ent_vehicles(df: DataFrame, terms: DataFrame, text: Column, lang="language") -> DataFrame:
    """Vehicle words of the row's language and English; plates only as a count."""
    d = in_terms(df, terms, text, "_hits")
    words = F.transform(_own_and_english(lang), lambda h: h["keyword"])
    plates = F.size(F.array_distinct(F.filter(_found(text, PLATE), lambda p: F.length(F.trim(p)) >= 5)))
    return d.withColumn("vehicles", F.array_distinct(words)).withColumn("plate_count", plates).drop("_hits")


def ent_cargo(df: DataFrame, terms: DataFrame, text: Column, out: str = "cargo_types") -> DataFrame:
    """All cargo kinds with a word in the text."""
    return in_terms(df, terms, text, "_hits").withColumn(out, groups_hit(F.col("_hits"))).drop("_hits")


def keywords(df: DataFrame, terms: DataFrame, negative: DataFrame, text: Column, lang="language", n: int = 10, out: str = "keywords") -> DataFrame:
    """Ten transport words of the text: a point for each list (any group) and for
    the negative words of its language or English; ties in dictionary order, then
    by the word."""
    d = in_terms(in_terms(df, terms, text, "_kw"), negative, text, "_hits")
    shape = lambda arr, base: F.transform(arr, lambda h: F.struct(h["keyword"].alias("k"), (h["grp_rank"] * 1000 + h["rank"] + base).alias("r")))
    listed = shape(F.col("_kw"), 0)
    neg = F.array_distinct(F.transform(_own_and_english(lang), lambda h: h["keyword"]))
    negs = F.transform(neg, lambda k: F.struct(k.alias("k"), F.lit(1_000_000).alias("r")))

    def rank(hits):
        names = F.array_distinct(F.transform(hits, lambda h: h["k"]))
        scored = F.transform(
            names,
            lambda k: F.struct(
                (-F.size(F.filter(hits, lambda h: h["k"] == k))).alias("neg"),
                F.array_min(F.transform(F.filter(hits, lambda h: h["k"] == k), lambda h: h["r"])).alias("r"), k.alias("k"),
            ),
        )
        return F.transform(F.slice(F.array_sort(scored), 1, n), lambda s: s["k"])

    return d.withColumn(out, let(F.concat(listed, negs), rank)).drop("_kw", "_hits")


def sentiment(df: DataFrame, negative: DataFrame, positive: DataFrame, text: Column, lang="language") -> DataFrame:
    """Label and score from whole-word hits in the row's language and English."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-zÀ-ɏ]{2,})"), F.lit(1)))
    d = df.withColumn("_tok", tokens)
    for terms, count in ((negative, "negative_count"), (positive, "positive_count")):
        d = in_terms(d, terms, text, "_hits")  # whole words among all that occur
        words = F.filter(F.transform(_own_and_english(lang), lambda h: h["keyword"]), lambda k: F.array_contains("_tok", k))
        d = d.withColumn(count, F.size(F.array_distinct(words))).drop("_hits")
    total = F.col("negative_count") + F.col("positive_count")
    score = F.coalesce(F.round((F.col("positive_count") - F.col("negative_count")) / F.nullif(total, F.lit(0)), 2), F.lit(0.0))
    label = F.when(score < -0.2, "NEGATIVE").when(score > 0.2, "POSITIVE").otherwise("NEUTRAL")
    return d.withColumn("sentiment_score", score).withColumn("sentiment", label).drop("_tok")


def transport_details(df: DataFrame, vehicle_terms: DataFrame, cargo_terms: DataFrame, text: Column, lang="language") -> DataFrame:
    """Route, vehicle, cargo, time of day, and parking/highway/border mentions."""
    cap = "[A-ZÀ-ɏ][a-zÀ-ɏ]+"
    pair = rf"({cap})\s*[→—\->]+\s*({cap})"
    a, b = first_match(text, pair, 1), first_match(text, pair, 2)
    hw = first_match(text, r"(?U)\b([ABEMD]\d{1,3})\b", 1)
    route = F.concat(a, F.lit(" → "), b)
    route = F.when(route.isNotNull() & hw.isNotNull(), F.concat(route, F.lit(" ("), hw, F.lit(")"))).otherwise(F.coalesce(route, hw))
    period = None
    for name, cues in V.TIME_CUES:
        cond = any_of(text, cues)
        period = F.when(cond, name) if period is None else period.when(cond, name)
    d = ent_vehicles(df, vehicle_terms, text, lang)
    d = ent_cargo(d, cargo_terms, text, "_cargo")
    return (
        d.withColumn(
            "transport",
            F.struct(
                route.alias("route"), F.try_element_at("vehicles", F.lit(1)).alias("vehicle_type"), F.try_element_at("_cargo", F.lit(1)).alias("cargo_type"),
                period.alias("time_of_day"), any_of(text, V.PARKING_CUES).alias("parking_mentioned"), hw.isNotNull().alias("highway_mentioned"),
                any_of(text, V.BORDER_CUES).alias("border_crossing_mentioned"),
            ),
        )
        .drop("_cargo")
    )


def profile_text(df: DataFrame, refs: dict[str, DataFrame], text: Column, lang="language") -> DataFrame:
    """The whole profile plus a summary line. ``refs``: vehicle, cargo, keyword,
    negative and positive dictionaries."""
    d = transport_details(df, refs["vehicle"], refs["cargo"], text, lang)
    d = ent_cargo(d, refs["cargo"], text)
    d = keywords(d, refs["keyword"], refs["negative"], text, lang)
    d = sentiment(d, refs["negative"], refs["positive"], text, lang)
    d = (
        d.withColumn("companies", ent_companies(text)).withColumn("locations", ent_locations(text))
        .withColumn("dates", ent_dates(text)).withColumn("amounts", ent_amounts(text))
    )
    some = lambda c, label, n: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(F.slice(c, 1, n), ", ")))
    line = F.concat_ws("; ", some("companies", "Companies: ", 3), some("locations", "Locations: ", 3), some("keywords", "Keywords: ", 5))
    return d.withColumn("summary", F.when(line == "", "No significant entities detected.").otherwise(line))
