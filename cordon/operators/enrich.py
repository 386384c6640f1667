"""Text to facts: language, type, severity, tags, tier, cargo, origin, place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordon.functions.match import best_group, groups_hit, let
from cordon.functions.phrases import in_terms, occurring, of_language
from cordon.functions.score import severity_of
from cordon.functions.text import first_match, shortened
from cordon.functions.values import money_eur
from cordon.operators.sizes import first_by, looked_up
from cordon.refdata import fixed as V
from cordon.refdata.tables import literal


# --- language ----------------------------------------------------------------

def detect_language(df: DataFrame, text: Column, lang_words: DataFrame, out: str = "language", min_len: int = 1, latin: bool = False) -> DataFrame:
    """Language whose common words occur most among the distinct words of the
    text; dictionary order breaks ties, English when nothing fits. ``lang_words``
    is ``(lang, rank, words array<string>)``. ``latin`` gives the second detector:
    Latin letters only, two or more."""
    pattern = "[a-zÀ-ɏ]{2,}" if latin else "[\\p{L}\\p{N}_]{%d,}" % min_len
    packed = lang_words.select(F.lit(1).alias("_one"), F.struct("rank", "lang", "words").alias("l"))
    packed = packed.groupBy("_one").agg(F.array_sort(F.collect_list("l")).alias("_langs"))
    d = df.withColumn("_one", F.lit(1)).join(packed, "_one", "left").drop("_one")

    def vote(words):
        scored = F.transform(
            F.col("_langs"),
            lambda l: F.struct(F.size(F.array_intersect(words, l["words"])).alias("s"), (-l["rank"]).alias("r"), l["lang"].alias("lang")),
        )
        best = F.array_max(scored)
        return F.when(best["s"] > 0, best["lang"])

    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({pattern})"), F.lit(1)))
    return d.withColumn(out, F.coalesce(let(tokens, vote), F.lit("en"))).drop("_langs")


# --- classification ----------------------------------------------------------

def classify_type(df: DataFrame, terms: DataFrame, text: Column, lang="language", out: str = "event_type") -> DataFrame:
    """Two points per own-language word, one per English word for other
    languages; the best type wins, the earlier one on a tie, else ``other``."""
    code = F.coalesce(lang if isinstance(lang, Column) else F.col(lang), F.lit("en"))
    d = in_terms(df, terms, text, "_hits")

    def points(hits, n):
        return F.transform(hits, lambda h: F.struct(h["grp_rank"].alias("grp_rank"), h["grp"].alias("grp"), F.lit(n).alias("w")))

    own = points(of_language("_hits", code), 2)
    en = points(F.when(code != "en", of_language("_hits", F.lit("en"))).otherwise(F.filter("_hits", lambda h: F.lit(False))), 1)
    best = let(F.concat(own, en), lambda h: best_group(h, lambda x: x["w"]))
    d = d.withColumn("_best", best)
    return d.withColumn(out, F.coalesce(F.col("_best.grp"), F.lit("other"))).drop("_hits", "_best")


def severity(df: DataFrame, text: Column, out: str = "severity") -> DataFrame:
    return df.withColumn(out, severity_of("event_type", text, "financial_impact_eur"))


def tags(df: DataFrame, terms: DataFrame, text: Column, out: str = "tags") -> DataFrame:
    """Every tag with a word in the text, in dictionary order."""
    return in_terms(df, terms, text, "_hits").withColumn(out, groups_hit(F.col("_hits"))).drop("_hits")


def road_alert_type(df: DataFrame, terms: DataFrame, text: Column, out: str = "alert_type") -> DataFrame:
    """Type with most words in the text, the earlier one on a tie, else ``other``."""
    d = in_terms(df, terms, text, "_hits").withColumn("_best", best_group(F.col("_hits")))
    return d.withColumn(out, F.coalesce(F.col("_best.grp"), F.lit("other"))).drop("_hits", "_best")


def tier(df: DataFrame, terms: DataFrame, text: Column, event_type="event_type", max_words: int | None = None) -> DataFrame:
    """Adds tier, category, confidence and the matched words (the first ``max_words``, if given). A known type
    fixes tier and category; otherwise the lowest tier with a match wins, most
    words within it. Dictionary groups are named ``tier/category``."""
    d = in_terms(df, terms, text, "_found")
    d = d.withColumn("_hits", F.transform(
        "_found",
        lambda h: F.struct(
            F.substring_index(h["grp"], "/", 1).cast("int").alias("tier"), h["grp_rank"].alias("grp_rank"),
            F.substring_index(h["grp"], "/", -1).alias("grp"), h["keyword"].alias("keyword"),
        ),
    ))
    known = F.create_map(*[x for k, (t, c) in V.TIER_OF_TYPE.items() for x in (F.lit(k), F.struct(F.lit(t).alias("tier"), F.lit(c).alias("category")))])
    d = d.withColumn("_map", F.try_element_at(known, F.col(event_type)))
    same = F.filter("_hits", lambda h: h["tier"] == F.col("_map.tier"))
    low = F.array_min(F.transform("_hits", lambda h: h["tier"]))
    d = d.withColumn("_same", same).withColumn("_low", F.filter("_hits", lambda h: h["tier"] == low))
    d = d.withColumn("_best", best_group(F.col("_low")))
    mine = F.filter("_low", lambda h: h["grp"] == F.col("_best.grp"))
    n_same = F.size("_same")
    mapped = F.col("_map").isNotNull()
    words = F.when(mapped, F.transform("_same", lambda h: h["keyword"])).otherwise(
        F.coalesce(F.transform(mine, lambda h: h["keyword"]), F.array().cast("array<string>"))
    )
    conf = F.when(
        mapped, F.least(F.lit(1.0), F.when(n_same > 0, 0.7).otherwise(0.5) + n_same * 0.05)
    ).otherwise(F.when(F.col("_best").isNull(), 0.2).otherwise(F.least(F.lit(1.0), 0.4 + F.col("_best.score") * 0.1)))
    return (
        d.withColumn("intelligence_tier", F.coalesce(F.col("_map.tier"), low, F.lit(4)))
        .withColumn("intelligence_category", F.coalesce(F.col("_map.category"), F.col("_best.grp"), F.lit("general_news")))
        .withColumn("intelligence_confidence", F.round(conf, 2))
        .withColumn("matched_keywords", words if max_words is None else F.slice(words, 1, max_words))
        .drop("_found", "_hits", "_map", "_same", "_low", "_best")
    )


def cargo_type(df: DataFrame, terms: DataFrame, text: Column, out: str = "cargo_type") -> DataFrame:
    """First cargo kind of the dictionary with a word in the text."""
    d = in_terms(df, terms, text, "_hits")
    return d.withColumn(out, F.try_element_at(groups_hit(F.col("_hits")), F.lit(1))).drop("_hits")


def modus_operandi(text: Column) -> Column:
    low = F.lower(text)
    out = None
    for name, patterns in V.MO_PATTERNS:
        cond = low.rlike("(?U)" + "|".join(patterns))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def vehicle_country(text: Column) -> Column:
    """Where vehicles are registered: by wording, else by the first plate whose
    prefix is a country. Plates themselves are never kept."""
    low = F.lower(text)
    said = None
    for patterns, code in V.VEHICLE_ORIGIN:
        cond = low.rlike("(?U)" + "|".join(patterns))
        said = F.when(cond, code) if said is None else said.when(cond, code)
    prefixes = F.create_map(*[F.lit(x) for kv in V.PLATE_COUNTRY.items() for x in kv])
    plates = F.regexp_extract_all(text, F.lit("(?U)(" + V.PII["plate"][0] + ")"), F.lit(1))
    codes = F.filter(
        F.transform(plates, lambda p: F.try_element_at(prefixes, F.regexp_extract(p, "^([A-Z]{1,3})", 1))), lambda c: c.isNotNull()
    )
    return F.coalesce(said, F.try_element_at(codes, F.lit(1)))


# --- places ------------------------------------------------------------------

def highways(df: DataFrame, id_col: str, text: Column, ref: DataFrame) -> DataFrame:
    """One row per road code in the text, in order, with its listed countries."""
    codes = df.select(id_col, F.posexplode(F.regexp_extract_all(text, F.lit(r"(?U)\b([ABEMDNS]\d{1,3})\b"), F.lit(1))).alias("pos", "code"))
    return codes.join(ref, "code", "left").select(id_col, "pos", "code", F.coalesce("countries", F.array().cast("array<string>")).alias("countries"))


def highway_ref(spark) -> DataFrame:
    rows = list(V.HIGHWAY_COUNTRIES.items())
    return literal(spark, rows, "code string, countries array<string>")


def gazetteer(spark) -> DataFrame:
    """City list with coordinates, one row per name or alias; replace it by a longer one of the same columns."""
    rows, rank = [], 0
    for name, cc, lat, lon, pop, aliases in V.CITIES:
        for key in [name, *aliases]:
            rows.append((key.lower(), name, cc, lat, lon, pop, rank))
            rank += 1
    return literal(spark, rows, "key string, city string, country string, lat double, lon double, population int, rank int")


def places(spark) -> DataFrame:
    """Place names with their region, for ``extract_place``; replaceable likewise."""
    rows = [(key, key, cc, region, rank) for rank, (key, (cc, region)) in enumerate(V.PLACE_REGIONS.items())]
    return literal(spark, rows, "key string, city string, country string, region string, rank int")


def geocode(df: DataFrame, name: str, ref: DataFrame) -> DataFrame:
    """Coordinates of a city by name or alias."""
    r = ref.select("key", F.col("lat").alias("geo_lat"), F.col("lon").alias("geo_lon"), F.col("rank").alias("_r"))
    r = first_by(r, ["key"], [F.asc("_r")]).drop("_r")
    return looked_up(df, F.lower(F.trim(name)), r, "key")


ROAD = r"(?iU)\b([ABE][\s-]?\d{1,4})\b|\b(autostrada|autoroute|autobahn|motorway|snelweg|autopista)\s+([A-Z]?\d{1,4})\b"


def main_road(text: Column) -> Column:
    """First motorway code in the text, upper case without separators."""
    whole = first_match(text, ROAD, 0)
    code = F.coalesce(F.nullif(F.regexp_extract(whole, ROAD, 1), F.lit("")), F.nullif(F.regexp_extract(whole, ROAD, 3), F.lit("")))
    return F.translate(F.upper(code), " -\t\n", "")


def extract_place(df: DataFrame, ref: DataFrame, text: Column, country="country_code") -> DataFrame:
    """Adds road, city, region and country: the first gazetteer entry that occurs as a whole word. Entries are
    found in one pass, at any length of the gazetteer; only those up to the first sure one are checked for word edges."""
    d = occurring(df, ref.select("rank", "key", "city", "region", "country"), "key", text, "_near", first_whole=True)
    whole = F.filter("_near", lambda g: F.regexp_like(F.lower(text), F.concat(F.lit(r"(?U)\b\Q"), g["key"], F.lit(r"\E\b"))))
    d = d.withColumn("_hit", F.try_element_at(whole, F.lit(1)))
    cc = F.nullif(F.coalesce(F.col(country), F.lit("")), F.lit(""))
    return (
        d.withColumn("road", main_road(text)).withColumn("city", F.initcap(F.col("_hit.key")))
        .withColumn("region", F.col("_hit.region")).withColumn("country_code", F.coalesce(cc, F.col("_hit.country"))).drop("_near", "_hit")
    )


def geo_extract(df: DataFrame, id_col: str, text: Column, country: Column, gaz: DataFrame, hw: DataFrame, regions: DataFrame, borders: DataFrame, parks: DataFrame, members: DataFrame) -> DataFrame:
    """City, highway, region, crossing, parking and corridor of each text, with
    method and confidence. Places of the gazetteer are found in one pass, at any length of it; the short lists of
    roads, regions, crossings and parks are folded to one row each."""
    one = F.lit(1).alias("_one")

    def pack(ref, cols, name):
        return ref.select(one, F.struct(*cols).alias("x")).groupBy("_one").agg(F.array_sort(F.collect_list("x")).alias(name))

    base = df.select(F.col(id_col), F.lower(F.coalesce(text, F.lit(""))).alias("_t"), F.coalesce(text, F.lit("")).alias("_raw"), F.upper(country).alias("_cc"), one)
    gz = gaz.where(F.length("key") > 2).withColumn(
        "conf", F.when(F.length("key") > 4, 0.85).otherwise(0.65) + F.when(F.col("population") > 500_000, 0.05).otherwise(0.0)
    ).withColumn("neg", -F.col("conf"))
    words = lambda c: F.filter(F.split(F.lower(c), " "), lambda w: F.length(w) > 3)
    bd = borders.withColumn("parts", F.filter(F.transform(F.split(F.lower("border"), "-"), lambda p: F.trim(p)), lambda p: F.length(p) > 3))
    pk = parks.withColumn("words", words("park"))
    # places first: the rows that wait for Python hold the text alone, not the lists folded onto each row below
    d = occurring(base, gz.select("neg", "rank", "key", "city", "country", "lat", "lon", "conf"), "key", "_t", "_gaz")
    for packed in (
        pack(hw, ["code", "countries"], "_hw"),
        pack(regions, ["rank", "country", "region", "lat", "lon"], "_reg"),
        pack(bd, ["site_rank", "border", "border_countries", "site_lat", "site_lon", "parts"], "_bd"),
        pack(pk, ["site_rank", "park", "park_country", "site_lat", "site_lon", "words"], "_pk"),
    ):
        d = d.join(packed, "_one", "left")
    cc = F.col("_cc")
    d = d.withColumn("city_hit", F.try_element_at(F.filter("_gaz", lambda g: cc.isNull() | (g["country"] == cc)), F.lit(1)))
    d = d.withColumn("highway", first_match("_raw", r"(?U)\b([ABEMDNS]\d{1,3})\b", 1))
    listed = F.try_element_at(F.filter("_hw", lambda h: h["code"] == F.col("highway")), F.lit(1))["countries"]
    hw_country = F.when(F.array_contains(listed, cc), cc).otherwise(F.try_element_at(listed, F.lit(1)))
    d = d.withColumn("region_hit", F.try_element_at(F.reverse(F.filter("_reg", lambda r: (r["country"] == cc) & F.contains(F.col("_t"), F.lower(r["region"])))), F.lit(1)))
    d = d.withColumn("region_first", F.try_element_at(F.filter("_reg", lambda r: (r["country"] == cc) & F.contains(F.col("_t"), F.lower(r["region"]))), F.lit(1)))
    d = d.withColumn("_bds", F.filter("_bd", lambda b: F.exists(b["parts"], lambda p: F.contains(F.col("_t"), p))))
    d = d.withColumn("_pks", F.filter("_pk", lambda p: F.size(F.filter(p["words"], lambda w: F.contains(F.col("_t"), w))) >= 2))
    border_last, border_first = F.try_element_at("_bds", F.lit(-1)), F.try_element_at("_bds", F.lit(1))
    park_last, park_first = F.try_element_at("_pks", F.lit(-1)), F.try_element_at("_pks", F.lit(1))
    best = F.coalesce(F.col("city_hit.conf"), F.lit(0.0))
    has_b, has_r, has_h = F.size("_bds") > 0, F.col("region_hit").isNotNull(), F.col("highway").isNotNull()
    method = (
        F.when(has_b & (best < 0.75), "border_match").when(has_r & (best < 0.55), "region_match").when(has_h & (best < 0.5), "highway_match")
        .when(F.col("city_hit").isNotNull(), "city_match")
    )
    conf = F.when(has_b & (best < 0.75), 0.75).when(has_r & (best < 0.55), 0.55).when(has_h & (best < 0.5), 0.6).otherwise(F.round(best, 2))
    found = F.coalesce(
        F.when(has_b, F.coalesce(cc, F.substring_index(border_last["border_countries"], " ", 1))), F.col("city_hit.country"), hw_country, park_first["park_country"]
    )
    out = d.select(
        F.col(id_col), F.col("city_hit.city").alias("city"), "highway", F.col("region_hit.region").alias("region"),
        border_last["border"].alias("border_crossing"), park_last["park"].alias("parking"),
        F.coalesce(F.col("city_hit.lat"), F.col("region_first.lat"), border_first["site_lat"], park_first["site_lat"]).alias("latitude"),
        F.coalesce(F.col("city_hit.lon"), F.col("region_first.lon"), border_first["site_lon"], park_first["site_lon"]).alias("longitude"),
        conf.alias("confidence"), method.alias("method"), found.alias("_found"), cc.alias("_cc2"),
    )
    # corridors: fifteen rows folded, scored in place
    cor = members.groupBy("corridor_rank", "corridor").agg(F.collect_set("corridor_country").alias("ccs"), F.first("roads").alias("roads"))
    cor = pack(cor, ["corridor_rank", "corridor", "ccs", "roads"], "_cor")
    out = out.withColumn("_one", F.lit(1)).join(cor, "_one", "left")
    scored = F.transform(
        "_cor",
        lambda c: F.struct(
            (F.when(F.array_contains(c["ccs"], F.col("_found")), 1).otherwise(0) + F.when(F.array_contains(c["roads"], F.col("highway")), 3).otherwise(0)).alias("s"),
            (-c["corridor_rank"]).alias("r"), c["corridor"].alias("corridor"),
        ),
    )
    top = F.array_max(scored)
    out = out.withColumn("corridor", F.when(F.col("_found").isNotNull() & (top["s"] >= 1), top["corridor"]))
    return out.withColumn("country", F.coalesce("_found", "_cc2")).drop("_one", "_cor", "_found", "_cc2")


def region_ref(spark) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(V.REGION_POINTS)]
    return literal(spark, rows, "rank int, country string, region string, lat double, lon double")


def location_detail(geo: DataFrame, text: Column) -> DataFrame:
    """Readable place line from ``geo_extract`` columns and distance marks; the
    region alone when there is nothing else."""
    km = F.translate(first_match(text, r"(?iu)(?:km|kilometer|kilometre|kilometr)\s*(\d+[.,]?\d*)", 1), ",", ".")
    mile = first_match(text, r"(?iu)mile\s*(\d+[.,]?\d*)", 1)
    line = F.concat_ws(
        ", ", "highway", F.coalesce(F.concat(F.lit("km "), km), F.concat(F.lit("mile "), mile)), "city",
        F.concat(F.lit("parking: "), F.col("parking")), F.concat(F.lit("border: "), F.col("border_crossing")),
    )
    return geo.withColumn("location_detail", F.when(line == "", F.col("region")).otherwise(line))


# --- article details ---------------------------------------------------------

def enrich(inc: DataFrame, articles: DataFrame, text_chars: int | None = None, description_chars: int | None = None) -> DataFrame:
    """Fill incidents from full articles ``(source_url, full_text, cargo_type,
    modus_operandi, location_detail, vehicle_country, value_eur)``: found details
    win, money only where missing or zero, text only where longer. Texts are cut only
    to limits that are given."""
    cols = ["cargo_type", "modus_operandi", "location_detail", "vehicle_country"]
    a = articles.select("source_url", F.col("full_text").alias("_full"), F.col("value_eur").alias("_eur"), *[F.col(c).alias(f"_{c}") for c in cols])
    d = inc.join(a, "source_url", "left")
    longer = F.length("_full") > F.length(F.coalesce("description", F.lit("")))
    for c in cols:
        d = d.withColumn(c, F.coalesce(f"_{c}", c))
    have = F.coalesce("financial_impact_eur", F.lit(0.0)) != 0
    return (
        d.withColumn("financial_impact_eur", F.when(have, F.col("financial_impact_eur")).otherwise(F.coalesce("_eur", "financial_impact_eur")))
        .withColumn("raw_text", F.when(longer, shortened("_full", text_chars)).otherwise(F.col("raw_text")))
        .withColumn("description", F.when(longer, shortened("_full", description_chars)).otherwise(F.col("description")))
        .drop("_full", "_eur", *[f"_{c}" for c in cols])
    )


def article_details(df: DataFrame, text: str, cargo_terms: DataFrame) -> DataFrame:
    """Cargo, modus operandi, vehicle country and value of article texts."""
    d = cargo_type(df, cargo_terms, F.col(text))
    return (
        d.withColumn("modus_operandi", modus_operandi(F.col(text))).withColumn("vehicle_country", vehicle_country(F.col(text)))
        .withColumn("value_eur", money_eur(text))
    )


