"""Keyword, personal-data, money, date and wording operators over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cordon.catalog import bind as B
from cordon.catalog.oracle import case, half, values
from cordon.catalog.registry import query
from cordon.functions import text as t
from cordon.functions import values as v
from cordon.operators import enrich as e
from cordon.operators import filters as f
from cordon.operators import profile as p
from cordon.refdata import fixed as V
from cordon.refdata import terms as W
from cordon.refdata.tables import literal

# Dictionaries of frequent fragments of the test prose, next to the real English
# ones, so that the matching work has hits: type -> words, per language.
FRAGMENTS = {
    "en": {"theft_cargo": "thand|ering|tionan", "theft_fuel": "whor|blenon", "damage": "edon|eston|reared", "delay": "inging|andst", "strike": "outhe|lythe", "other": "zzzz"},
    "de": {"theft_cargo": "keitsch|einver", "damage": "pfau|ungder", "delay": "lichkeit|achsch", "bankruptcy": "ßsch|bezu"},
    "fr": {"theft_vehicle": "mentoi|eauaux", "damage": "çelle|vipa", "route_closure": "ierai|treé"},
    "es": {"theft_fuel": "cióndad|mente", "strike": "doar|esla"},
}
ROWS = [r for lang, g in FRAGMENTS.items() for r in W.rows_of(g, lang)]
# the same type has one rank in every language
RANK = {name: i for i, name in enumerate(V.EVENT_TYPES)}
ROWS = [(g, RANK[g], lang, kw, r) for g, _, lang, kw, r in ROWS]
EN_ROWS = W.rows_of(W.TYPE_TERMS, "en")
TYPE_ROWS = ROWS + [(g, RANK[g], lang, kw, r + 100) for g, _, lang, kw, r in EN_ROWS]
VEH = W.rows_of({"v": "thand|ering|whor"}, "en") + W.rows_of({"v": "keit"}, "de") + W.rows_of(W.VEHICLE_TERMS, "en")
EVT = W.rows_of({"e": "edon|outhe|andst"}, "en") + W.rows_of({"e": "sch"}, "de") + W.rows_of({"e": "eauaux"}, "fr") + W.rows_of(W.EVENT_TERMS, "en")
TAG = W.rows_of({"nocna": "thand|keitsch", "parking": "ering|ierai", "granica": "outhe|blen"}, "*") + [(g, k + 10, "*", w, r) for g, k, _, w, r in W.rows_of(W.TAG_TERMS)]
TIERW = W.rows_of({"1/cargo_theft": "thandst|keitsch", "2/fraud": "ering|ierai", "2/vandalism": "outhe|whor", "3/protest_roadblock": "edon|sch", "4/general_news": "the|la"}, "*")
CARGOW = W.rows_of({"electronics": "thandst|keitsch", "fuel": "inging|eauaux", "food": "outhe|mentoi", "metals": "the|die|le"}, "*")
LANGW = [("en", 0, "the and of to in is that for it with by".split()), ("de", 1, "der die und das ist von mit auf ein nicht zu".split()),
         ("fr", 2, "le la les des et un une dans que est pour".split()), ("es", 3, "el los las de en y que del una por".split())]
NEG = W.rows_of({"n": "the|of|with"}, "en") + W.rows_of({"n": "der|die|nicht"}, "de") + W.rows_of(W.NEGATIVE_TERMS, "en")
POS = W.rows_of({"p": "and|is|for|by"}, "en") + W.rows_of({"p": "la|et|un"}, "fr") + W.rows_of(W.POSITIVE_TERMS, "en")

VIEWS = {
    "type_term": values(TYPE_ROWS, "grp, g, lang, kw, r"), "veh_term": values(VEH, "grp, g, lang, kw, r"), "evt_term": values(EVT, "grp, g, lang, kw, r"),
    "tag_term": values(TAG, "grp, g, lang, kw, r"), "tier_term": values(TIERW, "grp, g, lang, kw, r"), "cargo_term": values(CARGOW, "grp, g, lang, kw, r"),
    "lang_term": values(LANGW, "lang, r, words"), "neg_term": values(NEG, "grp, g, lang, kw, r"), "pos_term": values(POS, "grp, g, lang, kw, r"),
}


def tq(name, survey, sql=None):
    return query(name, survey, sql, VIEWS)


def docs(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def dic(spark, rows):
    return literal(spark, rows, W.SCHEMA)


TEXT = "text"


@tq("classify_type", "T18", """WITH h AS (SELECT d.doc_id, k.grp, k.g, sum(CASE WHEN k.lang = d.lang THEN 2 ELSE 1 END) AS s FROM documents d JOIN type_term k ON (k.lang = d.lang OR k.lang = 'en') AND contains(lower(d.text), k.kw) GROUP BY 1, 2, 3),
  b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, g) = 1) SELECT d.doc_id, coalesce(b.grp, 'other') AS event_type FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id""")
def _(spark, sf):
    return e.classify_type(docs(spark, sf), dic(spark, TYPE_ROWS), TEXT, "lang").select("doc_id", "event_type")


@tq("severity", "T19", f"""SELECT id, CASE WHEN event_type IN ('theft_cargo', 'theft_vehicle') AND financial_impact_eur > 50000 THEN 'critical' WHEN event_type = 'bankruptcy' AND financial_impact_eur > 1000000 THEN 'critical' WHEN event_type IN ('theft_cargo', 'theft_vehicle', 'bankruptcy', 'license_revoked') THEN 'high'
  WHEN event_type = 'strike' AND ({' OR '.join(f"contains(lower(description || title), '{w}')" for w in V.STRIKE_SCALE)}) THEN 'high' WHEN event_type IN ('strike', 'theft_fuel', 'damage', 'payment_issue', 'restructuring', 'route_closure') THEN 'medium' WHEN event_type = 'delay' THEN 'low' ELSE 'info' END AS severity
  FROM (SELECT id, event_type, financial_impact_eur, title, description || CASE WHEN id % 4 = 0 THEN ' Nationwide ' ELSE '' END AS description FROM incident)""")
def _(spark, sf):
    d = B.incidents(spark, sf).withColumn("description", F.concat("description", F.when(F.col("id") % 4 == 0, " Nationwide ").otherwise("")))
    return e.severity(d, F.concat("description", "title")).select("id", "severity")


@tq("tags", "T20", """SELECT d.doc_id, coalesce(string_agg(grp, ',' ORDER BY g), '') AS tags FROM documents d LEFT JOIN (SELECT DISTINCT d.doc_id, k.grp, k.g FROM documents d JOIN tag_term k ON contains(lower(d.text), k.kw)) h ON h.doc_id = d.doc_id GROUP BY 1""")
def _(spark, sf):
    return e.tags(docs(spark, sf), dic(spark, TAG), TEXT).select("doc_id", "tags")


MAPT = {k: x[0] for k, x in V.TIER_OF_TYPE.items()}
MAPC = {k: x[1] for k, x in V.TIER_OF_TYPE.items()}
ET = "CASE doc_id % 3 WHEN 0 THEN 'theft_cargo' WHEN 1 THEN 'payment_issue' END"


@tq("tier", "T21", f"""WITH d AS (SELECT doc_id, lower(text) AS x, {ET} AS et FROM documents), h AS (SELECT d.doc_id, CAST(split_part(k.grp, '/', 1) AS INTEGER) AS t, split_part(k.grp, '/', 2) AS c, k.g, count(*) AS n FROM d JOIN tier_term k ON contains(x, k.kw) GROUP BY ALL),
  b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY t, n DESC, g) = 1), m AS (SELECT doc_id, t, sum(n) AS n FROM h GROUP BY 1, 2)
  SELECT d.doc_id, coalesce({case('et', MAPT)}, b.t, 4) AS intelligence_tier, coalesce({case('et', MAPC)}, b.c, 'general_news') AS intelligence_category,
  round(CASE WHEN et IS NOT NULL THEN least(1.0, CASE WHEN m.n > 0 THEN 0.7 ELSE 0.5 END + coalesce(m.n, 0) * 0.05) ELSE CASE WHEN b.n IS NULL THEN 0.2 ELSE least(1.0, 0.4 + b.n * 0.1) END END, 2)::DOUBLE AS intelligence_confidence
  FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id AND m.t = {case('et', MAPT)}""")
def _(spark, sf):
    d = docs(spark, sf).withColumn("event_type", F.expr(ET))
    return e.tier(d, dic(spark, TIERW), TEXT).select("doc_id", "intelligence_tier", "intelligence_category", "intelligence_confidence")


@tq("road_alert_type", "T24", """WITH h AS (SELECT d.doc_id, k.grp, k.g, count(*) AS n FROM documents d JOIN tag_term k ON contains(lower(d.text), k.kw) GROUP BY 1, 2, 3), b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) = 1)
  SELECT d.doc_id, coalesce(b.grp, 'other') AS alert_type FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id""")
def _(spark, sf):
    return e.road_alert_type(docs(spark, sf), dic(spark, TAG), TEXT).select("doc_id", "alert_type")


@tq("cargo_type", "T30", """WITH h AS (SELECT d.doc_id, k.grp FROM documents d JOIN cargo_term k ON contains(lower(d.text), k.kw) QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY k.g) = 1) SELECT d.doc_id, h.grp AS cargo_type FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id""")
def _(spark, sf):
    return e.cargo_type(docs(spark, sf), dic(spark, CARGOW), TEXT).select("doc_id", "cargo_type")


@tq("cargo_types_all", "T40", """SELECT d.doc_id, coalesce(string_agg(grp, ',' ORDER BY g), '') AS cargo_types FROM documents d LEFT JOIN (SELECT DISTINCT d.doc_id, k.grp, k.g FROM documents d JOIN cargo_term k ON contains(lower(d.text), k.kw)) h ON h.doc_id = d.doc_id GROUP BY 1""")
def _(spark, sf):
    return p.ent_cargo(docs(spark, sf), dic(spark, CARGOW), TEXT).select("doc_id", "cargo_types")


def has(view, lang):
    return f"EXISTS (SELECT 1 FROM {view} k WHERE k.lang = {lang} AND contains(x, k.kw))"


DL = "CASE WHEN lang IN (SELECT lang FROM {v}) THEN lang ELSE 'en' END"


@tq("is_transport", "F13", f"""SELECT doc_id, {has('veh_term', 'vl')} AND {has('evt_term', 'el')} AS is_transport FROM (SELECT doc_id, lower(text) AS x, {DL.replace('{v}', 'veh_term')} AS vl, {DL.replace('{v}', 'evt_term')} AS el FROM documents)""")
def _(spark, sf):
    return f.is_transport(docs(spark, sf), dic(spark, VEH), dic(spark, EVT), TEXT, "lang").select("doc_id", "is_transport")


@tq("has_event_word", "F14", f"SELECT doc_id, {has('evt_term', 'lang0')} OR {has('evt_term', chr(39) + 'en' + chr(39))} AS has_event_word FROM (SELECT doc_id, lower(text) AS x, lang AS lang0 FROM documents)")
def _(spark, sf):
    return f.has_event_word(docs(spark, sf), dic(spark, EVT), TEXT, "lang").select("doc_id", "has_event_word")


@tq("matches_any", "F15", "SELECT doc_id, contains(lower(text), 'thand') OR contains(lower(text), 'eauaux') OR contains(lower(text), 'keit') AS hit FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", f.matches_any(TEXT, ["Thand", "eauaux", "KEIT"]).alias("hit"))


@tq("is_road_alert", "F16", f"SELECT doc_id, {has('evt_term', 'el')} AS is_road_alert FROM (SELECT doc_id, lower(text) AS x, {DL.replace('{v}', 'evt_term')} AS el FROM documents)")
def _(spark, sf):
    return f.is_road_alert(docs(spark, sf), dic(spark, EVT), TEXT, "lang").select("doc_id", "is_road_alert")


@tq("route_streams", "F20", f"""SELECT conv_id, turn, a AS stream_incident, b AS stream_road FROM (SELECT conv_id, turn, ({has('veh_term', "'en'")} AND {has('evt_term', "'en'")}) OR (conv_id % 3 = 0 AND {has('evt_term', "'en'")}) AS a, {has('tag_term', "'*'")} AS b FROM (SELECT conv_id, turn, lower(text) AS x FROM conversations)) WHERE a OR b""")
def _(spark, sf):
    m = B.table(spark, sf, "conversations").withColumn("language", F.lit("en"))
    road = dic(spark, [(g, k, "en", w, r) for g, k, _, w, r in TAG])
    return f.route_streams(m, dic(spark, VEH), dic(spark, EVT), road, TEXT, "language", F.col("conv_id") % 3 == 0).select("conv_id", "turn", "stream_incident", "stream_road")


def langs(spark):
    return literal(spark, LANGW, "lang string, rank int, words array<string>")


LQ = """WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '{rx}')) AS l FROM documents), s AS (SELECT doc_id, k.lang, k.r, len(list_intersect(l, k.words)) AS s FROM w CROSS JOIN lang_term k),
  b AS (SELECT * FROM s WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, r) = 1) SELECT d.doc_id, coalesce(b.lang, 'en') AS detected FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id"""


@tq("detect_language", "T9", LQ.replace("{rx}", "[\\p{L}\\p{N}_]+"))
def _(spark, sf):
    return e.detect_language(docs(spark, sf), TEXT, langs(spark), "detected").select("doc_id", "detected")


@tq("detect_language_latin", "T10", LQ.replace("{rx}", "[a-zÀ-ɏ]{2,}"))
def _(spark, sf):
    return e.detect_language(docs(spark, sf), TEXT, langs(spark), "detected", latin=True).select("doc_id", "detected")


SENT = """WITH w AS (SELECT doc_id, lang, list_distinct(regexp_extract_all(lower(text), '[a-zÀ-ɏ]{2,}')) AS l FROM documents),
  c AS (SELECT doc_id, len(list_intersect(l, (SELECT list(DISTINCT kw) FROM neg_term k WHERE k.lang = w.lang OR k.lang = 'en'))) AS n, len(list_intersect(l, (SELECT list(DISTINCT kw) FROM pos_term k WHERE k.lang = w.lang OR k.lang = 'en'))) AS p FROM w)
  SELECT doc_id, CAST(n AS INTEGER) AS negative_count, CAST(p AS INTEGER) AS positive_count, coalesce(""" + half("(p - n) / nullif(p + n, 0)::DOUBLE", 2) + """, 0.0)::DOUBLE AS sentiment_score, CASE WHEN n + p = 0 THEN 'NEUTRAL' WHEN round((p - n) / (p + n)::DOUBLE, 2) < -0.2 THEN 'NEGATIVE' WHEN round((p - n) / (p + n)::DOUBLE, 2) > 0.2 THEN 'POSITIVE' ELSE 'NEUTRAL' END AS sentiment FROM c"""


@tq("sentiment", "T42", SENT)
def _(spark, sf):
    return p.sentiment(docs(spark, sf), dic(spark, NEG), dic(spark, POS), TEXT, "lang").select("doc_id", "negative_count", "positive_count", "sentiment_score", "sentiment")


@tq("debt_type", "T26", "SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(x, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in V.DEBT_TERMS) + " ELSE 'debt' END AS debt_type FROM (SELECT doc_id, lower(text) || CASE doc_id % 5 WHEN 0 THEN ' Upadłość ' WHEN 1 THEN ' overdue' WHEN 2 THEN ' creditor' ELSE '' END AS x FROM (SELECT doc_id, text FROM documents))".replace("' Upadłość '", "' upadłość '"))
def _(spark, sf):
    x = F.concat("text", F.expr("case doc_id % 5 when 0 then ' Upadłość ' when 1 then ' overdue' when 2 then ' creditor' else '' end"))
    return docs(spark, sf).select("doc_id", t.debt_type(x).alias("debt_type"))


@tq("licence_decision", "T27", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'license_revocation' WHEN doc_id % 4 = 1 THEN 'license_suspension' WHEN doc_id % 4 = 2 THEN 'license_expiry' ELSE 'license_change' END AS decision, CASE WHEN doc_id % 2 = 0 THEN 'AB/' || CAST(doc_id AS VARCHAR) END AS number FROM documents")
def _(spark, sf):
    x = F.concat(
        F.expr("case doc_id % 4 when 0 then 'Cofnięcie' when 1 then 'Zawieszenie' when 2 then 'wygasła' else 'zmiana' end"), F.lit(" "),
        F.expr("case when doc_id % 2 = 0 then concat('Licencja nr AB/', cast(doc_id as string)) else '' end"), F.lit(" "), F.substring("source", 1, 5))
    return docs(spark, sf).select("doc_id", t.licence_decision(x).alias("decision"), t.licence_number(x).alias("number"))


@tq("proceeding", "T28", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Eröffnung' WHEN doc_id % 3 = 1 THEN 'Aufhebung' END AS kind, CASE WHEN doc_id % 2 = 0 THEN 'Amtsgericht Köln-' || source END AS court FROM documents")
def _(spark, sf):
    x = F.concat(F.expr("case doc_id % 3 when 0 then 'eröffnung des ' when 1 then 'AUFHEBUNG ' else '' end"), F.expr("case when doc_id % 2 = 0 then concat('Amtsgericht Köln-', source) else 'kein' end"), F.lit(", 12"))
    return docs(spark, sf).select("doc_id", t.proceeding_type(x).alias("kind"), t.court_name(x).alias("court"))


PHONE, EMAIL, PESEL, NIP, CARD, IBAN = (V.PII[k][0] for k in ("phone", "email", "pesel", "nip", "card", "iban"))


def scrub_sql(x):
    for k in ("phone", "email", "pesel", "nip", "card", "iban"):
        x = f"regexp_replace({x}, '{V.PII[k][0]}', '{V.PII[k][1]}', 'g')"
    return x


@tq("scrub_pii", "T12", f"SELECT doc_id, md5({scrub_sql('text')}) AS digest, CAST(length({scrub_sql('text')}) AS INTEGER) AS n FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", t.scrub_pii("text").alias("s")).select("doc_id", F.md5("s").alias("digest"), F.length("s").alias("n"))


@tq("scrub_plates", "T13", f"SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text ELSE regexp_replace(text, '{V.PII['plate'][0]}', '{V.PII['plate'][1]}', 'g') END) AS digest FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(t.scrub_plates("text", F.col("doc_id") % 3 == 0)).alias("digest"))


@tq("has_pii", "T14", f"SELECT doc_id, regexp_matches(text, '{PHONE}') OR regexp_matches(text, '{EMAIL}') OR regexp_matches(text, '{PESEL}') AS pii FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", t.has_pii("text").alias("pii"))


def cnt(k, x="text"):
    return f"len(regexp_extract_all({x}, '{V.PII[k][0]}'))"


@tq("pii_report", "T15", f"""SELECT doc_id, CAST({cnt('phone')} AS INTEGER) AS removed_phones, CAST({cnt('email')} AS INTEGER) AS removed_emails, CAST({cnt('pesel')} + {cnt('nip')} + {cnt('card')} AS INTEGER) AS removed_ids, CAST({cnt('plate')} AS INTEGER) AS removed_plates,
  CAST(length(text) AS INTEGER) AS original_length, CAST(length({scrub_sql('text')}) AS INTEGER) AS anonymized_length FROM documents""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", *[c.alias(n) for n, c in t.pii_counts("text").items()])


def social_sql(x):
    for k in ("phone", "email", "mention", "user"):
        x = f"regexp_replace({x}, '{V.SOCIAL[k][0]}', '{V.SOCIAL[k][1]}', 'g')"
    return x


@tq("scrub_social", "T16", f"SELECT conv_id, turn, md5({social_sql(chr(39) + '<@!12345> call +48 600 100 200 or a.b@c.io @nick ' + chr(39) + ' || text')}) AS digest FROM conversations")
def _(spark, sf):
    x = F.concat(F.lit("<@!12345> call +48 600 100 200 or a.b@c.io @nick "), "text")
    return B.table(spark, sf, "conversations").select("conv_id", "turn", F.md5(t.scrub_social(x, mentions=True)).alias("digest"))


@tq("pseudonym", "T17", "SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'channel:Chan ' || CAST(conv_id AS VARCHAR) ELSE 'user:' || substr(sha256(CAST(conv_id AS VARCHAR)), 1, 10) END AS sender FROM conversations")
def _(spark, sf):
    m = B.table(spark, sf, "conversations")
    kind = F.when(F.col("role") == "assistant", "channel").otherwise("user")
    return m.select("conv_id", "turn", t.pseudonym(kind, "conv_id", F.concat(F.lit("Chan "), F.col("conv_id").cast("string"))).alias("sender"))


def neutral_sql(x):
    for w, n in sorted(V.NEUTRAL, key=lambda q: -len(q[0])):
        x = f"regexp_replace({x}, '\\b{w}\\b', '{n}', 'gi')"
    return x


@tq("neutralise", "T22", f"SELECT id, {neutral_sql(chr(39) + 'Fraud by a thief, ILLEGAL scam; Betrug Diebstahl Dieb. ' + chr(39) + ' || title')} AS fair FROM incident")
def _(spark, sf):
    return B.incidents(spark, sf).select("id", t.neutralise(F.concat(F.lit("Fraud by a thief, ILLEGAL scam; Betrug Diebstahl Dieb. "), "title")).alias("fair"))


@tq("road_km", "T25", "SELECT id, CASE WHEN id % 3 = 0 THEN 'A2 km ' || CAST(id % 400 AS VARCHAR) WHEN id % 3 = 1 THEN 'E40' END AS place FROM incident")
def _(spark, sf):
    x = F.expr("case id % 3 when 0 then concat('near a2 km ', cast(id % 400 as string), ' today') when 1 then 'on e40, heavy' else 'no road' end")
    return B.incidents(spark, sf).select("id", t.road_km(x).alias("place"))


@tq("parse_number", "T4", "SELECT id, CASE id % 6 WHEN 0 THEN 1000 + id % 900 + 0.56 WHEN 1 THEN 1000 + id % 900 + 0.56 WHEN 2 THEN 1234.5 WHEN 3 THEN 1234.0 WHEN 4 THEN 1.234 END::DOUBLE AS n FROM incident")
def _(spark, sf):
    k = "cast(1000 + id % 900 as string)"
    x = F.expr(f"case id % 6 when 0 then concat(substring({k}, 1, 1), '.', substring({k}, 2), ',56') when 1 then concat(substring({k}, 1, 1), ',', substring({k}, 2), '.56') when 2 then ' 1234,5' when 3 then '1,234' when 4 then '1.234' else '12..3' end")
    return B.incidents(spark, sf).select("id", v.parse_number(x).alias("n"))


@tq("country_code_norm", "T6", "SELECT n_nationkey, substr(upper(trim('  ' || lower(n_name))), 1, 2) AS cc FROM nation")
def _(spark, sf):
    return B.table(spark, sf, "nation").select("n_nationkey", t.norm_country(F.concat(F.lit("  "), F.lower("n_name"))).alias("cc"))


@tq("to_utc", "T7", "SELECT id, CASE id % 3 WHEN 0 THEN strftime(date_trunc('second', date_occurred) - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S+00:00') WHEN 1 THEN strftime(date_occurred, '%Y-%m-%dT%H:%M:%S+00:00') ELSE 'yesterday' END AS utc FROM incident")
def _(spark, sf):
    iso = "date_format(date_occurred, \"yyyy-MM-dd'T'HH:mm:ss\")"
    d = B.incidents(spark, sf).selectExpr("id", f"case id % 3 when 0 then concat({iso}, '+02:00') when 1 then concat({iso}, 'Z') else 'yesterday' end as d")
    return d.select("id", t.to_utc("d").alias("utc"))


@tq("fx_eur", "T8", f"SELECT id, CASE WHEN c IN ('EUR') OR c IS NULL THEN amt ELSE {half('amt * r', 2)} END AS eur FROM (SELECT id, financial_impact_eur AS amt, [NULL, 'EUR', 'pln', 'GBP', 'XYZ'][CAST(id % 5 + 1 AS INTEGER)] AS c, [1.0, 1.0, 0.23, 1.16, 1.0][CAST(id % 5 + 1 AS INTEGER)]::DOUBLE AS r FROM incident)")
def _(spark, sf):
    d = B.incidents(spark, sf).selectExpr("id", "financial_impact_eur as amt", "element_at(array(null, 'EUR', 'pln', 'GBP', 'XYZ'), cast(id % 5 as int) + 1) as c")
    return d.select("id", v.fx_eur("amt", "c").alias("eur"))


@tq("origin", "T45", "SELECT id, CASE WHEN id % 2 = 0 THEN source_name ELSE '' END AS origin FROM incident")
def _(spark, sf):
    return B.incidents(spark, sf).select("id", t.origin(F.expr("case when id % 2 = 0 then concat(title, ' - x - ', source_name) else title end")).alias("origin"))


@tq("extract_date", "T1", """SELECT id, strftime(CASE id % 6 WHEN 0 THEN date_trunc('minute', date_occurred) WHEN 5 THEN NULL ELSE date_trunc('day', date_occurred) END, '%Y-%m-%d %H:%M:%S.%f') AS d FROM incident""")
def _(spark, sf):
    x = """case id % 6 when 0 then date_format(date_occurred, "yyyy-MM-dd'T'HH:mm") when 1 then date_format(date_occurred, 'dd.MM.yy') when 2 then date_format(date_occurred, 'd/M/yyyy')
      when 3 then date_format(date_occurred, 'dd-MM-yyyy') when 4 then concat(dayofmonth(date_occurred), ' stycznia ', year(date_occurred)) else '31.02.2024' end"""
    return B.incidents(spark, sf).selectExpr("id", f"concat('on ', {x}, ' at') as x", "description").select("id", v.extract_date("x", "description").alias("d"))


@tq("money_eur", "T3", """SELECT id, CASE WHEN id % 9 = 3 THEN greatest(12500.0, CASE id % 4 WHEN 0 THEN 23.0 * (id % 90 + 1) WHEN 1 THEN 1000.5 WHEN 2 THEN 116.0 ELSE 0.0 END) ELSE CASE id % 4 WHEN 0 THEN 23.0 * (id % 90 + 1) WHEN 1 THEN 1000.5 WHEN 2 THEN 116.0 END END::DOUBLE AS eur FROM incident""")
def _(spark, sf):
    x = "case id % 4 when 0 then concat('loss of ', cast((id % 90 + 1) * 100 as string), ' zł;') when 1 then 'about € 1.000,50 and 12 eur' when 2 then 'GBP 100.' else 'none' end"
    return B.incidents(spark, sf).selectExpr("id", f"concat({x}, ' ', description) as x").select("id", v.money_eur("x").alias("eur"))


@tq("money_in_documents", "T3")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", v.money_eur("text").alias("eur"))


@tq("registry_amount", "T29", "SELECT id, CASE id % 4 WHEN 0 THEN 1234.5 WHEN 1 THEN 230.0 WHEN 2 THEN 116.0 END::DOUBLE AS eur FROM incident")
def _(spark, sf):
    x = F.expr("case id % 4 when 0 then '1.234,50 EUR owed' when 1 then 'kwota 1,000.00 zł' when 2 then '100 GBP' else 'unknown' end")
    return B.incidents(spark, sf).select("id", v.registry_amount(x).alias("eur"))


@tq("normalise_text", "T5", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(nfc_normalize(text), chr(160) || chr(9), '  '), ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '')) AS digest FROM documents""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(t.normalise_text("text")).alias("digest"))


BARE = r"""regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')"""


@tq("strip_html", "S8", f"SELECT page_id, length(trim({BARE}))::INTEGER AS n, md5(trim({BARE})) AS digest FROM pages")
def _(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", t.strip_html("html").alias("_text")).select("page_id", F.length("_text").alias("n"), F.md5("_text").alias("digest"))


@tq("company_key", "T11", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Nordic Trans' WHEN 1 THEN 'O''Neil ABC' WHEN 2 THEN 'Żółty Las' WHEN 3 THEN 'Fast Cargo' ELSE 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS key FROM customer""")
def _(spark, sf):
    x = F.expr("case c_custkey % 5 when 0 then '  nordic   trans sp. z o.o.' when 1 then 'o\\'neil ABC GmbH' when 2 then 'Firma \"żółty las\"' when 3 then 'Company fast cargo Ltd.' else c_name end")
    return B.table(spark, sf, "customer").select("c_custkey", t.company_key(x).alias("key"))


def mask_sql(x, phrase):
    """Word edges as in the operator, with letters of all alphabets: what stands before a name is kept."""
    word = "[A-ZÀ-ž][a-zÀ-ž]+"
    named = rf"(^|[^\p{{L}}\p{{N}}_])({word}(?:\s+{word}){{{{0,3}}}})\s+(?:{'|'.join(V.LEGAL_FORMS_MASK)})\b".replace("{{", "{").replace("}}", "}")
    return f"""regexp_replace(regexp_replace({x}, '{named}', '\\1' || {phrase}, 'g'), '["„“]([^"”‟]{{3,50}})["”‟]', '"' || {phrase} || '"', 'g')"""


@tq("mask_companies", "T23", f"""SELECT id, {mask_sql("'Reported: Nordic Trans GmbH and „Fast Cargo” near ' || title", "'firma transportowa z regionu ' || coalesce(region, 'nieznany')")} AS masked FROM incident""")
def _(spark, sf):
    x = F.concat(F.lit("Reported: Nordic Trans GmbH and „Fast Cargo” near "), "title")
    return B.incidents(spark, sf).select("id", t.mask_companies(x, "region").alias("masked"))


@tq("redact_persons", "T39")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(t.redact_persons("text")).alias("digest"))


@tq("modus_operandi", "T31,T32", "SELECT id, CASE WHEN id % 9 = 3 THEN NULL WHEN id % 3 = 0 THEN 'curtain_slashed' WHEN id % 3 = 1 THEN 'fuel_theft' END AS mo, CASE WHEN id % 2 = 0 THEN 'DE' ELSE 'CZ' END AS veh FROM incident".replace("WHEN id % 9 = 3 THEN NULL ", ""))
def _(spark, sf):
    x = F.expr("concat(case id % 3 when 0 then 'Curtain slashed at night, ' when 1 then 'fuel siphoned, ' else 'nothing, ' end, case when id % 2 = 0 then 'german-registered' else 'plate CZ 123 45' end)")
    return B.incidents(spark, sf).select("id", e.modus_operandi(x).alias("mo"), e.vehicle_country(x).alias("veh"))


PLACES = values([(k, cc, region, i) for i, (k, (cc, region)) in enumerate(V.PLACE_REGIONS.items())], "key, country, region, r")
GAZ = values([(key.lower(), name, cc, lat, lon, pop, 1000 * i + j) for i, (name, cc, lat, lon, pop, more) in enumerate(V.CITIES) for j, key in enumerate([name, *more])], "key, city, country, lat, lon, pop, r")


@tq("extract_place", "T2", rf"""WITH place AS ({PLACES}), d AS (SELECT id, country_code, 'Near ' || coalesce(city, 'nowhere') || ' on A2: ' || title AS x FROM incident), t AS (SELECT DISTINCT x, lower(x) AS l FROM d),
  b AS (SELECT t.x, key, region, country FROM t JOIN place ON contains(l, key) AND regexp_matches(l, '(^|[^\p{{L}}\p{{N}}_])' || key || '([^\p{{L}}\p{{N}}_]|$)') QUALIFY row_number() OVER (PARTITION BY t.x ORDER BY r) = 1)
  SELECT d.id, upper(replace(replace(regexp_extract(d.x, '(?i)\b([ABE][\s-]?\d{{1,4}})\b', 1), ' ', ''), '-', '')) AS road, upper(b.key[1]) || b.key[2:] AS city, b.region, coalesce(nullif(d.country_code, ''), b.country) AS country_code FROM d LEFT JOIN b ON b.x = d.x""")
def _(spark, sf):
    d = B.incidents(spark, sf).selectExpr("id", "concat('Near ', coalesce(city, 'nowhere'), ' on A2: ', title) as x", "country_code")
    return e.extract_place(d, e.places(spark), F.col("x")).select("id", "road", "city", "region", "country_code")


GEO = rf"""WITH gaz AS ({GAZ}), hw AS ({values([(k, v) for k, v in V.HIGHWAY_COUNTRIES.items()], "code, ccs")}), reg AS ({values([(i, *r) for i, r in enumerate(V.REGION_POINTS)], "r, country, region, lat, lon")}),
  bd AS ({values([(i, *x) for i, x in enumerate(V.BORDERS)], "r, name, ccs, lat, lon")}), pk AS ({values([(i, *x) for i, x in enumerate(V.PARKS)], "r, name, country, lat, lon")}), cor AS ({values([(i, n, c, r) for i, (n, (c, r)) in enumerate(V.CORRIDORS.items())], "r, name, ccs, roads")}),
  d AS (SELECT id, 'Near ' || coalesce(city, 'nowhere') || ', km 12,5: ' || description AS x, upper(country_code) AS cc FROM incident), t AS (SELECT DISTINCT x, cc, lower(x) AS l, nullif(regexp_extract(x, '\b([ABEMDNS]\d{{1,3}})\b', 1), '') AS highway FROM d),
  c AS (SELECT x, cc, city, country, lat, lon, CASE WHEN length(key) > 4 THEN 0.85::DOUBLE ELSE 0.65::DOUBLE END + CASE WHEN pop > 500000 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS conf FROM t JOIN gaz ON length(key) > 2 AND contains(l, key) AND (cc IS NULL OR country = cc) QUALIFY row_number() OVER (PARTITION BY x, cc ORDER BY conf DESC, r) = 1),
  g AS (SELECT x, cc, arg_max(region, r) AS region, arg_min(reg.lat, r) AS lat, arg_min(reg.lon, r) AS lon FROM t JOIN reg ON country = cc AND contains(l, lower(region)) GROUP BY x, cc),
  b AS (SELECT x, cc, arg_max(name, r) AS name, arg_max(ccs[1], r) AS first_cc, arg_min(bd.lat, r) AS lat, arg_min(bd.lon, r) AS lon FROM t JOIN bd ON len(list_filter(string_split(lower(name), '-'), lambda p: length(trim(p)) > 3 AND contains(l, trim(p)))) > 0 GROUP BY x, cc),
  p AS (SELECT x, cc, arg_max(name, r) AS name, arg_min(country, r) AS country, arg_min(pk.lat, r) AS lat, arg_min(pk.lon, r) AS lon FROM t JOIN pk ON len(list_filter(string_split(lower(name), ' '), lambda w: length(w) > 3 AND contains(l, w))) >= 2 GROUP BY x, cc),
  m AS (SELECT t.*, c.city, c.country AS city_cc, c.lat AS clat, c.lon AS clon, c.conf, g.region, g.lat AS glat, g.lon AS glon, b.name AS border, b.first_cc, b.lat AS blat, b.lon AS blon, p.name AS park, p.country AS park_cc, p.lat AS plat, p.lon AS plon, coalesce(conf, 0) AS best,
    CASE WHEN list_contains(hw.ccs, t.cc) THEN t.cc ELSE hw.ccs[1] END AS hw_cc FROM t LEFT JOIN c ON c.x = t.x AND c.cc IS NOT DISTINCT FROM t.cc LEFT JOIN g ON g.x = t.x AND g.cc = t.cc LEFT JOIN b ON b.x = t.x AND b.cc IS NOT DISTINCT FROM t.cc LEFT JOIN p ON p.x = t.x AND p.cc IS NOT DISTINCT FROM t.cc LEFT JOIN hw ON hw.code = t.highway),
  f AS (SELECT *, coalesce(CASE WHEN border IS NOT NULL THEN coalesce(cc, first_cc) END, city_cc, hw_cc, park_cc) AS found FROM m),
  k AS (SELECT x, cc, name AS corridor FROM (SELECT f.x, f.cc, cor.name, cor.r, CASE WHEN list_contains(ccs, found) THEN 1 ELSE 0 END + CASE WHEN list_contains(roads, highway) THEN 3 ELSE 0 END AS s FROM f CROSS JOIN cor WHERE found IS NOT NULL) WHERE s >= 1 QUALIFY row_number() OVER (PARTITION BY x, cc ORDER BY s DESC, r) = 1),
  o AS (SELECT f.x, f.cc, city, highway, region, border AS border_crossing, park AS parking, coalesce(clat, glat, blat, plat) AS latitude, coalesce(clon, glon, blon, plon) AS longitude,
    CASE WHEN border IS NOT NULL AND best < 0.75 THEN 0.75 WHEN region IS NOT NULL AND best < 0.55 THEN 0.55 WHEN highway IS NOT NULL AND best < 0.5 THEN 0.6 ELSE round(best, 2) END::DOUBLE AS confidence,
    CASE WHEN border IS NOT NULL AND best < 0.75 THEN 'border_match' WHEN region IS NOT NULL AND best < 0.55 THEN 'region_match' WHEN highway IS NOT NULL AND best < 0.5 THEN 'highway_match' WHEN city IS NOT NULL THEN 'city_match' END AS method, coalesce(found, f.cc) AS country, k.corridor,
    replace(nullif(regexp_extract(f.x, '(?i)(?:km|kilometer|kilometre|kilometr)\s*(\d+[.,]?\d*)', 1), ''), ',', '.') AS km FROM f LEFT JOIN k ON k.x = f.x AND k.cc IS NOT DISTINCT FROM f.cc)
  SELECT d.id, o.* EXCLUDE (x, cc, km), coalesce(nullif(concat_ws(', ', highway, 'km ' || km, city, 'parking: ' || parking, 'border: ' || border_crossing), ''), region) AS location_detail FROM d JOIN o ON o.x = d.x AND o.cc IS NOT DISTINCT FROM d.cc"""


@tq("geo_extract", "G3,T33", GEO)
def _(spark, sf):
    from cordon.operators import joins as j

    d = B.incidents(spark, sf).selectExpr("id", "concat('Near ', coalesce(city, 'nowhere'), ', km 12,5: ', description) as x", "country_code")
    g = e.geo_extract(d, "id", F.col("x"), F.col("country_code"), e.gazetteer(spark), e.highway_ref(spark), e.region_ref(spark), j.borders(spark), j.truck_parks(spark), j.corridor_members(spark))
    return e.location_detail(g.join(d.select("id", "x"), "id"), F.col("x")).drop("x")


@tq("text_profile", "T35,T36,T37,T38,T41,T43,T44")
def _(spark, sf):
    refs = {"vehicle": dic(spark, VEH), "cargo": dic(spark, CARGOW), "keyword": dic(spark, TYPE_ROWS), "negative": dic(spark, NEG), "positive": dic(spark, POS)}
    d = p.profile_text(docs(spark, sf), refs, TEXT, "lang")
    return d.select("doc_id", "sentiment", "keywords", "vehicles", "plate_count", "dates", "amounts", F.size("companies").alias("companies"), F.size("locations").alias("locations"), F.to_json("transport").alias("transport"))


@tq("enrich_from_articles", "T34", """WITH a AS (SELECT source_url AS u, repeat('x', CAST(min(id) % 40 AS INTEGER)) AS t, CASE WHEN min(id) % 2 = 0 THEN 'food' END AS c, (min(id) % 50)::DOUBLE AS eur FROM incident WHERE source_url IS NOT NULL AND region IS NOT NULL GROUP BY 1)
  SELECT i.id, coalesce(a.c, i.cargo_type) AS cargo_type, CASE WHEN coalesce(i.financial_impact_eur, 0) <> 0 THEN i.financial_impact_eur ELSE coalesce(a.eur, i.financial_impact_eur) END AS financial_impact_eur, CASE WHEN length(a.t) > length(i.description) THEN a.t ELSE i.description END AS description
  FROM incident i LEFT JOIN a ON a.u = i.source_url""")
def _(spark, sf):
    i = B.incidents(spark, sf).withColumn("vehicle_country", F.lit(None).cast("string")).withColumn("raw_text", F.col("description"))
    a = i.where("source_url is not null and region is not null").groupBy("source_url").agg(F.min("id").alias("m")).selectExpr(
        "source_url", "repeat('x', cast(m % 40 as int)) as full_text", "case when m % 2 = 0 then 'food' end as cargo_type", "cast(null as string) as modus_operandi",
        "cast(null as string) as location_detail", "cast(null as string) as vehicle_country", "cast(m % 50 as double) as value_eur")
    return e.enrich(i, a).select("id", "cargo_type", "financial_impact_eur", "description")
