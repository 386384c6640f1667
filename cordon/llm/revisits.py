"""WARC not-modified revisits, resolved to the responses that they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cordon.llm.text import let
from cordon.session import cut

RANGES = 256  # time ranges, equal in rows, that split every URL's records
#: Headers that a 304 response may update in the stored one (fixed values, lower case).
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning"]
#: Query parameters that only track (fixed values).
TRACKING = ["fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]


def canonical_url(url: Column) -> Column:
    """Scheme dropped, host in lower case without "www." and default port, no fragment, no tracking parameters, other parameters sorted, no
    trailing slash. Null or blank gives null."""
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^www\d*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(TRACKING)))
    tail = let(query, lambda q: F.when(F.size(q) > 0, F.concat(F.lit("?"), F.array_join(q, "&"))).otherwise(""))
    return F.when(host != "", F.concat(host, path, tail))


def resolve(records: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Every record with the full response it stands for.

    ``records``: record_id, url, ts (timestamp), status (int), etag, last_modified, headers map<string,string>, digest, length. A 304 (or a null
    digest) is a revisit, a 2xx with a digest a full response. Returns record_id, canonical_url, ts, state, refers_to, digest, length, headers.

    state: "full" (stands for itself); "resolved" (the latest earlier full response of the canonical URL has the same validator); "conflict" (it has another);
    "unvalidated" (the revisit names no validator that the response has); "orphan" (no earlier one); "other" (another status, or no
    usable URL or time). "Earlier" is by time, then record_id. A strong or weak ETag decides if both sides have one, else Last-Modified. Only a resolved row takes digest
    and length of the response, and its headers with those that a 304 may send laid over them. Header names are folded to lower case; of names that then
    agree the greatest value stays. Repeated rows resolve each alike; an empty table gives no rows.

    As-of join without a hot URL in one task: time is cut into ranges of about equal rows; each (URL, range) is ordered alone and
    starts with the last response of the ranges before, which one row for each URL and range carries."""
    key = canonical_url(F.col("url"))
    names = lambda m: F.map_from_entries(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    folded = F.when(F.col("headers").isNull(), F.create_map().cast("map<string,string>")).otherwise(names(merged_case(F.col("headers"))))
    rows = records.select("record_id", key.alias("canonical_url"), "ts", "status", "etag", "last_modified", folded.alias("headers"), "digest", "length")
    usable = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    revisit = (F.col("status") == 304) & usable
    full = F.col("status").between(200, 299) & F.col("digest").isNotNull() & usable
    rows = cut(rows.withColumns({"_revisit": F.coalesce(revisit, F.lit(False)), "_full": F.coalesce(full, F.lit(False))}))
    micros = F.unix_micros("ts")
    found = rows.where("_revisit or _full").agg(F.percentile_approx(micros, [i / ranges for i in range(1, ranges)], 10_000).alias("b")).first()["b"] or []
    bounds = F.array(*[F.lit(int(b)) for b in sorted(set(found))]).cast("array<bigint>")
    part = F.size(F.filter(bounds, lambda b: b < micros))
    asof = rows.where("_revisit or _full").withColumn("_part", part)
    response = F.when(F.col("_full"), F.struct("ts", "record_id", "etag", "last_modified", "headers", "digest", "length"))
    order = [F.col("ts"), F.col("record_id")]
    last = asof.where("_full").groupBy("canonical_url", "_part").agg(F.max_by(F.struct("record_id", "etag", "last_modified", "headers", "digest", "length"), F.struct("ts", "record_id")).alias("_last"))
    slots = asof.select("canonical_url", "_part").distinct().join(last, ["canonical_url", "_part"], "left")
    before = Window.partitionBy("canonical_url").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most ``ranges`` rows a URL
    carried = slots.select("canonical_url", "_part", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    within = Window.partitionBy("canonical_url", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = F.last(response, ignorenulls=True).over(within)
    pick = ["record_id", "etag", "last_modified", "headers", "digest", "length"]
    near = F.when(near.isNotNull(), F.struct(*[near[c].alias(c) for c in pick]))
    joined = asof.withColumn("_near", near).join(carried, ["canonical_url", "_part"]).withColumn("_from", F.coalesce("_near", "_carried"))
    return _decided(joined).unionByName(_others(rows.where("not (_revisit or _full)")))


def merged_case(headers: Column) -> Column:
    """One entry for each header name, whatever its case."""
    entries = F.array_sort(F.map_entries(headers))
    return let(entries, lambda e: F.map_from_entries(F.filter(e, lambda x: ~F.exists(e, lambda y: (F.lower(y["key"]) == F.lower(x["key"])) & ((y["value"] > x["value"]) | ((y["value"] == x["value"]) & (y["key"] > x["key"])))))))


def _opaque(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), r"^W/", "")


def _decided(joined: DataFrame) -> DataFrame:
    source = F.col("_from")
    both_tags = F.col("etag").isNotNull() & source["etag"].isNotNull()
    both_dates = F.col("last_modified").isNotNull() & source["last_modified"].isNotNull()
    agrees = F.when(both_tags, _opaque(F.col("etag")) == _opaque(source["etag"])).when(both_dates, F.col("last_modified") == source["last_modified"])
    state = F.when(F.col("_full"), "full").when(source.isNull(), "orphan").when(agrees, "resolved").when(agrees.isNull(), "unvalidated").otherwise("conflict")
    permitted = F.map_filter("headers", lambda k, v: k.isin(PERMITTED))
    laid = F.map_concat(F.map_filter(source["headers"], lambda k, v: ~F.map_contains_key(permitted, k)), permitted)
    done = F.col("state") == "resolved"
    return joined.withColumn("state", state).select(
        "record_id", "canonical_url", "ts", "state", F.when(F.col("_full"), F.col("record_id")).when(~F.col("state").isin("orphan"), source["record_id"]).alias("refers_to"),
        F.when(done, source["digest"]).otherwise(F.col("digest")).alias("digest"), F.when(done, source["length"]).otherwise(F.col("length")).alias("length"),
        F.when(done, laid).otherwise(F.col("headers")).alias("headers"))


def _others(rows: DataFrame) -> DataFrame:
    return rows.select("record_id", "canonical_url", "ts", F.lit("other").alias("state"), F.lit(None).cast(rows.schema["record_id"].dataType).alias("refers_to"), "digest", "length", "headers")


def with_bodies(resolved: DataFrame, records: DataFrame, body: str) -> DataFrame:
    """``resolved`` with the body of the response each row refers to; only ids and bodies are joined."""
    bodies = records.select(F.col("record_id").alias("refers_to"), body)
    return resolved.join(bodies, "refers_to", "left")


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of a ``pages`` table (page_id, url, html), one a page.

    The table holds no HTTP exchange, so one is derived from each row: page_id orders captures in time; pages of a site (host and first path part)
    stand for versions of one address; a page whose id is divisible by 3 is a not-modified answer that repeats the validator of its site's language version.
    The ETag names the site and, for one page in seven, a changed version."""
    site = F.regexp_extract(F.lower("url"), r"^([a-z]+://[^/?#]*/?[^/?#]*)", 1)
    revisit = F.col("page_id") % 3 == 0
    version = F.floor(F.col("page_id") / 7) % 2
    etag = F.when(F.col("page_id") % 11 != 0, F.concat(F.lit('"'), F.substring(F.md5(site), 1, 8), F.lit("-"), version.cast("string"), F.lit('"')))
    ts = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("page_id") * 1_000_000)
    day = F.date_format(F.timestamp_micros(F.lit(1_690_000_000_000_000) + version * 86_400_000_000), "yyyy-MM-dd")
    headers = F.create_map(F.lit("Date"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("ETag"), F.coalesce(etag, F.lit("")), F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.coalesce(F.length("html"), F.lit(0)).cast("string"))
    return pages.select(
        F.col("page_id").alias("record_id"), site.alias("url"), ts.alias("ts"), F.when(revisit, 304).otherwise(200).alias("status"), etag.alias("etag"), day.alias("last_modified"),
        headers.alias("headers"), F.when(~revisit, F.sha2("html", 256)).alias("digest"), F.when(~revisit, F.length("html").cast("long")).alias("length"))
