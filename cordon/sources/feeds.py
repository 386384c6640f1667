"""Feed items from stored RSS and Atom payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordon.functions.text import shortened, strip_html
from cordon.operators.sizes import first_by

TEXT = "struct<_VALUE:string>"
# one shape for both dialects; absent elements are null
ITEM = "title:string,link:string,description:string,pubDate:string,source:string"
RSS = f"channel struct<item:array<struct<{ITEM}>>>"
ENTRY = "title:string,link:struct<_href:string>,summary:string,content:string,published:string,updated:string"
ATOM = f"entry array<struct<{ENTRY}>>"


def feed_items(payloads: DataFrame, terms_fn=None, limit: int | None = None) -> DataFrame:
    """One row per new item of ``(feed_id, xml, source_name, language, …)``. Tags
    and entities are removed, the first date field that is present counts,
    text is cut only to a limit that is given, repeated links keep their first item. ``terms_fn`` may add the
    relevance filter over ``(title, description, language)``."""
    rss = payloads.where(F.contains("xml", F.lit("<channel"))).withColumn("x", F.from_xml("xml", RSS))
    rss = rss.select(*payloads.columns, F.posexplode("x.channel.item").alias("pos", "i")).select(
        *payloads.columns, "pos", F.col("i.title").alias("title"), F.col("i.link").alias("source_url"), F.col("i.description").alias("body"), F.col("i.pubDate").alias("date_raw")
    )
    atom = payloads.where(F.contains("xml", F.lit("<feed"))).withColumn("x", F.from_xml("xml", ATOM))
    atom = atom.select(*payloads.columns, F.posexplode("x.entry").alias("pos", "i")).select(
        *payloads.columns, "pos", F.col("i.title").alias("title"), F.col("i.link._href").alias("source_url"),
        F.coalesce("i.summary", "i.content").alias("body"), F.coalesce("i.published", "i.updated").alias("date_raw"),
    )
    items = rss.unionByName(atom).drop("xml")
    items = items.withColumn("title", strip_html("title")).withColumn("description", F.nullif(shortened(strip_html("body"), limit), F.lit("")))
    rfc = F.try_to_timestamp(F.regexp_replace("date_raw", r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    items = items.withColumn("date", F.coalesce(rfc, F.try_to_timestamp("date_raw"), F.try_to_timestamp("date_raw", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))).cast("timestamp_ntz"))
    items = items.withColumn("raw_text", F.coalesce("description", "title")).drop("body", "date_raw")
    if terms_fn is not None:
        items = terms_fn(items)
    return first_by(items, ["source_url"], [F.asc("feed_id"), F.asc("pos")])
