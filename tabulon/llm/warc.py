"""Resolution of not-modified revisits in WARC records.

A revisit record of the not-modified profile holds no body; the server said
that what it had sent before still stands. It is resolved to the latest full
response for the same canonical URL with an earlier capture time, an as-of
join. The pair counts only if the validators agree: entity tags compare weakly,
and where the revisit has none, the last-modified dates must be equal. The
resolved headers are those of the response, updated by those of the revisit
that a not-modified answer may change.

The as-of join is a running "last response so far", in two levels: within
(URL, time slice), and over the slices of a URL, each of which contributes one
row. A URL with a third of all captures is thus spread over its slices.

Defined cases: revisits without an earlier response are ``missing``, with other
validators ``changed``, without any validator ``unchecked`` (resolved all the
same, as the profile allows); a null or empty URL is never resolved; a null
time sorts before all others; of responses at the same time the largest record
id counts; a response at the same time as the revisit is not earlier; repeated
records are each resolved; extra columns are ignored. All of it is DataFrame
code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Query parameters that do not select content, and header fields
# of the stored response that a 304 answer must not replace (RFC 9111, 3.2).
TRACKING = ("utm_[a-z]+", "gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "ref", "ref_src", "igshid", "phpsessid", "jsessionid", "sid")
KEPT_FIELDS = (
    "connection",
    "content-encoding",
    "content-length",
    "content-location",
    "content-md5",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authentication-info",
    "proxy-authorization",
    "proxy-connection",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Host without ``www.``, default port, user and scheme; sorted query without tracking."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^(?i:https?)://", "")
    rest = F.regexp_extract(u, r"^[^/?]*(.*)$", 1)
    host = F.lower(F.regexp_extract(u, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r"^(www\d*\.)+", "")
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"\.$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"/+$", "")
    query = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")
    tracked = "^(?i:" + "|".join(TRACKING) + ")(=.*)?$"
    query = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(tracked)))
    out = F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))
    return F.when(host != "", out)


def _tag(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), r"^W/", "")


def latest_response(records: DataFrame, slice_seconds: int) -> DataFrame:
    """``records`` with ``url`` and ``before``: the latest response earlier than each.

    ``records`` has record_id, type, url_key, ts, etag, last_modified, headers.
    """
    kept = F.when(F.col("type") == "response", F.struct("ts", "record_id", "etag", "last_modified", "headers"))
    rows = records.withColumn("slice", F.floor(F.coalesce(F.unix_seconds("ts"), F.lit(0)) / slice_seconds)).withColumn("own", kept)
    # Rows at the same time are peers of a range frame, so "earlier" is strict.
    micros = F.coalesce(F.unix_micros("ts"), F.lit(-(2**62)))
    rows = rows.withColumn("at", micros)
    inside = Window.partitionBy("url_key", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.max("own").over(inside))
    last = rows.filter("type = 'response'").groupBy("url_key", "slice").agg(F.max("own").alias("own"))
    spans = last.unionByName(rows.filter("type = 'revisit'").select("url_key", "slice").distinct().withColumn("own", F.lit(None).cast(last.schema["own"].dataType)))
    spans = spans.groupBy("url_key", "slice").agg(F.max("own").alias("own"))
    over = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("url_key", "slice", F.last("own", ignorenulls=True).over(over).alias("carried"))
    revisits = rows.filter("type = 'revisit'")
    return revisits.join(spans, ["url_key", "slice"], "left").withColumn("before", F.coalesce("inside", "carried"))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored fields, updated by those that a not-modified answer may change."""
    lowered = F.transform_keys(fresh, lambda k, _: F.lower(k))
    may = F.map_filter(lowered, lambda k, _: ~k.isin(*KEPT_FIELDS))
    base = F.map_filter(F.transform_keys(stored, lambda k, _: F.lower(k)), lambda k, _: ~F.map_contains_key(may, k))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(base, may))))


def resolve_revisits(records: DataFrame, slice_seconds: int = 30 * 86400) -> DataFrame:
    """One row per revisit: the record it resolves to, how, and the merged headers.

    ``records``: ``record_id long, type string ('response' or 'revisit'), url
    string, ts timestamp, etag string, last_modified string, headers
    map<string,string>``.
    """
    cols = ["record_id", "type", F.col("ts").cast("timestamp").alias("ts"), "etag", "last_modified"]
    fields = F.array_sort(F.map_entries("headers")).alias("headers")  # maps have no order, arrays of entries do
    keyed = records.select(*cols, fields, canonical_url(F.col("url")).alias("url_key"))
    none = keyed.filter("type = 'revisit' and url_key is null").withColumn("before", F.lit(None).cast("struct<ts:timestamp,record_id:bigint,etag:string,last_modified:string,headers:array<struct<key:string,value:string>>>"))
    found = latest_response(keyed.filter("url_key is not null"), slice_seconds)
    names = ["record_id", "url_key", "etag", "last_modified", "headers", "before"]
    rows = found.select(*names).unionByName(none.select(*names))
    old = F.col("before")
    tags, dates = F.col("etag").isNotNull() & old["etag"].isNotNull(), F.col("last_modified").isNotNull() & old["last_modified"].isNotNull()
    status = (
        F.when(old.isNull(), "missing")
        .when(tags, F.when(_tag(F.col("etag")) == _tag(old["etag"]), "resolved").otherwise("changed"))
        .when(dates, F.when(F.col("last_modified") == old["last_modified"], "resolved").otherwise("changed"))
        .otherwise("unchecked")
    )
    rows = rows.withColumn("status", status)
    good = F.col("status").isin("resolved", "unchecked")
    empty = F.create_map().cast("map<string,string>")
    merged = merged_headers(F.coalesce(F.map_from_entries(old["headers"]), empty), F.coalesce(F.map_from_entries("headers"), empty))
    return rows.select("record_id", "url_key", "status", F.when(good, old["record_id"]).alias("response_id"), F.when(good, merged).alias("headers"))


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """WARC-like records of three crawls of ``pages``.

    Every page is a full response of the first crawl, at a time that follows
    from its id. The second crawl asks again a week later, under ``www.`` and
    with a tracking parameter, and gets "not modified". The third crawl, a week
    on, finds that pages whose digest starts with 0 to 3 have changed (another
    tag). Pages of the same URL meet in one history.
    """
    page = F.coalesce("html", F.lit(""))
    digest = F.md5(F.encode(page, "UTF-8"))
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60)
    week = F.expr("interval 7 days")
    again = F.concat(F.regexp_replace("url", "^(https?://)", "$1WWW."), F.when(F.col("url").contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit("utm_source=again"))
    tag = F.concat(F.lit('"'), digest, F.lit('"'))
    changed = F.when(F.substring(digest, 1, 1).isin("0", "1", "2", "3"), F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))
    size = F.octet_length(page).cast("string")

    def headers(*pairs: tuple[str, Column]) -> Column:
        return F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])

    def record(k: int, kind: str, url: Column, at: Column, etag: Column, fields: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.struct((F.col("page_id") * 3 + k).alias("record_id"), F.lit(kind).alias("type"), url.alias("url"), at.alias("ts"), etag.alias("etag"), none.alias("last_modified"), fields.alias("headers"))

    first = record(0, "response", F.col("url"), ts, tag, headers(("Content-Type", F.lit("text/html")), ("Content-Length", size), ("Date", F.lit("first")), ("Server", F.lit("s"))))
    second = record(1, "revisit", again, ts + week, tag, headers(("Date", F.lit("second")), ("Content-Length", F.lit("0"))))
    third = record(2, "revisit", F.col("url"), ts + week + week, changed, headers(("Date", F.lit("third")), ("X-Cache", F.lit("hit"))))
    return pages.select(F.inline(F.array(first, second, third)))


def revisit_report(pages: DataFrame) -> DataFrame:
    """Every revisit of the three crawls of ``pages`` with its resolution; headers as text."""
    rows = resolve_revisits(captures_of_pages(pages))
    text = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return rows.select("record_id", "url_key", "status", "response_id", text.alias("headers"))
