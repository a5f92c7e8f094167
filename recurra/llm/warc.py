"""Not-modified revisits of a crawl, resolved to the response that they stand for.

A revisit record (a 304 answer) has no body: it stands for the latest earlier full response (status 200) of the same
canonical URL. The as-of join is a tree over time: of each (URL, second) the full response is kept, then level by level
the last one before each child of a node, in windows of at most RADIX children, and what a node was given by its parent
passes on to children without an earlier sibling. So a URL that holds a large part of all records, even of one day, is
dealt out by nodes, and no window ever sees more than RADIX rows. Only ids and times climb the tree; headers and digests
are joined once, by the id found. Records without a URL match nothing and take no part.

Validators decide whether the response may be used: entity tags by weak comparison where both have one, else equal
modification dates where both have one, else nothing speaks against it ("unchecked"). Merged headers are the
response's, replaced by those of the revisit that a 304 answer may update (PERMITTED); the body and headers that
describe it stay the response's.

Defined results: one row for each revisit record. Null or missing URL, or no earlier full response: "unmatched";
validators that differ: "mismatch" (refers_to names the response, nothing is merged); records of one time: a response
counts as earlier only if its time is smaller, and of full responses of one time the greatest id is the latest; without a
time: "unmatched"; repeated revisits are resolved each, of responses that share id and time the greatest digest counts; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurra.llm.scratch import Scratch

#: Headers that a 304 answer may update; those that describe the body aren't among them.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid|sid|sessionid)(=|$)"
#: Children of a node of the tree over seconds, and its levels below the root (whose children are 2,000 years long).
RADIX, LEVELS = 4096, 4
_SCHEME = "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?"


def canonical_url(url: Column) -> Column:
    """Without scheme, leading www, default port, fragment, tracking parameters and final slashes; host in lower case, parameters sorted."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, _SCHEME + "([^/?]*)", 1)), "^www[0-9]*[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, _SCHEME + "[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(u, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def as_of(times: DataFrame) -> DataFrame:
    """(url_key, ts, found): the latest full response before each time; times(url_key, ts, full): the response kept for that second or null."""
    node = lambda level: F.floor(F.col("ts") / RADIX**level)
    latest = F.max("full")
    levels = [times.groupBy("url_key", F.col("ts").alias("node")).agg(latest.alias("full"))]
    for level in range(1, LEVELS):
        levels.append(times.groupBy("url_key", node(level).alias("node")).agg(latest.alias("full")))
    given = None
    for below in reversed(levels):
        up = F.lit(0).cast("long") if given is None else F.floor(F.col("node") / RADIX)
        before = Window.partitionBy("url_key", "up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        here = below.withColumn("up", up).withColumn("found", F.last("full", ignorenulls=True).over(before))
        if given is not None:
            here = here.join(given, ["url_key", "up"], "left").withColumn("found", F.coalesce("found", "given"))
        given = here.select("url_key", F.col("node").alias("up"), F.col("found").alias("given"))
    return given.select("url_key", F.col("up").alias("ts"), F.col("given").alias("found"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records: record_id long, kind ('response' or 'revisit'), status int, url string, ts long (seconds), headers
    map<string,string> (lower-case names), digest string, n_bytes long.

    Result: record_id, url_key, ts, outcome ('resolved', 'unmatched', 'mismatch'), validator ('etag', 'last-modified',
    'unchecked'), refers_to, headers (merged), digest, n_bytes.
    """
    scratch = Scratch(records.sparkSession, "revisits")
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    r = records.select("record_id", "kind", "status", canonical_url(F.col("url")).alias("url_key"), "ts", "headers", "digest", "n_bytes").withColumn("full", F.coalesce(full, F.lit(False)))
    r = scratch.save(r.where("full or kind = 'revisit'").drop("status"))  # read three times below, and much smaller than the bodies
    known = r.where("url_key is not null and ts is not null")
    times = as_of(known.select("url_key", "ts", F.when(F.col("full"), F.struct("ts", "record_id")).alias("full")))
    own = r.where("kind = 'revisit'").select("record_id", "url_key", "ts", F.col("headers").alias("own"))
    found = own.join(times, ["url_key", "ts"], "left")
    answers = r.where("full").select(F.struct("ts", "record_id").alias("found"), F.struct("record_id", "headers", "digest", "n_bytes").alias("f"))
    answers = answers.groupBy("found").agg(F.max_by("f", F.struct(F.col("f.digest"), F.col("f.n_bytes"))).alias("f"))  # rows that share an id and time: one of them
    j = found.join(answers, "found", "left")

    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    mine, theirs = F.col("own"), F.col("f.headers")
    validator = F.when(mine["etag"].isNotNull() & theirs["etag"].isNotNull(), "etag").when(mine["last-modified"].isNotNull() & theirs["last-modified"].isNotNull(), "last-modified").otherwise("unchecked")
    same = F.when(F.col("validator") == "etag", tag(mine) == tag(theirs)).when(F.col("validator") == "last-modified", mine["last-modified"] == theirs["last-modified"]).otherwise(True)
    j = j.withColumn("validator", F.when(F.col("f").isNotNull(), validator))
    j = j.withColumn("outcome", F.when(F.col("f").isNull(), "unmatched").when(same, "resolved").otherwise("mismatch"))
    no_headers = F.create_map().cast("map<string,string>")
    updates = F.map_filter(F.coalesce(mine, no_headers), lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    kept = F.map_filter(F.coalesce(theirs, no_headers), lambda k, v: ~F.map_contains_key(updates, k))
    ok = F.col("outcome") == "resolved"
    return j.select(
        "record_id", "url_key", "ts", "outcome", "validator", F.col("f.record_id").alias("refers_to"),
        F.when(ok, F.map_concat(kept, updates)).alias("headers"), F.when(ok, F.col("f.digest")).alias("digest"), F.when(ok, F.col("f.n_bytes")).alias("n_bytes"),
    )


def capture_log(pages: DataFrame) -> DataFrame:
    """Capture records made from pages(page_id, url, html), as the tables hold pages but no crawl log.

    Every page is a response (status 404 for every eleventh), every fifth is captured anew with another body a day
    later; every page is revisited two hours after, every third again after two days, under other spellings of its
    URL, with the body's entity tag, an outdated one, a date only, or nothing to check.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.select("page_id", "url", F.md5("html").alias("m"), F.sha2("html", 256).alias("d"), F.octet_length("html").cast("long").alias("n"), (F.lit(1_700_000_000) + F.col("page_id") * 600).alias("t"))
    i, day = F.col("page_id"), "Mon, 01 Jan 2024 00:00:"
    date = lambda k: F.concat(F.lit(day + f"{k:02d} GMT"))
    tag = lambda version: F.concat(F.lit('"'), F.substring("m", 1, 16), F.lit(f'-{version}"'))
    base = p.withColumn("bare", F.regexp_replace("url", "#.*$", ""))
    other = F.concat("bare", F.when(F.col("bare").contains("?"), "&").otherwise("?"), F.lit("utm_campaign=again#part"))

    def record(k: int, kind: str, status: Column, url: Column, after: int, headers: Column, when: Column, version: int = 1) -> Column:
        return F.when(
            when,
            F.struct((i * 4 + k).alias("record_id"), F.lit(kind).alias("kind"), status.cast("int").alias("status"), url.alias("url"), (F.col("t") + after).alias("ts"), F.map_filter(headers, lambda _, v: v.isNotNull()).alias("headers"),
                     F.when(F.lit(kind == "response"), F.concat("d", F.lit(f"-{version}"))).alias("digest"), F.when(F.lit(kind == "response"), F.col("n") + version).alias("n_bytes")),
        )

    def headers(**h: Column) -> Column:
        pairs = [x for k, v in h.items() for x in (F.lit(k.replace("_", "-")), v.cast("string"))]
        return F.create_map(*pairs)

    response = lambda v: headers(date=date(v), etag=tag(v), last_modified=date(v), content_type=F.lit("text/html"), content_length=F.col("n") + v, server=F.lit("a"))
    again = lambda v, k: headers(date=date(k), etag=F.when(i % 7 < 4, tag(v)).when(i % 7 == 4, F.concat(F.lit("W/"), tag(v))), last_modified=F.when(i % 7 == 5, date(v)), expires=date(k + 1), content_length=F.lit(0), server=F.lit("b"))
    rows = F.array_compact(
        F.array(
            record(0, "response", F.when(i % 11 == 0, 404).otherwise(200), F.col("url"), 0, response(1), F.lit(True)),
            record(1, "revisit", F.lit(304), other, 7_200, again(1, 11), F.lit(True)),
            record(2, "response", F.lit(200), F.col("url"), 86_400, response(2), i % 5 == 0, 2),
            record(3, "revisit", F.lit(304), F.concat(F.lit("HTTPS://www."), F.regexp_replace("bare", "^https?://(www[.])?", "")), 172_800, again(1, 21), i % 3 == 0),
        )
    )
    return base.select(F.explode(rows).alias("r")).select("r.*")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(capture_log(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    return out.select("record_id", "url_key", "ts", "outcome", "validator", "refers_to", lines.alias("headers"), "digest", "n_bytes")


_KEY = """regexp_replace(regexp_replace(lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?]*)', 1)), '^www[0-9]*[.]', ''), ':(80|443)$', '')
 || regexp_replace(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*([^?]*)', 1), '/+$', '')
 || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract({u}, '[?](.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|sid|sessionid)(=|$)'))), '&'), ''), '')"""

SQL = f"""
WITH p AS (SELECT page_id AS i, url, regexp_replace(url, '#.*$', '') AS bare, md5(coalesce(html, '')) AS m, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n, 1700000000 + page_id * 600 AS t FROM pages),
q AS (SELECT *, '"' || m[1:16] || '-1"' AS e1, '"' || m[1:16] || '-2"' AS e2, 'Mon, 01 Jan 2024 00:00:' AS dt FROM p),
res AS (
  SELECT i * 4 AS record_id, url, t AS ts, e1 AS etag, dt || '01 GMT' AS day, n + 1 AS size, d || '-1' AS digest FROM q WHERE i % 11 <> 0
  UNION ALL SELECT i * 4 + 2, url, t + 86400, e2, dt || '02 GMT', n + 2, d || '-2' FROM q WHERE i % 5 = 0),
rev AS (
  SELECT i * 4 + 1 AS record_id, bare || CASE WHEN contains(bare, '?') THEN '&' ELSE '?' END || 'utm_campaign=again#part' AS url, t + 7200 AS ts, i, e1, dt, '11 GMT' AS d1, '12 GMT' AS d2 FROM q
  UNION ALL SELECT i * 4 + 3, 'HTTPS://www.' || regexp_replace(bare, '^https?://(www[.])?', ''), t + 172800, i, e1, dt, '21 GMT', '22 GMT' FROM q WHERE i % 3 = 0),
resk AS (SELECT *, {_KEY.format(u="regexp_replace(trim(url), '#.*$', '')")} AS k FROM res),
revk AS (SELECT *, {_KEY.format(u="regexp_replace(trim(url), '#.*$', '')")} AS k,
  CASE WHEN i % 7 < 4 THEN e1 WHEN i % 7 = 4 THEN 'W/' || e1 END AS etag, CASE WHEN i % 7 = 5 THEN dt || '01 GMT' END AS lm FROM rev),
j AS (SELECT v.*, s.record_id AS refers_to, s.etag AS se, s.day AS sd, s.size, s.digest,
   row_number() OVER (PARTITION BY v.record_id ORDER BY s.ts DESC, s.record_id DESC) AS rn
  FROM revk v LEFT JOIN resk s ON v.k = s.k AND s.ts < v.ts),
o AS (SELECT *, CASE WHEN refers_to IS NULL THEN NULL WHEN etag IS NOT NULL THEN 'etag' WHEN lm IS NOT NULL THEN 'last-modified' ELSE 'unchecked' END AS validator FROM j WHERE rn = 1),
x AS (SELECT *, CASE WHEN refers_to IS NULL THEN 'unmatched' WHEN validator = 'etag' AND replace(etag, 'W/', '') <> se THEN 'mismatch'
   WHEN validator = 'last-modified' AND lm <> sd THEN 'mismatch' ELSE 'resolved' END AS outcome FROM o)
SELECT record_id, k AS url_key, ts, outcome, validator, refers_to,
  CASE WHEN outcome = 'resolved' THEN 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || dt || d1 || chr(10) || 'etag: ' || coalesce(etag, se) || chr(10)
    || 'expires: ' || dt || d2 || chr(10) || 'last-modified: ' || coalesce(lm, sd) || chr(10) || 'server: a' END AS headers,
  CASE WHEN outcome = 'resolved' THEN digest END AS digest, CASE WHEN outcome = 'resolved' THEN size END AS n_bytes
FROM x
""".replace("{u}", "url")
