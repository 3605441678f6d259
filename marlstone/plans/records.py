"""Queries on records: checked scans, sinks, identities, names, schedules, fills, ranks and cuts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import clock, codes, links
from ..operators import bars as bar_ops
from ..operators import asof, pointintime, scans, windows
from ..sources import readers, sinks
from . import causal, tables
from .registry import query
from .storage import fresh

H, D, M = clock.HOUR, clock.DAY, clock.MINUTE

#: The contract of a stored bar: names, types, order, and the schema's id on its first field.
BAR = StructType([StructField("market", StringType(), True, {"schema_id": "bar.v1"}), StructField("event_at_ns", LongType()), StructField("close_nano", LongType())])


@query(f"""WITH {tables.bars_sql()}, t AS (SELECT count(*) AS n, sum(close_nano)::BIGINT AS total FROM bars) SELECT variant, accepted, CASE WHEN accepted THEN n ELSE 0 END AS rows, CASE WHEN accepted THEN total ELSE 0 END AS total_nano
FROM (VALUES ('exact', true), ('renamed', false), ('other_type', false), ('other_order', false), ('other_id', false), ('no_id', false)) v(variant, accepted), t""")
def schema_exact_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-02: a file is read only if names, types, order and schema id are those of the contract; what is accepted is read whole, what isn't gives no row."""
    b = tables.bars(spark, sf_dir).select(F.col("market").alias("market", metadata={"schema_id": "bar.v1"}), "event_at_ns", "close_nano")
    plain = F.col("market").alias("market", metadata={})
    variants = {
        "exact": b, "renamed": b.withColumnRenamed("close_nano", "price_nano"), "other_type": b.select("market", "event_at_ns", F.col("close_nano").cast("double").alias("close_nano")), "other_order": b.select("market", "close_nano", "event_at_ns"),
        "other_id": b.select(F.col("market").alias("market", metadata={"schema_id": "bar.v2"}), "event_at_ns", "close_nano"), "no_id": b.select(plain, "event_at_ns", "close_nano")}
    out = []
    for name, df in variants.items():
        path = fresh(spark, name)
        df.write.parquet(path)
        try:
            found, accepted = readers.exact(spark, path, BAR, schema_id="bar.v1"), True
        except readers.SourceError:
            found, accepted = b.limit(0), False
        out.append(found.agg(F.count("*").alias("rows"), F.coalesce(F.sum("close_nano"), F.lit(0)).alias("total_nano")).select(F.lit(name).alias("variant"), F.lit(accepted).alias("accepted"), "rows", "total_nano"))
    return reduce(DataFrame.unionByName, out)


@query(
    f"""WITH {tables.bars_sql()}, r AS (SELECT market, contract, event_at_ns, CASE WHEN event_at_ns // {H} % 41 = 7 THEN -open_nano ELSE open_nano END AS o, CASE WHEN event_at_ns // {H} % 43 = 7 THEN low_nano - 1 ELSE high_nano END AS h, low_nano AS l, close_nano AS c, volume FROM bars)
SELECT market, event_at_ns // {D} AS day, count(*) AS rows, count(*) FILTER (o > 0 AND l > 0 AND c > 0 AND h >= greatest(o, c) AND l <= least(o, c) AND volume >= 0) AS valid, count(DISTINCT contract) AS required_keys FROM r GROUP BY 1, 2"""
)
def raw_bar_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-03, B-02: raw bars written and scanned by their own schema; prices validated, rows and the keys that need a definition counted."""
    k = clock.floor_div("event_at_ns", H)
    r = tables.bars(spark, sf_dir).withColumns({"open_nano": F.when(k % 41 == 7, -F.col("open_nano")).otherwise(F.col("open_nano")), "high_nano": F.when(k % 43 == 7, F.col("low_nano") - 1).otherwise(F.col("high_nano"))})
    path, columns = fresh(spark, "raw"), ["market", "contract", "event_at_ns", "open_nano", "high_nano", "low_nano", "close_nano", "volume"]
    sinks.parquet(r.select(*columns), path, (), ("event_at_ns",))
    found = readers.exact(spark, path, r.select(*columns).schema)
    return found.groupBy("market", clock.floor_div("event_at_ns", D).alias("day")).agg(F.count("*").alias("rows"), F.count_if(bar_ops.valid()).alias("valid"), F.count_distinct("contract").alias("required_keys"))


@query(
    f"""SELECT code, count(*) AS n, count(*) FILTER (day < 19737) AS first_epoch, count(*) FILTER (day >= 19737) AS second_epoch FROM ({{replay}}) JOIN (SELECT event_id, (epoch_us(ts) * 1000) // {D} AS day FROM events) USING (event_id) GROUP BY 1"""
    .replace("{replay}", causal.REPLAY)
)
def causal_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-04: bars with their definitions as causal bars, every row kept; dispositions and epochs counted from what was written."""
    log, bars = causal._log(spark, sf_dir)
    found = pointintime.definition_of(bars, log, ["instrument", "day"], "event_at_ns", "decided_ns", ["file", "ordinal"], ["multiplier"])
    path = fresh(spark, "causal")
    sinks.parquet(found.withColumn("epoch", F.when(F.col("day") < 19737, 1).otherwise(2)), path, ("epoch",), ("event_at_ns",))
    of = lambda e, name: F.count_if(F.col("epoch") == e).alias(name)
    return spark.read.parquet(path).groupBy("code").agg(F.count("*").alias("n"), of(1, "first_epoch"), of(2, "second_epoch"))


@query("""SELECT l_returnflag AS market, year(l_shipdate) AS year, count(*) AS rows, 1 AS files FROM lineitem GROUP BY 1, 2""")
def partitioned_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-15: predictions in exactly one file for each market and year."""
    path = fresh(spark, "predictions")
    i = tables.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("market"), F.year("l_shipdate").alias("year"), "l_orderkey", "l_linenumber")
    sinks.parquet(i.repartition("market", "year"), path, ("market", "year"), ("l_orderkey",))
    found = spark.read.parquet(path).withColumn("file", F.input_file_name())
    return found.groupBy("market", F.col("year").cast("long").alias("year")).agg(F.count("*").alias("rows"), F.count_distinct("file").cast("int").alias("files"))


@query(
    """WITH c AS (SELECT user_id AS instrument, min(epoch_us(ts)) OVER (PARTITION BY user_id, date_trunc('day', ts)) AS s, max(epoch_us(ts)) OVER (PARTITION BY user_id, date_trunc('day', ts)) + 3600000000 * (event_id % 30) AS e FROM events),
o AS (SELECT *, max(e) OVER (PARTITION BY instrument ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 60000000 THEN 1 ELSE 0 END) OVER (PARTITION BY instrument ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT instrument, min(s) AS s, max(e) AS e, count(*) AS parts FROM i GROUP BY instrument, k"""
)
def coverage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-17: recorded intervals and new ones, merged with all that they overlap or that are at most a minute away."""
    at = F.unix_micros("ts")
    own = Window.partitionBy("user_id", F.date_trunc("day", "ts"))
    c = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("instrument"), F.min(at).over(own).alias("s"), (F.max(at).over(own) + 3_600_000_000 * (F.col("event_id") % 30)).alias("e"), "event_id")
    recorded = bar_ops.islands(c.where("event_id % 2 = 0"), ["instrument"], "s", "e", 60_000_000)
    both = recorded.select("instrument", "s", "e", "parts").unionByName(c.where("event_id % 2 = 1").select("instrument", "s", "e", F.lit(1).cast("long").alias("parts")))
    w = Window.partitionBy("instrument").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = both.withColumn("new", (reach.isNull() | (F.col("s") > reach + 60_000_000)).cast("int")).withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("instrument", "k").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("parts").alias("parts")).drop("k")


@query(
    f"""WITH {tables.TRADES}, b AS (SELECT CASE WHEN instrument_id % 2 = 0 THEN instrument_id ELSE -instrument_id END AS instrument, event_at_ns, event_id FROM trades), n AS (SELECT max(event_at_ns) AS now FROM b),
k AS (SELECT instrument, event_at_ns, event_id FROM b, n WHERE event_at_ns >= now - CASE WHEN instrument < 0 THEN 8 ELSE 25 END * {D}), r AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY event_at_ns DESC, event_id DESC) AS i, count(*) OVER (PARTITION BY instrument) AS n FROM k)
SELECT instrument, count(*) AS kept, min(event_at_ns) AS covered_from_ns, max(n) > 4 AS clipped FROM r WHERE i <= 4 GROUP BY 1"""
)
def retention_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-18: eight days for negative instruments, longer for others, at most so many rows; coverage is claimed from the oldest row that is left."""
    b = tables.trades(spark, sf_dir).select(F.when(F.col("instrument_id") % 2 == 0, F.col("instrument_id")).otherwise(-F.col("instrument_id")).alias("instrument"), "event_at_ns", "event_id")
    now = b.agg(F.max("event_at_ns").alias("now"))
    k = b.join(F.broadcast(now)).where(F.col("event_at_ns") >= F.col("now") - F.when(F.col("instrument") < 0, 8).otherwise(25) * F.lit(D))  # now: one row
    own = Window.partitionBy("instrument")
    r = k.withColumns({"i": F.row_number().over(own.orderBy(F.desc("event_at_ns"), F.desc("event_id"))), "n": F.count("*").over(own)}).where("i <= 4")
    return r.groupBy("instrument").agg(F.count("*").alias("kept"), F.min("event_at_ns").alias("covered_from_ns"), (F.max("n") > 4).alias("clipped"))


@query("""SELECT n_nationkey::VARCHAR AS id, CASE WHEN n_regionkey = 2 THEN '' ELSE n_name END AS name, '{"keys":[' || n_nationkey || ',' || n_regionkey || '],"region":' || n_regionkey || '}' AS nested FROM nation""")
def nested_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-22: a CSV of a fixed list of fields; nested values as JSON in the order of their names, nulls as empty strings, other fields left out."""
    n = tables.table(spark, sf_dir, "nation")
    rows = n.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") != 2, F.col("n_name")).alias("name"), F.struct(F.array("n_nationkey", "n_regionkey").alias("keys"), F.col("n_regionkey").alias("region")).alias("nested"), F.lit("x").alias("ignored"))
    path = fresh(spark, "csv")
    sinks.csv(rows.select("id", "name", "nested"), path)
    found = spark.read.schema("id string, name string, nested string").options(header=True, escape="\\", mode="FAILFAST").csv(path)
    return found.select("id", F.coalesce("name", F.lit("")).alias("name"), "nested")


@query("""SELECT o_orderpriority AS run, count(*) AS n, round(sum(o_totalprice), 2)::VARCHAR AS total FROM orders GROUP BY 1""")
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-24: one row a run, appended to a CSV."""
    path = fresh(spark, "runs")
    o = tables.table(spark, sf_dir, "orders")
    runs = o.groupBy(F.col("o_orderpriority").alias("run")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).cast("decimal(20,2)").cast("string").alias("total"))
    for part in ("run < '3'", "run >= '3'"):
        runs.where(part).write.mode("append").option("header", True).csv(path)
    found = readers.csv(spark, path, "run string, n long, total string")
    return found.withColumn("total", F.regexp_replace("total", r"\.?0+$", "")).withColumn("total", F.when(F.col("total").contains("."), F.col("total")).otherwise(F.concat("total", F.lit(".0"))))


@query(
    """WITH i AS (SELECT c_custkey, '{"dataset":"D","expires":' || (c_custkey % 7) || ',"instrument":' || c_nationkey || ',"symbol":"' || c_mktsegment || '"}' AS body, '{"dataset":"D","instrument":' || c_nationkey || ',"symbol":"' || c_mktsegment || '"}' AS segment FROM customer)
SELECT c_custkey, sha256(body) AS identity_hash, sha256(segment) AS segment_hash FROM i"""
)
def identity_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-19, I-21: SHA-256 over canonical JSON; the segment's hash leaves dates out."""
    c = tables.table(spark, sf_dir, "customer").select("c_custkey", F.lit("D").alias("dataset"), (F.col("c_custkey") % 7).alias("expires"), F.col("c_nationkey").alias("instrument"), F.col("c_mktsegment").alias("symbol"))
    return c.select("c_custkey", F.sha2(codes.canonical_json("dataset", "expires", "instrument", "symbol"), 256).alias("identity_hash"), F.sha2(codes.canonical_json("dataset", "instrument", "symbol"), 256).alias("segment_hash"))


_LINKS = ("/a/list.xlsx", "https://pages.example/x/./notes.PDF#top", "../up/table.xls?v=2", "http://elsewhere.example/a.pdf", "mailto:a@b.c", "//pages.example/b/page.html", "rel/file.zip", "")


@query(
    f"""WITH l AS (SELECT page_id, unnest({list(_LINKS)}) AS href FROM pages), u AS (SELECT page_id, href, regexp_replace(CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN 'https://pages.example' || href WHEN href = '' OR regexp_matches(href, '^[a-z]+:') THEN '' ELSE 'https://pages.example/notices/' || page_id || '/' || href END, '[#?].*$', '') AS url FROM l),
n AS (SELECT page_id, href, regexp_replace(regexp_replace(url, '/[^/]+/\\.\\./', '/'), '/\\./', '/') AS url FROM u)
SELECT page_id, href, CASE WHEN regexp_matches(url, '^https://pages\\.example/') THEN url ELSE '' END AS url, CASE WHEN url = '' THEN 'NOT_A_PAGE' WHEN NOT regexp_matches(url, '^https://') THEN 'INSECURE' WHEN NOT regexp_matches(url, '^https://pages\\.example/') THEN 'FOREIGN' WHEN regexp_matches(lower(url), '\\.(xls|xlsx)$') THEN 'SPREADSHEET' WHEN regexp_matches(lower(url), '\\.pdf$') THEN 'PDF' WHEN regexp_matches(lower(url), '\\.zip$') THEN 'ARCHIVE' ELSE 'PAGE' END AS kind FROM n"""
)
def attachment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-25: hrefs of a notice resolved against it, without query and fragment; foreign and insecure ones refused, attachments by kind."""
    p = tables.table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(*(F.lit(x) for x in _LINKS))).alias("href"))
    h, base = F.col("href"), "https://pages.example"
    url = (
        F.when(h.rlike("^https?://"), h).when(h.startswith("//"), F.concat(F.lit("https:"), h)).when(h.startswith("/"), F.concat(F.lit(base), h)).when((h == "") | h.rlike("^[a-z]+:"), "")
        .otherwise(F.concat(F.lit(f"{base}/notices/"), F.col("page_id").cast("string"), F.lit("/"), h)))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "[#?].*$", ""), r"/[^/]+/\.\./", "/"), r"/\./", "/")
    u, own = F.col("url"), r"^https://pages\.example/"
    low = F.lower("url")
    kind = (
        F.when(u == "", "NOT_A_PAGE").when(~u.rlike("^https://"), "INSECURE").when(~u.rlike(own), "FOREIGN").when(low.rlike(r"\.(xls|xlsx)$"), "SPREADSHEET").when(low.rlike(r"\.pdf$"), "PDF").when(low.rlike(r"\.zip$"), "ARCHIVE").otherwise("PAGE"))
    return p.withColumn("url", url).select("page_id", "href", F.when(u.rlike(own), u).otherwise("").alias("url"), kind.alias("kind"))


@query(
    r"""WITH l AS (SELECT page_id, url AS page, regexp_replace(url, '[#?].*$', '') AS own, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS place FROM (SELECT page_id, url, list_transform(regexp_extract_all(coalesce(html, ''), '<a\s[^>]*?href="([^"]*)"', 1), lambda x: replace(x, '&amp;', '&')) AS h FROM pages)),
o AS (SELECT *, regexp_extract(own, '^(https?://[^/]+)', 1) AS origin, regexp_extract(own, '^(https?:)', 1) AS scheme, regexp_extract(regexp_replace(own, '^https?://[^/]+', ''), '^/(.*/)', 1) AS folder FROM l),
u AS (SELECT *, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN scheme || href WHEN starts_with(href, '/') THEN origin || href WHEN href = '' OR regexp_matches(href, '^[#?]') THEN own WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN '' ELSE origin || '/' || folder || href END AS raw FROM o),
n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(raw, '[#?].*$', ''), '/[^/]+/\.\./', '/', 'g'), '/(?:\./)+', '/', 'g') AS url FROM u)
SELECT page_id, place, href, url, CASE WHEN url = '' THEN 'NOT_A_PAGE' WHEN lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) <> lower(regexp_extract(page, '^https?://([^/?#]+)', 1)) THEN 'FOREIGN' WHEN NOT starts_with(url, 'https://') THEN 'INSECURE' WHEN regexp_matches(lower(url), '\.(?:xls|xlsx)$') THEN 'SPREADSHEET'
  WHEN regexp_matches(lower(url), '\.pdf$') THEN 'PDF' WHEN regexp_matches(lower(url), '\.zip$') THEN 'ARCHIVE' WHEN url = own THEN 'SELF' ELSE 'PAGE' END AS kind FROM n""".replace("\\\\", "\\")
)
def page_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-31: the links of every page, read from its html, resolved against its own address, and told apart by host and kind."""
    p = tables.table(spark, sf_dir, "pages")
    found = p.select("page_id", F.col("url").alias("page"), F.posexplode(links.hrefs("html")).alias("place", "href")).withColumn("url", links.resolved("href", "page"))
    return found.select("page_id", F.col("place").cast("long").alias("place"), "href", "url", links.kind("url", "page").alias("kind"))


@query("""WITH q AS (SELECT o_orderkey // 40 AS page, o_custkey AS url FROM orders), d AS (SELECT DISTINCT page, url FROM q), u AS (SELECT url, count(*) AS pages FROM d GROUP BY 1) SELECT count(*) AS unique_urls, count(*) FILTER (pages > 1) AS overlapping, sum(pages)::BIGINT AS listed, (SELECT count(*) FROM q) AS rows FROM u""")
def notice_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-09: notices of paged results, each once; those listed on several pages."""
    o = tables.table(spark, sf_dir, "orders")
    q = o.groupBy("o_custkey", clock.floor_div("o_orderkey", 40).alias("page")).agg(F.count("*").alias("rows"))
    u = q.groupBy("o_custkey").agg(F.count("*").alias("pages"), F.sum("rows").alias("rows"))
    return u.agg(F.count("*").alias("unique_urls"), F.count_if(F.col("pages") > 1).alias("overlapping"), F.sum("pages").alias("listed"), F.sum("rows").alias("rows"))


@query("""WITH p AS (SELECT o_custkey AS id, o_orderstatus AS part FROM orders GROUP BY 1, 2) SELECT a.part AS one, b.part AS other, count(*) AS shared, false AS disjoint FROM p a JOIN p b ON a.id = b.id AND a.part < b.part GROUP BY 1, 2""")
def partition_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-07: every two parts that share members, and how many; no row: all parts are disjoint."""
    p = tables.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_set("o_orderstatus")).alias("parts"))  # at most as many as there are parts
    pairs = F.flatten(F.transform("parts", lambda a: F.transform(F.filter("parts", lambda b: b > a), lambda b: F.struct(a.alias("one"), b.alias("other")))))
    return p.select(F.explode(pairs).alias("p")).groupBy("p.one", "p.other").agg(F.count("*").alias("shared"), F.lit(False).alias("disjoint"))


@query("""SELECT r_name AS product, n_name AS event, ('2024-01-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0')) AS trade_date, n_nationkey % 3 AS kind, n_regionkey = 4 AS early FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 7 <> 6""")
def schedule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-34, I-33: a service's nested JSON, products of dates of events, as one row for each event; events without a name go."""
    n, r = tables.table(spark, sf_dir, "nation"), tables.table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    event = F.struct(F.when(k % 7 != 6, F.col("n_name")).alias("name"), (k % 3).alias("kind"), (F.col("n_regionkey") == 4).alias("early"))
    dates = n.groupBy("n_regionkey", F.concat(F.lit("2024-01-"), F.lpad((k + 1).cast("string"), 2, "0")).alias("date")).agg(F.collect_list(event).alias("events"))
    products = dates.groupBy("n_regionkey").agg(F.collect_list(F.struct("date", "events")).alias("dates")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    path = fresh(spark, "schedule")
    products.select(F.to_json(F.struct(F.col("r_name").alias("product"), "dates")).alias("value")).write.text(path)
    schema = "product string, dates array<struct<date: string, events: array<struct<name: string, kind: int, early: boolean>>>>"
    found = spark.read.text(path).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("p")).select("p.product", F.explode("p.dates").alias("d")).select("product", F.col("d.date").alias("trade_date"), F.explode("d.events").alias("e"))
    return found.where("e.name is not null").select("product", F.col("e.name").alias("event"), "trade_date", "e.kind", "e.early")


@query(
    f"""WITH {tables.TRADES}, b AS (SELECT market, event_at_ns AS tm, event_at_ns + (60 + event_id % 20) * {clock.SECOND} AS available, instrument_id % 2 AS identity, price_nano AS o, event_id % 12 AS volume FROM trades UNION ALL SELECT market, event_at_ns, event_at_ns + {70 * clock.SECOND}, instrument_id % 2, price_nano, 3 FROM trades WHERE event_id % 25 = 0),
x AS (SELECT event_id, market, event_at_ns + {5 * clock.SECOND} AS ordered, instrument_id % 2 AS identity FROM trades WHERE event_id % 6 = 0), j AS (SELECT x.event_id, x.identity AS own, b.* FROM x JOIN b ON b.market = x.market AND b.tm > x.ordered AND b.tm <= x.ordered + {15 * M}),
f AS (SELECT event_id, min(tm) AS tm FROM j GROUP BY 1), g AS (SELECT f.event_id, count(*) AS n, bool_and(own = identity) AS same, bool_and(available >= j.tm + {65 * clock.SECOND}) AS late_enough, bool_and(volume > 0 AND o > 0) AS good, min(o) AS o FROM f JOIN j ON j.event_id = f.event_id AND j.tm = f.tm GROUP BY 1)
SELECT x.event_id, CASE WHEN n IS NULL THEN 'NO_BAR' WHEN n > 1 THEN 'AMBIGUOUS' WHEN NOT same THEN 'OTHER_IDENTITY' WHEN NOT late_enough THEN 'EARLY_AVAILABILITY' WHEN NOT good THEN 'INVALID_BAR' ELSE 'FILLED' END AS state, CASE WHEN n = 1 AND same AND late_enough AND good THEN o ELSE -1 END AS fill_nano FROM x LEFT JOIN g USING (event_id)"""
)
def first_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-04: the first bar after the order and within fifteen minutes; two of one time are ambiguous, and identity, availability, volume and price must hold."""
    t = tables.trades(spark, sf_dir)
    s, i = clock.SECOND, F.col("event_id")
    b = t.select("market", F.col("event_at_ns").alias("tm"), (F.col("event_at_ns") + (i % 20 + 60) * s).alias("available"), (F.col("instrument_id") % 2).alias("identity"), F.col("price_nano").alias("o"), (i % 12).alias("volume"))
    twins = t.where("event_id % 25 = 0").select("market", F.col("event_at_ns").alias("tm"), (F.col("event_at_ns") + 70 * s).alias("available"), (F.col("instrument_id") % 2).alias("identity"), F.col("price_nano").alias("o"), F.lit(3).cast("long").alias("volume"))
    x = t.where("event_id % 6 = 0").select("event_id", "market", (F.col("event_at_ns") + 5 * s).alias("ordered"), (F.col("instrument_id") % 2).alias("own"))
    late = F.bool_and(F.col("available") >= F.col("tm") + 65 * s)
    per_time = b.unionByName(twins).groupBy("market", "tm").agg(
        F.count("*").alias("n"), F.min("identity").alias("low"), F.max("identity").alias("high"), late.alias("late"), F.bool_and((F.col("volume") > 0) & (F.col("o") > 0)).alias("good"), F.min("o").alias("o"))
    found = asof.upcoming(x, per_time, ["market"], "ordered", "tm", ["n", "low", "high", "late", "good", "o"], True, 15 * M)
    same = (F.col("own") == F.col("low")) & (F.col("own") == F.col("high"))
    j = found.select("event_id", F.when(F.col("next_at") <= F.col("ordered") + 15 * M, F.struct("n", same.alias("same"), "late", "good", "o")).alias("f"))
    state = F.when(F.col("f").isNull(), "NO_BAR").when(F.col("f.n") > 1, "AMBIGUOUS").when(~F.col("f.same"), "OTHER_IDENTITY").when(~F.col("f.late"), "EARLY_AVAILABILITY").when(~F.col("f.good"), "INVALID_BAR").otherwise("FILLED")
    return j.select("event_id", state.alias("state"), F.when(state == "FILLED", F.col("f.o")).otherwise(F.lit(-1).cast("long")).alias("fill_nano"))


@query(f"""WITH {tables.TRADES} SELECT event_at_ns // {H} AS entry, arg_min(market, (-abs(price_nano - 50000000000), CASE market WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END, market, event_id)) AS market, count(*) AS candidates FROM trades GROUP BY 1""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-05: of each entry time the candidate of the strongest signal, ties in the order of markets."""
    t = tables.trades(spark, sf_dir)
    place = F.when(F.col("market") == "view", 0).when(F.col("market") == "click", 1).when(F.col("market") == "purchase", 2).otherwise(3)
    return t.groupBy(clock.floor_div("event_at_ns", H).alias("entry")).agg(F.min_by("market", F.struct(-F.abs(F.col("price_nano") - 50_000_000_000), place, "market", "event_id")).alias("market"), F.count("*").alias("candidates"))


@query("""WITH m AS (SELECT l_returnflag AS fold, l_suppkey % 4 AS candidate, l_linenumber AS inner_fold, avg(power(l_quantity - 25, 2)) AS mse FROM lineitem GROUP BY 1, 2, 3), a AS (SELECT fold, candidate, round(avg(mse), 6) AS mse, count(*) AS inner_folds FROM m GROUP BY 1, 2) SELECT fold, arg_min(candidate, (mse, candidate))::BIGINT AS chosen, min(mse) AS mse, min(inner_folds) AS inner_folds FROM a GROUP BY 1""")
def inner_fold_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-06: the candidate with the least mean error over inner folds, ties to the smaller id."""
    i = tables.table(spark, sf_dir, "lineitem")
    m = i.groupBy(F.col("l_returnflag").alias("fold"), (F.col("l_suppkey") % 4).alias("candidate"), "l_linenumber").agg(F.avg(F.pow(F.col("l_quantity") - 25, 2)).alias("mse"))
    a = m.groupBy("fold", "candidate").agg(F.round(F.avg("mse"), 6).alias("mse"), F.count("*").alias("inner_folds"))
    return a.groupBy("fold").agg(F.min_by("candidate", F.struct("mse", "candidate")).alias("chosen"), F.min("mse").alias("mse"), F.min("inner_folds").alias("inner_folds"))


@query(
    """WITH g AS (SELECT c_nationkey AS instrument, (c_custkey % 10) * 24 AS a, (c_custkey % 10) * 24 + 5 + c_custkey % 29 AS b FROM customer WHERE c_custkey % 3 = 0 GROUP BY ALL), c AS (SELECT instrument, greatest(a, b - 8 * (k + 1)) AS s, b - 8 * k AS e FROM g, range(0, 5) t(k) WHERE b - 8 * k > a)
SELECT s, e, count(DISTINCT instrument) AS instruments, string_agg(DISTINCT instrument::VARCHAR, ',' ORDER BY instrument::VARCHAR) AS ids, dense_rank() OVER (ORDER BY e DESC, s DESC) AS place FROM c GROUP BY 1, 2"""
)
def newest_first_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-08: gaps in chunks of at most eight hours, newest first; instruments with the same chunk are asked for together."""
    k = F.col("c_custkey")
    g = tables.table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("instrument"), ((k % 10) * 24).alias("a"), ((k % 10) * 24 + 5 + k % 29).alias("b")).distinct()
    c = g.withColumn("e", F.explode(F.sequence("b", F.col("a") + 1, F.lit(-8).cast("long")))).withColumn("s", F.greatest("a", F.col("e") - 8))
    found = c.groupBy("s", "e").agg(F.count_distinct("instrument").alias("instruments"), F.array_join(F.sort_array(F.collect_set(F.col("instrument").cast("string"))), ",").alias("ids"))
    return found.withColumn("place", F.dense_rank().over(Window.orderBy(F.desc("e"), F.desc("s"))).cast("long"))  # one row for each chunk of the plan


@query(
    f"""WITH {tables.bars_sql()}, r AS (SELECT *, CASE WHEN event_at_ns // {H} % 37 = 5 THEN event_at_ns ELSE available_at_ns END AS av, CASE WHEN event_at_ns // {H} % 53 = 5 THEN high_nano + close_nano ELSE close_nano END AS c, event_at_ns + CASE WHEN event_at_ns // {H} % 61 = 5 THEN -{5 * H} ELSE 0 END AS tm FROM bars),
l AS (SELECT *, lag((tm, contract)) OVER (PARTITION BY market ORDER BY event_at_ns, contract) AS was FROM r)
SELECT market, count(*) AS rows, count(*) FILTER (was IS NOT NULL AND was >= (tm, contract)) AS order_breaks, count(*) FILTER (av <= tm) AS acausal, count(*) FILTER (NOT (low_nano <= least(open_nano, c) AND high_nano >= greatest(open_nano, c) AND least(low_nano, open_nano, c) > 0)) AS invalid FROM l GROUP BY 1"""
)
def causal_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-13: events rise strictly, are available only after they happened, and prices stay within their bounds, over all rows."""
    b, k = tables.bars(spark, sf_dir), clock.floor_div("event_at_ns", H)
    r = b.withColumns({
        "av": F.when(k % 37 == 5, F.col("event_at_ns")).otherwise(F.col("available_at_ns")), "c": F.when(k % 53 == 5, F.col("high_nano") + F.col("close_nano")).otherwise(F.col("close_nano")), "tm": F.col("event_at_ns") - F.when(k % 61 == 5, 5 * H).otherwise(0)})
    now, was = F.struct("tm", "contract"), F.struct(F.col("was_tm").alias("tm"), F.col("was_contract").alias("contract"))
    r = scans.previous(r, ["market"], ["event_at_ns", "contract"], {"tm": "was_tm", "contract": "was_contract"}, 1_000 * H)
    ok = (F.col("low_nano") <= F.least("open_nano", "c")) & (F.col("high_nano") >= F.greatest("open_nano", "c")) & (F.least("low_nano", "open_nano", "c") > 0)
    return r.groupBy("market").agg(F.count("*").alias("rows"), F.count_if(F.col("was_tm").isNotNull() & (was >= now)).alias("order_breaks"), F.count_if(F.col("av") <= F.col("tm")).alias("acausal"), F.count_if(~ok).alias("invalid"))


@query(
    f"""WITH RECURSIVE {tables.TRADES}, b AS (SELECT market, row_number() OVER (PARTITION BY market ORDER BY event_id) AS i, price_nano / 1e9 AS c, price_nano / 1e9 + event_id % 7 AS h, price_nano / 1e9 - event_id % 5 AS l FROM trades),
t AS (SELECT market, i, greatest(h - l, abs(h - lag(c) OVER w), abs(l - lag(c) OVER w)) AS tr FROM b WINDOW w AS (PARTITION BY market ORDER BY i)), e AS (SELECT DISTINCT market, i FROM b WHERE i >= 61 AND i % 10 = 1),
s AS (SELECT e.market, e.i, e.i - 40 AS k, (SELECT avg(tr) FROM t WHERE t.market = e.market AND t.i BETWEEN e.i - 59 AND e.i - 40) AS atr FROM e UNION ALL SELECT s.market, s.i, s.k + 1, (19 * s.atr + t.tr) / 20 FROM s JOIN t ON t.market = s.market AND t.i = s.k + 1 WHERE s.k < s.i)
SELECT market, i AS bar, round(atr, 6) AS atr, atr > 0 AS usable FROM s WHERE k = i"""
)
def wilder_61(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-03: Wilder's recursion over exactly 61 bars: the mean of the first twenty true ranges, then forty steps; each window on its own."""
    p = F.col("price_nano") / 1e9
    b = tables.trades(spark, sf_dir).select("market", "event_id", p.alias("c"), (p + F.col("event_id") % 7).alias("h"), (p - F.col("event_id") % 5).alias("l"))
    b = scans.numbered(scans.previous(b, ["market"], ["event_id"], {"c": "was"}), ["market"], ["event_id"], "i")
    tr = F.when(F.col("was").isNotNull(), F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - F.col("was")), F.abs(F.col("l") - F.col("was"))))
    found = windows.wilder_windows(b.withColumn("tr", tr), ["market"], "i", "tr", 20, 40, 10)
    return found.select("market", F.col("bar").cast("long").alias("bar"), F.round("atr", 6).alias("atr"), (F.col("atr") > 0).alias("usable"))
