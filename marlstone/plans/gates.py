"""Queries that decide: scopes, cohorts, stability, adequacy of sources, releases, capacity, coverage of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock, codes
from ..operators import labels, scans
from ..sources import readers, sinks
from . import tables
from .registry import query
from .storage import fresh

H, D = clock.HOUR, clock.DAY
_T0 = 1704067200 * 10**9

#: Days (UTC, from 2024-01-01) that scopes and cohorts of the queries begin with.
_SCOPE, _HOLDOUT, _FORWARD, _BAD = 5, 20, 26, (9, 11)


@query(
    f"""WITH {tables.TRADES}, d AS (SELECT event_id, market, (event_at_ns - {_T0}) // {D} AS day, value FROM trades),
c AS (SELECT *, CASE WHEN day >= {_FORWARD} THEN 'FORWARD_ONLY' WHEN day >= {_HOLDOUT} THEN 'LOCKED_HOLDOUT' ELSE 'DISCOVERY' END AS cohort, market IN ('error', 'login') AND day % 7 = 3 AS anomaly, day >= {_BAD[0]} AND day < {_BAD[1]} AS untrusted FROM d)
SELECT event_id, CASE WHEN day < 12 THEN 'EPOCH_1' ELSE 'EPOCH_2' END AS epoch, cohort, CASE WHEN cohort = 'LOCKED_HOLDOUT' THEN 'LOCKED_HOLDOUT_NOT_MATERIALIZED' WHEN cohort = 'FORWARD_ONLY' THEN 'FORWARD_ONLY_NOT_MATERIALIZED' WHEN anomaly OR untrusted THEN 'QUARANTINED_NOT_MATERIALIZED' ELSE 'CERTIFIED' END AS disposition,
 CASE WHEN day < {_SCOPE} THEN 'PRE_SCOPE_ABSTAIN' WHEN value > 10 THEN 'ELIGIBLE' ELSE 'FAILED' END AS scope, CASE WHEN untrusted THEN 'LIFECYCLE_QUARANTINED' WHEN anomaly THEN 'ANOMALY_QUARANTINED' ELSE '' END AS failure FROM c"""
)
def research_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-05 to C-10, C-16: epoch, cohort, quarantines by date range and by listed market and day, scope and disposition."""
    t = tables.trades(spark, sf_dir)
    day = clock.floor_div(F.col("event_at_ns") - _T0, D)
    listed = F.array(*(F.struct(F.lit(m).alias("market"), F.lit(d).cast("long").alias("day")) for m in ("error", "login") for d in range(3, 60, 7)))
    anomaly = F.array_contains(listed, F.struct("market", day.alias("day")))
    untrusted = (day >= _BAD[0]) & (day < _BAD[1])
    cohort = F.when(day >= _FORWARD, "FORWARD_ONLY").when(day >= _HOLDOUT, "LOCKED_HOLDOUT").otherwise("DISCOVERY")
    disposition = F.when(cohort != "DISCOVERY", F.concat(cohort, F.lit("_NOT_MATERIALIZED"))).when(anomaly | untrusted, "QUARANTINED_NOT_MATERIALIZED").otherwise("CERTIFIED")
    scope = F.when(day < _SCOPE, "PRE_SCOPE_ABSTAIN").when(F.col("value") > 10, "ELIGIBLE").otherwise("FAILED")
    failure = F.when(untrusted, "LIFECYCLE_QUARANTINED").when(anomaly, "ANOMALY_QUARANTINED").otherwise("")
    return t.select("event_id", F.when(day < 12, "EPOCH_1").otherwise("EPOCH_2").alias("epoch"), cohort.alias("cohort"), disposition.alias("disposition"), scope.alias("scope"), failure.alias("failure"))


@query("""SELECT event_id, event_type IN ('view', 'click', 'purchase') AND value IS NOT NULL AS executable FROM events WHERE ts < TIMESTAMP '2024-01-20'""")
def executable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-11, C-16: a tradable disposition and a price; rows of the holdout are cut off at the scan."""
    e = tables.table(spark, sf_dir, "events").where("ts < timestamp'2024-01-20'")
    return e.select("event_id", (F.col("event_type").isin("view", "click", "purchase") & F.col("value").isNotNull()).alias("executable"))


@query(
    """WITH e AS (SELECT p_type AS strategy, p_brand AS variant, avg(p_retailprice) - 925 AS effect FROM part GROUP BY 1, 2), b AS (SELECT p_type AS strategy, avg(p_retailprice) - 900 AS base FROM part GROUP BY 1),
r AS (SELECT strategy, count(*) AS variants, count(*) FILTER (effect > 0) AS positive, ceil(0.8 * count(*))::BIGINT AS required, median(effect) / any_value(base) AS retention, any_value(base) AS base FROM e JOIN b USING (strategy) GROUP BY 1)
SELECT strategy, variants, positive, required, round(retention, 6) AS retention, CASE WHEN base <= 0 THEN 'NO_BASE_EFFECT' WHEN positive >= required AND retention >= 0.5 THEN 'READY' ELSE 'INCONCLUSIVE' END AS state,
 concat_ws(',', CASE WHEN positive < required THEN 'INSUFFICIENT_POSITIVE_VARIANTS' END, CASE WHEN retention < 0.5 THEN 'MEDIAN_EFFECT_RETENTION' END) AS reasons FROM r"""
)
def variant_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-21: of a strategy's variants enough are positive, and their median keeps half of the base effect."""
    p = tables.table(spark, sf_dir, "part").withColumnsRenamed({"p_type": "strategy", "p_brand": "variant"})
    base = p.groupBy("strategy").agg((F.avg("p_retailprice") - 900).alias("base"))
    e = p.groupBy("strategy", "variant").agg((F.avg("p_retailprice") - 925).alias("effect")).join(base, "strategy")
    r = e.groupBy("strategy").agg(F.count("*").alias("variants"), F.count_if(F.col("effect") > 0).alias("positive"), F.median("effect").alias("middle"), F.max("base").alias("base"))
    r = r.withColumn("required", F.ceil(F.lit(0.8) * F.col("variants"))).withColumn("retention", F.col("middle") / F.col("base"))
    enough, kept = F.col("positive") >= F.col("required"), F.col("retention") >= 0.5
    state = F.when(F.col("base") <= 0, "NO_BASE_EFFECT").when(enough & kept, "READY").otherwise("INCONCLUSIVE")
    reasons = F.concat_ws(",", F.when(~enough, "INSUFFICIENT_POSITIVE_VARIANTS"), F.when(~kept, "MEDIAN_EFFECT_RETENTION"))
    return r.select("strategy", "variants", "positive", "required", F.round("retention", 6).alias("retention"), state.alias("state"), reasons.alias("reasons"))


@query(
    f"""WITH {tables.TRADES}, b AS (SELECT market, instrument_id % 7 AS instrument, event_at_ns, event_id FROM trades), s AS (SELECT *, CASE WHEN instrument = 6 THEN NULL WHEN instrument IN (2, 5) THEN 'size20' ELSE 'size10' END AS signature FROM b),
l AS (SELECT *, lag(instrument) OVER (PARTITION BY market ORDER BY event_at_ns, event_id) AS was FROM s), f AS (SELECT market, arg_min(signature, (event_at_ns, event_id)) FILTER (signature IS NOT NULL) AS baseline FROM s GROUP BY 1)
SELECT l.market, f.baseline, count(DISTINCT signature) AS signatures, count(DISTINCT instrument) FILTER (signature IS NOT NULL) AS contracts, count(*) FILTER (was <> instrument) AS roll_boundaries, count(DISTINCT instrument) FILTER (signature IS NULL) AS unresolved,
 coalesce(string_agg(DISTINCT signature, ',' ORDER BY signature) FILTER (signature <> f.baseline AND NOT (l.market = 'view' AND signature = 'size20')), '') AS unapproved FROM l JOIN f USING (market) GROUP BY 1, 2"""
)
def economics_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-24: a market's first economics are its baseline, others need an exception; contracts, roll boundaries and what is unresolved."""
    t = tables.trades(spark, sf_dir)
    rule = F.create_map(*(F.lit(x) for k, v in {0: "size10", 1: "size10", 2: "size20", 3: "size10", 4: "size10", 5: "size20"}.items() for x in (k, v)))
    order = F.struct("event_at_ns", "event_id")
    s = t.select("market", "event_at_ns", "event_id", (F.col("instrument_id") % 7).cast("int").alias("instrument")).withColumn("signature", F.try_element_at(rule, F.col("instrument")))
    was = F.lag("instrument").over(Window.partitionBy("market").orderBy("event_at_ns", "event_id"))
    known = F.col("signature").isNotNull()
    g = s.withColumn("was", was).groupBy("market").agg(
        F.min_by("signature", F.when(known, order)).alias("baseline"), F.sort_array(F.collect_set("signature")).alias("all"), F.count_distinct(F.when(known, F.col("instrument"))).alias("contracts"),
        F.count_if(F.col("was") != F.col("instrument")).alias("roll_boundaries"), F.count_distinct(F.when(~known, F.col("instrument"))).alias("unresolved"))
    others = F.filter("all", lambda x: (x != F.col("baseline")) & ~((F.col("market") == "view") & (x == "size20")))
    return g.select("market", "baseline", F.size("all").cast("long").alias("signatures"), "contracts", "roll_boundaries", "unresolved", F.array_join(others, ",").alias("unapproved"))


@query(
    f"""WITH {tables.TRADES}, h AS (SELECT DISTINCT market, (event_at_ns // {H} % 24)::BIGINT AS c FROM trades WHERE event_id % 50 = 0), k AS (SELECT market, c FROM h WHERE c IN (8, 12, 16)),
g AS (SELECT * FROM (VALUES ('8,12,16', 'PRIMARY', 0), ('12,16', 'FALLBACK_PAIR', 1), ('8,12', 'FALLBACK_PAIR', 1), ('12', 'FALLBACK_SINGLE', 2), ('8', 'FALLBACK_SINGLE', 2)) v(config, stage, o)),
m AS (SELECT config, stage, o, market FROM g CROSS JOIN (SELECT DISTINCT market FROM h) x WHERE (SELECT count(*) FROM k WHERE k.market = x.market AND list_contains(string_split(config, ','), c::VARCHAR)) = len(string_split(config, ','))),
n AS (SELECT config, stage, o, count(*) AS n, string_agg(market, ',' ORDER BY market) AS markets FROM m GROUP BY 1, 2, 3 HAVING count(*) >= 3)
SELECT coalesce(max(config), '') AS config, coalesce(max(stage), 'REJECTED') AS stage, coalesce(max(markets), '') AS markets FROM (SELECT * FROM n QUALIFY row_number() OVER (ORDER BY o, n DESC, config) = 1)"""
)
def config_set_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-10: the primary set of checkpoints if enough markets have all of them, else the best pair, else the best single one."""
    plan = (("8,12,16", "PRIMARY", 0), ("12,16", "FALLBACK_PAIR", 1), ("8,12", "FALLBACK_PAIR", 1), ("12", "FALLBACK_SINGLE", 2), ("8", "FALLBACK_SINGLE", 2))
    t = tables.trades(spark, sf_dir).where("event_id % 50 = 0").select("market", (clock.floor_div("event_at_ns", H) % 24).alias("c")).groupBy("market").agg(F.collect_set("c").alias("has"))
    ask = [F.struct(F.lit(c).alias("config"), F.lit(s).alias("stage"), F.lit(o).alias("o"), F.array(*(F.lit(int(x)).cast("long") for x in c.split(","))).alias("need")) for c, s, o in plan]
    m = t.withColumn("p", F.explode(F.array(*ask))).where(F.size(F.array_except("p.need", "has")) == 0)
    n = m.groupBy("p.config", "p.stage", "p.o").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("market")), ",").alias("markets")).where("n >= 3")
    best = n.agg(F.min_by(F.struct("config", "stage", "markets"), F.struct("o", -F.col("n"), "config")).alias("b"))
    return best.select(F.coalesce("b.config", F.lit("")).alias("config"), F.coalesce("b.stage", F.lit("REJECTED")).alias("stage"), F.coalesce("b.markets", F.lit("")).alias("markets"))


@query("""SELECT o_orderpriority AS volume, sum(o_totalprice)::BIGINT * 32 AS output_budget, 20000000 AS reserve, CASE WHEN 20000000 + sum(o_totalprice)::BIGINT * 32 <= 32 * (SELECT sum(o_totalprice) FROM orders)::BIGINT // 5 + 30000000 THEN 'PASS' ELSE 'FAIL' END AS status FROM orders GROUP BY 1""")
def capacity_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-12: compressed bytes times 32 and a reserve against what is free."""
    o = tables.table(spark, sf_dir, "orders")
    free = o.agg((clock.floor_div(F.round(F.sum("o_totalprice")).cast("long") * 32, 5) + 30_000_000).alias("free"))
    g = o.groupBy(F.col("o_orderpriority").alias("volume")).agg((F.round(F.sum("o_totalprice")).cast("long") * 32).alias("output_budget")).join(F.broadcast(free))  # one row
    return g.select("volume", "output_budget", F.lit(20_000_000).alias("reserve"), F.when(F.col("output_budget") + 20_000_000 <= F.col("free"), "PASS").otherwise("FAIL").alias("status"))


@query(
    """WITH c AS (SELECT user_id % 20 AS trial, event_type AS control, bool_and(event_id % 1511 <> 7) AS complete, avg(value) > 50 AS passed FROM events GROUP BY 1, 2)
SELECT trial, count(*) AS controls, CASE WHEN bool_or(NOT complete) THEN 'INVALID' WHEN bool_or(complete AND passed) THEN 'LEAKAGE_SUSPECTED' ELSE 'CLEAR' END AS state, coalesce(string_agg(control, ',' ORDER BY control) FILTER (complete AND passed), '') AS suspicious, coalesce(string_agg(control, ',' ORDER BY control) FILTER (NOT complete), '') AS incomplete FROM c GROUP BY 1"""
)
def negative_control_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-10: an incomplete control makes a trial invalid, one that passes the candidate's gate makes it suspicious."""
    e = tables.table(spark, sf_dir, "events")
    c = e.groupBy((F.col("user_id") % 20).alias("trial"), F.col("event_type").alias("control")).agg(F.bool_and(F.col("event_id") % 1511 != 7).alias("complete"), (F.avg("value") > 50).alias("passed"))
    names = lambda ok: F.array_join(F.sort_array(F.collect_list(F.when(ok, F.col("control")))), ",")
    bad = F.col("complete") & F.col("passed")
    state = F.when(F.bool_or(~F.col("complete")), "INVALID").when(F.bool_or(bad), "LEAKAGE_SUSPECTED").otherwise("CLEAR")
    return c.groupBy("trial").agg(F.count("*").alias("controls"), state.alias("state"), names(bad).alias("suspicious"), names(~F.col("complete")).alias("incomplete"))


_RELEASES = "SELECT o_custkey % 40 AS market, 2018 + o_orderkey % 5 AS year, CASE WHEN o_orderkey % 2 = 0 THEN 'feature' ELSE 'outcome' END AS kind, o_orderkey AS release, o_custkey % 40 + CASE WHEN o_orderkey % 101 = 0 THEN 1 ELSE 0 END AS source FROM orders"


@query(
    f"""WITH r AS ({_RELEASES} QUALIFY row_number() OVER (PARTITION BY market, year, kind ORDER BY release) <= 1 + (market % 9 = 0)::INT), g AS (SELECT market, year FROM (SELECT DISTINCT market FROM r), range(2018, 2023) y(year)),
c AS (SELECT market, year, count(*) FILTER (kind = 'feature') AS f, count(*) FILTER (kind = 'outcome') AS o, count(DISTINCT source) AS sources, max(release) FILTER (kind = 'feature') AS feature, max(release) FILTER (kind = 'outcome') AS outcome FROM r GROUP BY 1, 2)
SELECT g.market, g.year, CASE WHEN coalesce(f, 0) <> 1 OR coalesce(o, 0) <> 1 THEN 'NOT_ONE_PAIR' WHEN sources > 1 THEN 'SOURCE_DIFFERS' ELSE 'PAIRED' END AS state, CASE WHEN f = 1 AND o = 1 AND sources = 1 THEN feature ELSE -1 END AS feature, CASE WHEN f = 1 AND o = 1 AND sources = 1 THEN outcome ELSE -1 END AS outcome FROM g LEFT JOIN c USING (market, year)"""
)
def release_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-20: for every market and year exactly one feature and one outcome release, made from one source."""
    o, i = tables.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    r = o.select((F.col("o_custkey") % 40).alias("market"), (i % 5 + 2018).alias("year"), F.when(i % 2 == 0, "feature").otherwise("outcome").alias("kind"), i.alias("release"), (F.col("o_custkey") % 40 + F.when(i % 101 == 0, 1).otherwise(0)).alias("source"))
    n = F.row_number().over(Window.partitionBy("market", "year", "kind").orderBy("release"))
    r = r.withColumn("n", n).where(F.col("n") <= F.when(F.col("market") % 9 == 0, 2).otherwise(1))
    of = lambda k, f, c="release": f(F.when(F.col("kind") == k, F.col(c)))
    c = r.groupBy("market", "year").agg(of("feature", F.count).alias("f"), of("outcome", F.count).alias("o"), F.count_distinct("source").alias("sources"), of("feature", F.max).alias("feature"), of("outcome", F.max).alias("outcome"))
    grid = r.select("market").distinct().withColumn("year", F.explode(F.sequence(F.lit(2018).cast("long"), F.lit(2022).cast("long"))))
    one = (F.coalesce("f", F.lit(0)) == 1) & (F.coalesce("o", F.lit(0)) == 1)
    state = F.when(~one, "NOT_ONE_PAIR").when(F.col("sources") > 1, "SOURCE_DIFFERS").otherwise("PAIRED")
    return grid.join(c, ["market", "year"], "left").select("market", "year", state.alias("state"), *(F.when(state == "PAIRED", F.col(k)).otherwise(F.lit(-1).cast("long")).alias(k) for k in ("feature", "outcome")))


@query("""SELECT n_regionkey AS part, CASE n_regionkey WHEN 1 THEN 'SIZE_DIFFERS' WHEN 2 THEN 'HASH_DIFFERS' WHEN 3 THEN 'NO_SIDECAR' WHEN 4 THEN 'ROWS_DIFFER' ELSE 'VALID' END AS state, CASE WHEN n_regionkey = 3 THEN -1 ELSE count(*) END AS rows FROM nation GROUP BY 1""")
def file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-22: data files against their sidecars: size, hash, schema and, by reading them whole, rows."""
    path = fresh(spark, "pairs")
    n = tables.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("part"))
    n.repartition(1, "part").write.partitionBy("part").json(f"{path}/data")
    part = F.regexp_extract("path", r"part=(\d+)", 1).cast("int").alias("part")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(f"{path}/data").select(part, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    counts = n.groupBy("part").agg(F.count("*").alias("rows"))
    k = F.col("part")
    told = files.join(counts, "part").where("part <> 3").select(
        "part", (F.col("bytes") + F.when(k == 1, 1).otherwise(0)).alias("bytes"), F.when(k == 2, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"), F.lit("n_nationkey,n_name").alias("schema"), (F.col("rows") + F.when(k == 4, 1).otherwise(0)).alias("rows"))
    sinks.json_lines(told, f"{path}/sidecars")
    sidecars = readers.json_lines(spark, f"{path}/sidecars", "part int, bytes long, sha256 string, schema string, rows long").withColumnsRenamed({c: f"told_{c}" for c in ("bytes", "sha256", "schema", "rows")})
    read = spark.read.schema("n_nationkey int, n_name string, part int").json(f"{path}/data").groupBy("part").agg(F.count("*").alias("rows"))
    j = files.join(read, "part").join(sidecars, "part", "left")
    state = codes.first_reason((F.col("told_bytes").isNotNull(), "NO_SIDECAR"), (F.col("bytes") == F.col("told_bytes"), "SIZE_DIFFERS"), (F.col("sha256") == F.col("told_sha256"), "HASH_DIFFERS"), (F.col("told_schema") == "n_nationkey,n_name", "SCHEMA_DIFFERS"), (F.col("rows") == F.col("told_rows"), "ROWS_DIFFER"))
    return j.select("part", F.coalesce(state, F.lit("VALID")).alias("state"), F.when(F.col("told_bytes").isNull(), F.lit(-1).cast("long")).otherwise(F.col("rows")).alias("rows"))


@query(
    """WITH c AS (SELECT n_name AS symbol, n_regionkey AS tier FROM nation), p AS (SELECT DISTINCT n_name AS symbol, n_nationkey % 3 AS profile FROM nation WHERE n_nationkey <> 11 UNION ALL SELECT 'NOWHERE', 1 UNION ALL SELECT n_name, 2 FROM nation WHERE n_nationkey = 3)
SELECT coalesce(c.symbol, p.symbol) AS symbol, CASE WHEN c.symbol IS NULL THEN 'NOT_IN_UNIVERSE' WHEN count(p.symbol) = 0 THEN 'IN_NO_PROFILE' WHEN count(p.symbol) > 1 THEN 'IN_SEVERAL_PROFILES' ELSE 'BOUND' END AS state, max(c.tier) IS NOT NULL AS in_contract FROM c FULL JOIN p ON c.symbol = p.symbol GROUP BY c.symbol, p.symbol"""
)
def profile_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-25: profiles in JSON against the universe of another JSON contract, symbol by symbol."""
    path = fresh(spark, "profiles")
    n = tables.table(spark, sf_dir, "nation")
    sinks.json_lines(n.groupBy(F.col("n_regionkey").alias("tier_id")).agg(F.collect_list("n_name").alias("symbols")), f"{path}/universe")
    extra = spark.createDataFrame([("NOWHERE", 1)], "n_name string, profile int").union(n.where("n_nationkey = 3").select("n_name", F.lit(2)))
    own = n.where("n_nationkey <> 11").select("n_name", (F.col("n_nationkey") % 3).alias("profile")).union(extra)
    sinks.json_lines(own.groupBy("profile").agg(F.collect_set("n_name").alias("markets")), f"{path}/profiles")
    universe = readers.json_lines(spark, f"{path}/universe", "tier_id int, symbols array<string>").select(F.explode("symbols").alias("symbol"), "tier_id")
    profiles = readers.json_lines(spark, f"{path}/profiles", "profile int, markets array<string>").select(F.explode("markets").alias("symbol"), "profile")
    j = universe.join(profiles, "symbol", "full_outer").groupBy("symbol").agg(F.count("profile").alias("profiles"), F.max("tier_id").alias("tier"))
    state = F.when(F.col("tier").isNull(), "NOT_IN_UNIVERSE").when(F.col("profiles") == 0, "IN_NO_PROFILE").when(F.col("profiles") > 1, "IN_SEVERAL_PROFILES").otherwise("BOUND")
    return j.select("symbol", state.alias("state"), F.col("tier").isNotNull().alias("in_contract"))


@query("""SELECT n_nationkey, n_name, CASE WHEN n_regionkey < 2 THEN 1 ELSE 2 END AS run FROM nation""")
def checkpointed_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-11: a release in parts; a run that broke off is taken up again, and finished parts are not written twice."""
    path = fresh(spark, "checkpointed")
    n = tables.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    sinks.checkpointed(n.withColumn("run", F.lit(1)), path, "n_regionkey", only=[0, 1])  # broke off after two parts
    sinks.checkpointed(n.withColumn("run", F.lit(2)), path, "n_regionkey")
    return spark.read.parquet(f"{path}/n_regionkey=*").select("n_nationkey", "n_name", "run")


@query(
    """WITH r AS (SELECT n_regionkey AS fold, l_returnflag AS market, o_orderkey % 7 <> 3 AS has_features, o_orderkey % 5 < 3 AND NOT (l_returnflag = 'N' AND n_regionkey = 2) AS has_outcome, o_orderkey % 3 = 0 AND NOT (l_returnflag = 'R' AND n_regionkey = 1) AS test, o_orderkey AS id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_linenumber = 1),
c AS (SELECT fold, market, count(*) FILTER (NOT test AND has_features AND has_outcome) AS training, count(*) FILTER (NOT test AND has_features AND NOT has_outcome) AS exclusions, count(*) FILTER (test AND has_features) AS testing FROM r GROUP BY 1, 2)
SELECT fold, market, training, exclusions, testing, CASE WHEN testing = 0 THEN 'NO_TEST_PREDICTION_ROWS_NO_FIT' WHEN training = 0 THEN 'NO_TRAINING_OUTCOMES_EXPLICIT_PREDICTION_ABSTENTION' ELSE 'FITTED' END AS status, CASE WHEN testing > 0 AND training = 0 THEN testing ELSE 0 END AS abstained FROM c"""
)
def ridge_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-02, Q-03: the state of each market's model in each fold, and how many predictions abstain for want of one."""
    i, o, c, n = (tables.table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "nation"))
    r = i.where("l_linenumber = 1").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    k, fold, market = F.col("o_orderkey"), F.col("n_regionkey"), F.col("l_returnflag")
    x = r.select(
        fold.alias("fold"), market.alias("market"), (k % 7 != 3).alias("x"), ((k % 5 < 3) & ~((market == "N") & (fold == 2))).alias("y"), ((k % 3 == 0) & ~((market == "R") & (fold == 1))).alias("test"))
    g = x.groupBy("fold", "market").agg(F.count_if(F.expr("not test and x and y")).alias("training"), F.count_if(F.expr("not test and x and not y")).alias("exclusions"), F.count_if(F.expr("test and x")).alias("testing"))
    status = F.when(F.col("testing") == 0, "NO_TEST_PREDICTION_ROWS_NO_FIT").when(F.col("training") == 0, "NO_TRAINING_OUTCOMES_EXPLICIT_PREDICTION_ABSTENTION").otherwise("FITTED")
    none = F.lit(0).cast("long")
    return g.select("fold", "market", "training", "exclusions", "testing", status.alias("status"), F.when(status.startswith("NO_TRAINING"), F.col("testing")).otherwise(none).alias("abstained"))


@query(
    f"""WITH {tables.TRADES}, r AS (SELECT market, event_at_ns // {clock.MINUTE} AS m, arg_min(event_id, event_id) AS id, CASE WHEN min(event_id) % 4 = 1 THEN NULL ELSE (event_at_ns // {clock.MINUTE}) // 720 END AS session FROM trades GROUP BY market, event_at_ns // {clock.MINUTE}),
k AS (SELECT *, max(m) FILTER (session IS NOT NULL) OVER a AS pm, max(session) FILTER (session IS NOT NULL) OVER a AS ps, min(m) FILTER (session IS NOT NULL) OVER b AS nm, min(session) FILTER (session IS NOT NULL) OVER b AS ns, count(*) OVER a AS i FROM r
  WINDOW a AS (PARTITION BY market ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY market ORDER BY m ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c AS (SELECT k.*, count(*) OVER (PARTITION BY market, pm, nm) AS run FROM k WHERE session IS NULL)
SELECT market, m AS minute, CASE WHEN pm IS NULL OR nm IS NULL OR ps <> ns THEN 'UNRESOLVED' WHEN nm - pm - 1 = run THEN 'ATTACHED' ELSE 'NOT_CONTIGUOUS' END AS state, CASE WHEN ps = ns AND nm - pm - 1 = run THEN ps ELSE -1 END AS session FROM c"""
)
def sessionless_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-06: rows without a session get that of both neighbours, if these agree and minutes follow each other without a gap."""
    t = tables.trades(spark, sf_dir).withColumn("minute", clock.floor_div("event_at_ns", clock.MINUTE))
    r = t.groupBy("market", "minute").agg(F.min("event_id").alias("id")).withColumn("session", F.when(F.col("id") % 4 != 1, clock.floor_div("minute", 720)))
    known = F.when(F.col("session").isNotNull(), F.struct("minute", "session"))
    p = scans.latest(r.withColumn("back", -F.col("minute")), ["market"], ["minute"], known, "p")
    c = scans.latest(p, ["market"], ["back"], known, "n").where("session is null")  # the first after is the last, backwards
    run = F.count("*").over(Window.partitionBy("market", "p.minute", "n.minute"))
    state = F.when(F.col("p").isNull() | F.col("n").isNull() | (F.col("p.session") != F.col("n.session")), "UNRESOLVED").when(F.col("n.minute") - F.col("p.minute") - 1 == F.col("run"), "ATTACHED").otherwise("NOT_CONTIGUOUS")
    return c.withColumn("run", run).select("market", "minute", state.alias("state"), F.when(state == "ATTACHED", F.col("p.session")).otherwise(F.lit(-1).cast("long")).alias("session"))


@query(
    f"""WITH {tables.bars_sql()}, e AS (SELECT market, contract, event_at_ns, high_nano - low_nano + 10000000 AS atr FROM bars WHERE open_nano > 0), s AS (SELECT *, (3 * atr + 19999999) // 20000000 AS ticks FROM e),
p AS (SELECT s.*, scenario, (ticks + t) * 125 + 420 <= 1000000 AS ok FROM s CROSS JOIN (VALUES ('base', 2), ('stress', 4000), ('severe', 6000)) c(scenario, t))
SELECT market, contract, event_at_ns AS entry_at, count(*) FILTER (ok) AS eligible, bool_and(ok) AS passes_stress_wide, CASE WHEN bool_and(ok) THEN 'INHERITED' WHEN bool_or(ok) THEN 'ADDED_FOR_BASELINE' ELSE 'OMITTED' END AS state, coalesce(string_agg(scenario, ',' ORDER BY scenario) FILTER (ok), '') AS scenarios FROM p GROUP BY 1, 2, 3"""
)
def mandatory_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-14: what passes the risk gate in some scenario only is added for the baselines; the gate over all scenarios would leave it out."""
    b = tables.bars(spark, sf_dir).where("open_nano > 0")
    e = b.select("market", "contract", F.col("event_at_ns").alias("entry_at"), F.col("open_nano").alias("entry_open"), F.lit(1).alias("direction"), (F.col("high_nano") - F.col("low_nano") + 10_000_000).alias("atr"))
    e = e.withColumn("direction", F.explode(F.array(F.lit(1), F.lit(-1))))
    fills = labels.cost_fills(e, tables.bars(spark, sf_dir), ["market", "contract"], (("base", 2), ("stress", 4000), ("severe", 6000)), H, 10_000_000, 125, 210, 1_000_000, 6 * H, 14 * H, None, True)
    both = fills.groupBy("market", "contract", "entry_at", "scenario").agg(F.bool_and(F.col("reason") != "OVER_PLANNED_LOSS").alias("ok"))
    ok = F.col("ok")
    state = F.when(F.bool_and(ok), "INHERITED").when(F.bool_or(ok), "ADDED_FOR_BASELINE").otherwise("OMITTED")
    return both.groupBy("market", "contract", "entry_at").agg(F.count_if(ok).alias("eligible"), F.bool_and(ok).alias("passes_stress_wide"), state.alias("state"), F.array_join(F.sort_array(F.collect_list(F.when(ok, F.col("scenario")))), ",").alias("scenarios"))


@query(
    """WITH f AS (SELECT user_id % 30 AS strategy, event_id % 5 AS fold, sum(value) AS w, sum(value * (value - 98)) AS wx FROM events GROUP BY 1, 2), t AS (SELECT *, sum(w) OVER (PARTITION BY strategy) AS sw, sum(wx) OVER (PARTITION BY strategy) AS swx, count(*) OVER (PARTITION BY strategy) AS n FROM f)
SELECT strategy, max(n) AS folds, count(*) FILTER (wx > 0) AS positive, ceil(0.6 * max(n))::BIGINT AS required, round(min((swx - wx) / nullif(sw - w, 0)), 6) AS least_without_one, CASE WHEN count(*) FILTER (wx > 0) >= ceil(0.6 * max(n)) AND min((swx - wx) / nullif(sw - w, 0)) > 0 THEN 'READY' ELSE 'INCONCLUSIVE' END AS state FROM t GROUP BY 1"""
)
def temporal_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-20: enough folds are positive, and the weighted mean stays so whichever fold is left out."""
    e = tables.table(spark, sf_dir, "events")
    f = e.groupBy((F.col("user_id") % 30).alias("strategy"), (F.col("event_id") % 5).alias("fold")).agg(F.sum("value").alias("w"), F.sum(F.col("value") * (F.col("value") - 98)).alias("wx"))
    own = Window.partitionBy("strategy")
    t = f.withColumns({"rest": (F.sum("wx").over(own) - F.col("wx")) / F.nullif(F.sum("w").over(own) - F.col("w"), F.lit(0.0)), "n": F.count("*").over(own)})
    g = t.groupBy("strategy").agg(F.max("n").alias("folds"), F.count_if(F.col("wx") > 0).alias("positive"), F.ceil(F.lit(0.6) * F.max("n")).alias("required"), F.min("rest").alias("rest"))
    state = F.when((F.col("positive") >= F.col("required")) & (F.col("rest") > 0), "READY").otherwise("INCONCLUSIVE")
    return g.select("strategy", "folds", "positive", "required", F.round("rest", 6).alias("least_without_one"), state.alias("state"))

