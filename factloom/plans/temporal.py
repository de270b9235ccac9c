"""Folds, history and business time over the tables' facts and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.model import registry
from factloom.operators import fold, ingest
from factloom.plans import world
from factloom.plans.business import money
from factloom.plans.registry import query
from factloom.session import written
from factloom.store import FactLog

# The event feed walked one event at a time per (user, type): the state before and after each.
WALK = """
WITH RECURSIVE feed AS (
  SELECT 80000000000 + user_id AS e, 'user/' || event_type AS a, CAST(floor(value) AS BIGINT) AS v, 1000000 + event_id AS tx,
         CAST(regexp_extract(props, '[0-9]+') AS INT) % 4 <> 0 AS op,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events),
walk AS (
  SELECT e, a, v, tx, op, n, CAST(NULL AS BIGINT) AS was, CASE WHEN op THEN v END AS now FROM feed WHERE n = 1
  UNION ALL
  SELECT f.e, f.a, f.v, f.tx, f.op, f.n, w.now, CASE WHEN f.op THEN f.v WHEN w.now = f.v THEN NULL ELSE w.now END
  FROM walk w JOIN feed f ON f.e = w.e AND f.a = w.a AND f.n = w.n + 1),
canon AS (
  SELECT e, a, now AS v, tx, true AS op FROM walk WHERE op AND now IS DISTINCT FROM was
  UNION ALL SELECT e, a, was, tx, false FROM walk WHERE was IS NOT NULL AND now IS DISTINCT FROM was)
"""
LAST = """, held AS (SELECT e, a, v, tx FROM canon c WHERE op AND tx <= {tx}
  AND NOT EXISTS (SELECT 1 FROM canon l WHERE l.e = c.e AND l.a = c.a AND l.v = c.v AND l.tx > c.tx AND l.tx <= {tx}))
"""
EVERY = 9_000_000_000
USER = [f"user/{t}" for t in world.EVENT_TYPES]


def named(df: DataFrame) -> DataFrame:
    """The numeric attribute column as its name."""
    name = None
    for i in USER:
        hit = F.col("a") == world.BY_IDENT[i].id
        name = F.when(hit, i) if name is None else name.when(hit, i)
    return df.withColumn("a", name)


def whole(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.col("v_decimal").cast("long"))


@query("canonicalise_one", WALK + "SELECT e, a, v, tx, op FROM canon")
def canonicalise_one(spark: SparkSession, sf: str) -> DataFrame:
    return whole(named(world.event_log(spark, sf))).select("e", "a", "v", "tx", "op")


@query("canonicalise_many", """
WITH feed AS (SELECT 80000000000 + user_id AS e, 'user/' || event_type AS a, CAST(floor(value) AS BIGINT) AS v,
                     1000000 + event_id AS tx, CAST(regexp_extract(props, '[0-9]+') AS INT) % 4 <> 0 AS op FROM events)
SELECT e, a, v, tx, op FROM feed f WHERE op IS DISTINCT FROM coalesce(
  (SELECT arg_max(p.op, p.tx) FROM feed p WHERE p.e = f.e AND p.a = f.a AND p.v = f.v AND p.tx < f.tx), false)""")
def canonicalise_many(spark: SparkSession, sf: str) -> DataFrame:
    return whole(named(ingest.canonical_many(world.raw_feed(spark, sf)))).select("e", "a", "v", "tx", "op")


@query("current_fold", WALK + LAST.format(tx=EVERY) + "SELECT e, a, v, tx FROM held")
def current_fold(spark: SparkSession, sf: str) -> DataFrame:
    return whole(named(fold.state(world.event_log(spark, sf)))).select("e", "a", "v", "tx")


@query("asof_fold", WALK + """, mark AS (SELECT max(1000000 + event_id) AS m FROM events WHERE ts <= TIMESTAMP '2024-01-15'),
held AS (SELECT e, a, v, tx FROM canon c, mark WHERE op AND tx <= m AND NOT EXISTS
  (SELECT 1 FROM canon l, mark WHERE l.e = c.e AND l.a = c.a AND l.v = c.v AND l.tx > c.tx AND l.tx <= m))
SELECT e, a, v, tx FROM held""")
def asof_fold(spark: SparkSession, sf: str) -> DataFrame:
    mark = event_store(spark, sf).resolve("2024-01-15T00:00:00+00:00")
    return whole(named(fold.state(world.event_log(spark, sf), mark))).select("e", "a", "v", "tx")


def event_store(spark: SparkSession, sf: str):
    """The event log with one transaction per event."""
    tx = world.table(spark, sf, "events").select((F.lit(world.EVENT_TX) + F.col("event_id")).alias("id"),
                                                 world.entity("user", "user_id").alias("actor"),
                                                 F.col("ts").cast("timestamp").alias("at"))

    def read(attributes):
        return world.event_log(spark, sf, None if attributes is None else [a.ident for a in attributes])
    return FactLog(read, registry(spark, world.ATTRIBUTES), tx, known=world.ATTRIBUTES)


@query("history", WALK + """SELECT e, v, tx, CASE WHEN op THEN 'assert' ELSE 'retract' END AS op FROM canon WHERE a = 'user/purchase'""")
def history(spark: SparkSession, sf: str) -> DataFrame:
    return event_store(spark, sf).history("user/purchase").select("e", F.col("v").cast("long").alias("v"), "tx", "op")


@query("facts_text", """
SELECT 10000000000 + c_custkey AS e, 'customer/segment' AS a, c_mktsegment AS v, 100000 AS tx FROM customer
UNION ALL SELECT 10000000000 + c_custkey, 'customer/nation', CAST(50000000000 + c_nationkey AS VARCHAR), 100000 FROM customer
UNION ALL SELECT 20000000000 + o_orderkey, 'order/placed_on', strftime(o_orderdate, '%Y-%m-%d'),
  100000 + date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) FROM orders
UNION ALL SELECT 30000000000 + p_partkey, 'part/size', CAST(p_size AS VARCHAR), 100000 FROM part""")
def facts_text(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    log = store.log(["customer/segment", "customer/nation", "order/placed_on", "part/size"])
    return fold.facts_text(fold.state(log), store.attrs)


@query("timeline", WALK + """
SELECT e, tx, lag(v) OVER (PARTITION BY e ORDER BY tx) AS was, v FROM canon WHERE a = 'user/view' AND op""")
def timeline(spark: SparkSession, sf: str) -> DataFrame:
    rows = fold.timeline(event_store(spark, sf).history("user/view"))
    return rows.select("e", "tx", F.col("was").cast("long").alias("was"), F.col("v").cast("long").alias("v"))


@query("first_value", WALK + "SELECT e, min(tx) AS tx, arg_min(v, tx) AS v FROM canon WHERE op AND a = 'user/click' GROUP BY e")
def first_value(spark: SparkSession, sf: str) -> DataFrame:
    return fold.first_value(event_store(spark, sf).history("user/click")).withColumn("v", F.col("v").cast("long"))


@query("slipped", WALK + LAST.format(tx=EVERY) + """
SELECT h.e, f.v AS first, h.v FROM held h JOIN (SELECT e, arg_min(v, tx) AS v FROM canon WHERE op AND a = 'user/purchase' GROUP BY e) f
ON f.e = h.e WHERE h.a = 'user/purchase' AND h.v > f.v""")
def slipped(spark: SparkSession, sf: str) -> DataFrame:
    log = written(event_store(spark, sf).log(["user/purchase"]))
    store = FactLog.of(log, registry(spark, world.ATTRIBUTES), world.transactions(spark, sf))
    rows = fold.slipped(store.attr("user/purchase"), store.history("user/purchase"))
    return rows.select("e", F.col("first").cast("long").alias("first"), F.col("v").cast("long").alias("v"))


@query("attribute_relation", """
SELECT 20000000000 + o_orderkey AS e, o_orderstatus AS v, 100000 + date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS tx FROM orders""")
def attribute_relation(spark: SparkSession, sf: str) -> DataFrame:
    return world.store(spark, sf).attr("order/status")


@query("identity_index", """
SELECT a, key, e FROM (SELECT 'customer/name' AS a, c_name AS key, 10000000000 + c_custkey AS e FROM customer
 UNION ALL SELECT 'nation/name', n_name, 50000000000 + n_nationkey FROM nation UNION ALL SELECT 'region/name', r_name, 60000000000 + r_regionkey FROM region
 UNION ALL SELECT 'supplier/name', s_name, 40000000000 + s_suppkey FROM supplier
 UNION ALL SELECT 'order/number', 'O-' || o_orderkey, 20000000000 + o_orderkey FROM orders)""")
def identity_index(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    ids = ["customer/name", "nation/name", "region/name", "supplier/name", "order/number"]
    index = ingest.identity_index(fold.state(store.log(ids)), store.attrs)
    return index.join(store.attrs.select(F.col("id").alias("a"), "ident"), "a").select(F.col("ident").alias("a"), "key", "e")


@query("since", """
WITH mark AS (SELECT 102000 AS m), ord AS (SELECT 100000 + date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS tx FROM orders),
line AS (SELECT 100000 + date_diff('day', DATE '1995-01-01', min(CAST(l_shipdate AS DATE))) AS tx FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT CAST((SELECT count(*) * 5 FROM ord, mark WHERE tx > m) + (SELECT count(*) * 6 FROM line, mark WHERE tx > m) AS BIGINT) AS facts,
  CAST((SELECT count(*) FROM ord, mark WHERE tx > m) + (SELECT count(*) FROM line, mark WHERE tx > m) AS BIGINT) AS entities,
  CAST(0 AS BIGINT) AS attributes,
  (SELECT count(DISTINCT tx) FROM (SELECT * FROM ord UNION ALL SELECT * FROM line), mark WHERE tx > m) AS transactions""")
def since(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    return fold.since(store.log(), store.tx, store.attrs, 102000)


@query("store_size", """
WITH line AS (SELECT min(CAST(l_shipdate AS DATE)) AS d FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT CAST(3*(SELECT count(*) FROM customer) + 2*(SELECT count(*) FROM nation) + (SELECT count(*) FROM region)
   + 2*(SELECT count(*) FROM supplier) + 4*(SELECT count(*) FROM part) + 5*(SELECT count(*) FROM orders) + 6*(SELECT count(*) FROM line) AS BIGINT) AS facts,
  CAST((SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + (SELECT count(*) FROM supplier)
   + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM line) AS BIGINT) AS entities,
  (SELECT count(*) FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders UNION SELECT d FROM line UNION SELECT DATE '1995-01-01')) AS transactions""")
def store_size(spark: SparkSession, sf: str) -> DataFrame:
    store = world.store(spark, sf)
    return fold.size_profile(store.log(), store.tx, store.attrs)


@query("stable_past", WALK + """SELECT CAST(NULL AS BIGINT) AS e, CAST(NULL AS BIGINT) AS v, CAST(NULL AS BIGINT) AS tx, 'left' AS side WHERE false""")
def stable_past(spark: SparkSession, sf: str) -> DataFrame:
    """State at a past transaction, read from the log cut there and from the whole log: no difference."""
    log = world.event_log(spark, sf)
    mark = event_store(spark, sf).resolve("2024-01-15T00:00:00+00:00")
    then = fold.state(log.where(F.col("tx") <= mark)).select("e", F.col("v_decimal").cast("long").alias("v"), "tx")
    later = fold.state(log, mark).select("e", F.col("v_decimal").cast("long").alias("v"), "tx")
    return fold.same_state(then, later)


@query("marks", """
SELECT strftime(mark, '%Y-%m-%d') AS mark, (SELECT max(1000000 + event_id) FROM events WHERE ts < mark) AS tx
FROM (SELECT DISTINCT date_trunc('day', ts) AS mark FROM events)""")
def marks(spark: SparkSession, sf: str) -> DataFrame:
    """The last event before each day on which there are any."""
    store = event_store(spark, sf)
    days = store.tx.select(F.date_trunc("day", "at").alias("mark")).distinct()
    return fold.last_before(store.tx, days).select(F.date_format("mark", "yyyy-MM-dd").alias("mark"), "tx")


def quotes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prices as orders quote them: facts of each part's price, one transaction per order, whose
    evidence is the order, issued on its date."""
    per = world.table(spark, sf, "lineitem").groupBy("l_partkey", "l_orderkey").agg(
        F.max(F.col("l_extendedprice").cast(world.MONEY)).alias("v"))
    tx = F.lit(10_000_000) + F.col("l_orderkey")
    hist = per.select(world.entity("part", "l_partkey").alias("e"), "v", tx.alias("tx"), F.lit("assert").alias("op"))
    orders = world.table(spark, sf, "orders")
    evidence = orders.select((F.lit(10_000_000) + F.col("o_orderkey")).alias("tx"), world.entity("order", "o_orderkey").alias("document"))
    issued = orders.select(world.entity("order", "o_orderkey").alias("document"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return hist, evidence, issued


@query("known_by_date", """
WITH q AS (SELECT l_partkey, l_orderkey, max(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY 1, 2),
r AS (SELECT 30000000000 + l_partkey AS e, v, o_orderdate AS issued,
        row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n
      FROM q JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate < TIMESTAMP '1998-01-01')
SELECT e, CAST(v AS DOUBLE) AS v, strftime(issued, '%Y-%m-%d') AS issued FROM r WHERE n = 1""")
def known_by_date(spark: SparkSession, sf: str) -> DataFrame:
    hist, evidence, issued = quotes(spark, sf)
    known = fold.known_by(hist, evidence, issued, F.lit("1998-01-01").cast("timestamp"))
    return known.select("e", money(F.col("v")).alias("v"), F.date_format("issued", "yyyy-MM-dd").alias("issued"))


@query("table_to_facts", """
SELECT 'customer' AS kind, count(*) * 3 AS facts, CAST(sum(c_nationkey) AS BIGINT) AS refs FROM customer
UNION ALL SELECT 'order', count(*) * 5, CAST(sum(o_custkey) AS BIGINT) FROM orders
UNION ALL SELECT 'nation', count(*) * 2, CAST(sum(n_regionkey) AS BIGINT) FROM nation""")
def table_to_facts(spark: SparkSession, sf: str) -> DataFrame:
    log = world.facts(spark, sf, [a.ident for a in world.ATTRIBUTES if a.ident.split("/")[0] in ("customer", "order", "nation")])
    kind = (F.col("e") / world.WIDTH).cast("int")
    label = F.when(kind == 1, "customer").when(kind == 2, "order").otherwise("nation")
    return log.groupBy(label.alias("kind")).agg(F.count("*").alias("facts"), F.sum(F.col("v_ref") % world.WIDTH).alias("refs"))


@query("canonical_key", """
SELECT o_orderkey, regexp_replace(regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '0+$', ''), '\\.$', '') AS price,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS at, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def canonical_key(spark: SparkSession, sf: str) -> DataFrame:
    return world.table(spark, sf, "orders").select(
        "o_orderkey", V.canonical_key("decimal", F.col("o_totalprice").cast(world.MONEY)).alias("price"),
        V.canonical_key("instant", F.col("o_orderdate").cast("timestamp")).alias("at"),
        V.canonical_key("date", F.col("o_orderdate").cast("date")).alias("day"))


@query("coerce", """
SELECT event_id, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS number, strftime(ts, '%Y-%m-%d') AS day,
  CASE WHEN event_type = 'view' THEN CAST(epoch_us(ts) AS BIGINT) END AS instant,
  CASE WHEN CAST(regexp_extract(props, '[0-9]+') AS INT) >= 1 THEN CAST(regexp_extract(props, '[0-9]+') AS BIGINT) ELSE 0 END AS ref,
  CASE event_type WHEN 'click' THEN true WHEN 'error' THEN false END AS flag FROM events""")
def coerce(spark: SparkSession, sf: str) -> DataFrame:
    """Event columns written as text and read back by type; an instant without an offset is refused."""
    raw = world.table(spark, sf, "events").select(
        "event_id", F.col("value").cast(world.MONEY).cast("string").alias("number"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("event_type") == "view", "Z").otherwise("")).alias("instant"),
        F.get_json_object("props", "$.k").alias("ref"),
        F.when(F.col("event_type") == "click", "true").when(F.col("event_type") == "error", "false").otherwise("yes").alias("flag"))
    return raw.select("event_id", money(V.coerce("decimal", F.col("number"))).alias("number"),
                      V.coerce("date", F.col("day")).cast("string").alias("day"),
                      F.unix_micros(V.coerce("instant", F.col("instant"))).alias("instant"),
                      V.coerce("ref", F.col("ref")).alias("ref"), V.coerce("boolean", F.col("flag")).alias("flag"))




@query("keyed_fold", WALK + LAST.format(tx=EVERY) + "SELECT e, a, v, tx FROM held")
def keyed_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming job's aggregate, run over the whole event log at once."""
    from factloom.streaming import jobs

    last = jobs.latest(world.event_log(spark, sf)).where(F.col("k") % 2 == 1).withColumn("tx", F.shiftright("k", 1))
    return whole(named(last)).select("e", "a", "v", "tx")


@query("incremental_state", WALK + LAST.format(tx=EVERY) + "SELECT e, a, v, tx FROM held")
def incremental_state(spark: SparkSession, sf: str) -> DataFrame:
    """State kept by the streaming job while the event log arrives in two committed batches."""
    import uuid

    from factloom.session import ensure_checkpoint_dir
    from factloom.sources import log
    from factloom.streaming import jobs

    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = world.event_log(spark, sf)
    middle = event_store(spark, sf).resolve("2024-01-15T00:00:00+00:00")
    for number, part in enumerate([events.where(F.col("tx") <= middle), events.where(F.col("tx") > middle)]):
        log.append_facts(part, f"{base}/store", number)
        jobs.keep_state(jobs.changes(spark, f"{base}/store"), f"{base}/kept", f"{base}/progress").awaitTermination()
    return whole(named(jobs.current(spark, f"{base}/kept"))).select("e", "a", "v", "tx")


def _followed(spark: SparkSession, sf: str):
    """A store into which the event log comes in three batches, one that broke off between them, and a function that brings kept tables up to it."""
    import uuid

    from factloom.session import ensure_checkpoint_dir
    from factloom.sources import log
    from factloom.streaming import jobs

    base = f"{ensure_checkpoint_dir(spark)}/feed-{uuid.uuid4().hex}"
    events = world.event_log(spark, sf)
    days = ("2024-01-08T00:00:00+00:00", "2024-01-15T00:00:00+00:00")
    first, second = (event_store(spark, sf).resolve(d) for d in days)

    def follow(keep, name: str) -> str:
        keep(jobs.changes(spark, f"{base}/store"), f"{base}/{name}", f"{base}/{name}-progress").awaitTermination()
        return f"{base}/{name}"

    def batches():
        yield lambda: log.append_facts(events.where(F.col("tx") <= first), f"{base}/store", 1)
        yield lambda: events.withColumn("tx", F.col("tx") + 50_000_000).write.partitionBy("a").parquet(f"{base}/store/fact/part=broken/batch=9")
        yield lambda: log.append_facts(events.where((F.col("tx") > first) & (F.col("tx") <= second)), f"{base}/store", 2)
        yield lambda: log.compact(spark, f"{base}/store")
        yield lambda: log.append_facts(events.where(F.col("tx") > second), f"{base}/store", 3)
    return f"{base}/store", batches, follow


@query("change_feed", WALK + LAST.format(tx=EVERY) + "SELECT e, a, v, tx FROM held")
def change_feed(spark: SparkSession, sf: str) -> DataFrame:
    """State kept from the change feed, which sees each committed batch once: neither a job that broke off nor what a compaction wrote anew."""
    from factloom.streaming import jobs

    _, batches, follow = _followed(spark, sf)
    for n, step in enumerate(batches()):
        step()
        if n % 2 == 0:
            target = follow(jobs.keep_state, "kept")
    words = spark.read.parquet(f"{target}/delta")
    # a batch fed twice or a broken one would be here, though the fold might hide it
    twice = words.groupBy("e", "a", "v_decimal", "k").count().where("count > 1").select(F.lit(-1).cast("long").alias("e"), F.lit("fed twice").alias("a"), F.lit(0).cast("int").alias("v"), F.lit(-1).cast("long").alias("tx"))
    held = whole(named(jobs.current(spark, target))).select("e", "a", "v", "tx")
    return held.unionByName(twice.select(*(F.col(c).cast(held.schema[c].dataType).alias(c) for c in held.columns)))


@query("kept_signatures", WALK + LAST.format(tx=EVERY) + """, s AS (SELECT e, string_agg(DISTINCT a, ',' ORDER BY a) AS signature FROM held WHERE e % 10 <> 3 GROUP BY e)
SELECT moment, signature, count(*) AS entities FROM (SELECT 'excised' AS moment, signature FROM s UNION ALL SELECT 'fed', signature FROM s) GROUP BY 1, 2""")
def kept_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Which sets of attributes users carry, kept batch by batch, after every user with last digit 3 was excised: at once, and when the feed has brought it."""
    from datetime import datetime

    from factloom.session import cut
    from factloom.sources import log
    from factloom.streaming import jobs

    store, batches, follow = _followed(spark, sf)
    for n, step in enumerate(batches()):
        step()
        if n % 2 == 0:
            target = follow(jobs.keep_signatures, "signatures")
    erased = log.scan(spark, store).where(F.col("e") % 10 == 3).select("e", F.lit(None).cast("long").alias("a")).distinct()
    log.excise(spark, store, erased, 95_000_000_000, datetime(2025, 1, 1), 100)
    names = F.create_map(*(x for t in world.EVENT_TYPES for x in (F.lit(world.BY_IDENT[f"user/{t}"].id).cast("long"), F.lit(f"user/{t}"))))

    def told(counts: DataFrame, moment: str) -> DataFrame:
        # the excisions are entities of the store too
        users = counts.where(~F.exists("sig", lambda a: a < 100))
        return users.select(F.lit(moment).alias("moment"), F.array_join(F.array_sort(F.transform("sig", lambda a: names[a])), ",").alias("signature"), "entities")
    at_once = cut(told(jobs.signature_counts(spark, target, store), "excised"))
    follow(jobs.keep_signatures, "signatures")
    return at_once.unionByName(told(jobs.signature_counts(spark, target), "fed"))
