"""Queries over the ingest operators: payloads are built from the line items, and the SQL reads the flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caldrift.functions import expr as X
from caldrift.sources import ingest as I

from . import proxies as P
from .metric_queries import ORACLES, QUERIES, query
from .oracles import CTES

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
CTES["lines"] = """SELECT l_orderkey AS poll, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS qubit, l_linenumber AS n, l_returnflag AS gate, l_extendedprice AS value, l_discount AS err,
    epoch_us(l_shipdate) AS date, CASE WHEN l_orderkey % 38 = 0 THEN '1.0' WHEN l_orderkey % 19 = 0 THEN 'maybe' WHEN l_linestatus = 'O' THEN 'yes' WHEN l_quantity >= 10 THEN 'False' END AS op FROM lineitem"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(poll, properties): one payload for each order; every 13th lacks its gates, every 17th reports errors,
    every 19th has operational states that can't be read, and gates are no list in every 23rd."""
    x = P.table(spark, sf_dir, "lineitem")
    date = F.date_format("l_shipdate", ISO)
    text = F.when(F.col("l_orderkey") % 38 == 0, "1.0").when(F.col("l_orderkey") % 19 == 0, "maybe").when(F.col("l_linestatus") == "O", "yes").when(F.col("l_quantity") >= 10, "False")
    # the lines of an order are dealt and sorted as they are; the payload's objects are made of them after that
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k1"), F.col("l_suppkey").alias("k2"), F.col("l_extendedprice").alias("value"), F.col("l_discount").alias("err"), F.col("l_returnflag").alias("gate"), text.alias("op"), date.alias("date"))
    rows = x.groupBy(F.col("l_orderkey").alias("poll")).agg(F.array_sort(F.collect_list(line)).alias("r"))
    prop = lambda v, name, value, unit: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"), F.lit(unit).alias("unit"), v["date"].alias("date"))
    first = lambda v: prop(v, "T1", v["value"], "us")
    props = lambda v: F.when(v["op"].isNotNull(), F.array(first(v), prop(v, " Operational", v["op"], ""))).otherwise(F.array(first(v)))
    gate = lambda v: F.struct(v["gate"].alias("gate"), F.array((v["n"] + 1).cast("string"), v["n"].cast("string")).alias("qubits"), F.array(prop(v, "gate_error", v["err"], "")).alias("parameters"), v["op"].alias("operational"))
    gates = F.when(F.col("poll") % 13 != 0, F.transform("r", gate))
    errors = F.when(F.col("poll") % 17 == 0, F.array(F.lit("broken")))
    listed = F.transform("r", props).alias("qubits")
    whole = F.to_json(F.struct(listed, gates.alias("gates"), errors.alias("errors")))
    odd = F.to_json(F.struct(listed, F.struct(F.lit("cx").alias("gate")).alias("gates"), errors.alias("errors")))
    return rows.select("poll", F.when((F.col("poll") % 23 == 0) & (F.col("poll") % 13 != 0), odd).otherwise(whole).alias("properties"))


GOOD = "poll % 13 <> 0 AND poll % 17 <> 0 AND poll % 19 <> 0 AND poll % 23 <> 0"
FAILS = "CASE WHEN poll % 17 = 0 THEN 'payload reports errors' WHEN poll % 13 = 0 THEN 'payload lacks qubits or gates' WHEN poll % 19 = 0 THEN 'a qubit''s operational state is unreadable' WHEN poll % 23 = 0 THEN 'gates is no list' END"
EDGE = "CAST(n AS VARCHAR) || '-' || CAST(n + 1 AS VARCHAR) AS edge_id"
query("parse_qubit_properties", f"SELECT poll, CAST(qubit AS INT) AS qubit, 'T1' AS property_name, value, 'us' AS unit, date FROM lines WHERE {GOOD}")(lambda s, d: I.qubit_properties(raw(s, d)).where("property_name = 'T1'").withColumn("qubit", F.col("qubit").cast("int")))
query("parse_qubit_operational", f"SELECT poll, CAST(qubit AS INT) AS qubit, CASE op WHEN 'yes' THEN true WHEN 'False' THEN false END AS reported, coalesce(op = 'yes', true) AS effective, op IS NOT NULL AS is_explicit FROM lines WHERE {GOOD}")(
    lambda s, d: I.qubit_operational(raw(s, d)).select("poll", F.col("qubit").cast("int").alias("qubit"), "reported", "effective", "is_explicit")
)
query("parse_gate_properties", f"SELECT poll, gate AS gate_name, CAST(n + 1 AS VARCHAR) || ',' || CAST(n AS VARCHAR) AS qubits_key, {EDGE}, 'gate_error' AS parameter_name, err AS value, '' AS unit, date FROM lines WHERE {GOOD}")(lambda s, d: I.gate_properties(raw(s, d)))
query("parse_gate_operational", f"SELECT poll, gate AS gate_name, {EDGE}, CASE op WHEN 'yes' THEN true WHEN 'False' THEN false END AS reported, coalesce(op = 'yes', true) AS effective, op IS NOT NULL AS is_explicit FROM lines WHERE {GOOD}")(
    lambda s, d: I.gate_operational(raw(s, d)).select("poll", "gate_name", "edge_id", "reported", "effective", "is_explicit")
)
query("validate_payload", f"SELECT DISTINCT poll, {FAILS} AS error FROM lines")(lambda s, d: I.payloads(raw(s, d)).select("poll", "error"))
query("payload_error_class", f"SELECT {FAILS} AS error, count(DISTINCT poll) AS polls FROM lines GROUP BY 1")(lambda s, d: I.payloads(raw(s, d)).groupBy("error").agg(F.count("*").alias("polls")))
query("stream_failure_isolation", f"SELECT DISTINCT poll, {GOOD} AS success FROM lines")(lambda s, d: I.payloads(raw(s, d)).select("poll", F.col("error").isNull().alias("success")))
query("find_named_property", f"SELECT poll, CAST(qubit AS INT) AS qubit, op AS text FROM lines WHERE op IS NOT NULL AND {GOOD}")(
    lambda s, d: I.qubit_properties_named(raw(s, d), "operational").withColumn("qubit", F.col("qubit").cast("int"))
)
query("qubits_key", f"SELECT DISTINCT CAST(n + 1 AS VARCHAR) || ',' || CAST(n AS VARCHAR) AS qubits_key FROM lines WHERE {GOOD}")(lambda s, d: I.gate_properties(raw(s, d)).select("qubits_key").distinct())
query("make_edge_id", "SELECT DISTINCT n AS a, n % 3 AS b, CAST(least(n, n % 3) AS VARCHAR) || '-' || CAST(greatest(n, n % 3) AS VARCHAR) AS undirected, CAST(n AS VARCHAR) || '-' || CAST(n % 3 AS VARCHAR) AS directed FROM lines")(
    lambda s, d: P.table(s, d, "lineitem").select(F.col("l_linenumber").alias("a"), (F.col("l_linenumber") % 3).alias("b")).distinct().select("a", "b", X.edge_id(F.col("a"), F.col("b")).alias("undirected"), X.edge_id(F.col("a"), F.col("b"), "directed").alias("directed"))
)
query("parse_edge", "SELECT DISTINCT n AS a, n + 1 AS b FROM lines")(lambda s, d: P.properties(s, d).select("edge_id").distinct().select(F.split("edge_id", "-")[0].cast("int").alias("a"), F.split("edge_id", "-")[1].cast("int").alias("b")))
query("parse_status", "SELECT event_id AS poll, CASE WHEN event_id % 2 = 0 THEN CAST(floor(value) AS INT) + 1 ELSE CAST(floor(value) AS INT) END AS pending_jobs, CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 ELSE true END AS operational, CASE WHEN event_id % 3 <> 0 THEN 'active' END AS status_name, event_type AS status_msg FROM events")(
    lambda s, d: I.parse_status(
        P.table(s, d, "events").select(
            F.col("event_id").alias("poll"),
            F.to_json(F.struct(F.floor("value").alias("length_queue"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 2 == 0).alias("state"), F.when(F.col("event_id") % 3 != 0, "active").alias("status"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("message"))).alias("status"),
            F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, F.floor("value") + 1).alias("queue_length"), F.struct(F.col("event_type").alias("reason")).alias("status"))).alias("summary"),
        )
    )
)
#: Texts of the tables that are read as scalars: flags and names with blanks around them, numbers whole, broken, small and signed, and words.
TEXTS = """(SELECT DISTINCT unnest([l_returnflag, lower(l_linestatus), CASE WHEN l_quantity < 10 THEN ' YES ' WHEN l_quantity < 20 THEN 'False' WHEN l_quantity < 30 THEN 'true' WHEN l_quantity < 40 THEN '' ELSE ' online' END,
      CAST(l_linenumber - 1 AS VARCHAR), ' ' || CAST(l_suppkey AS VARCHAR) || ' ', CAST(l_linenumber AS VARCHAR) || '.5', CAST(l_linenumber AS VARCHAR) || 'e-7', '-' || CAST(l_linenumber AS VARCHAR)]) AS s FROM lineitem
    UNION SELECT DISTINCT unnest([c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'Paused' ELSE 'active' END]) FROM customer)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = F.col("l_linenumber").cast("string"), F.lit
    quantity = F.col("l_quantity")
    said = F.when(quantity < 10, " YES ").when(quantity < 20, "False").when(quantity < 30, "true").when(quantity < 40, "").otherwise(" online")
    lines = F.array("l_returnflag", F.lower("l_linestatus"), said, (F.col("l_linenumber") - 1).cast("string"), F.concat(s(" "), F.col("l_suppkey").cast("string"), s(" ")), F.concat(n, s(".5")), F.concat(n, s("e-7")), F.concat(s("-"), n))
    names = F.array("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "Paused").otherwise("active"))
    return P.table(spark, sf_dir, "lineitem").select(F.explode(lines).alias("s")).unionByName(P.table(spark, sf_dir, "customer").select(F.explode(names).alias("s"))).distinct()


OPV = "CASE WHEN lower(trim(s)) IN ('true', '1', 'yes') THEN true WHEN lower(trim(s)) IN ('false', '0', 'no') THEN false END"
query("parse_operational_value", f"SELECT s, {OPV} AS value, {OPV} IS NULL AS error FROM {TEXTS}")(lambda s, d: texts(s, d).select("s", X.operational_value(F.col("s"))[0].alias("value"), X.operational_value(F.col("s"))[1].alias("error")))
query("as_bool", f"SELECT s, coalesce({OPV}, length(s) > 0) AS value FROM {TEXTS}")(lambda s, d: texts(s, d).select("s", X.lenient_bool(F.col("s")).alias("value")))
query("operational_from_name", f"SELECT s, CASE WHEN lower(trim(s)) IN ('online', 'active', 'available', 'running') THEN true WHEN lower(trim(s)) IN ('offline', 'paused', 'maintenance', 'unavailable') THEN false END AS value FROM {TEXTS}")(lambda s, d: texts(s, d).select("s", X.operational_from_name(F.col("s")).alias("value")))
query("as_scalars", f"SELECT s, CASE WHEN regexp_full_match(trim(s), '-?[0-9]+') THEN CAST(trim(s) AS INT) END AS as_int, TRY_CAST(trim(s) AS DOUBLE) AS as_float, s AS as_str FROM {TEXTS}")(lambda s, d: texts(s, d).select("s", F.col("s").try_cast("int").alias("as_int"), F.col("s").try_cast("double").alias("as_float"), F.col("s").alias("as_str")))
query("first_of", f"SELECT s, coalesce(CASE WHEN regexp_full_match(trim(s), '-?[0-9]+') THEN CAST(trim(s) AS INT) END, CAST(length(s) AS INT)) AS value FROM {TEXTS}")(lambda s, d: texts(s, d).select("s", F.coalesce(F.col("s").try_cast("int"), F.length("s")).alias("value")))
#: Times of the events as seven forms of text, of which the last three are none.
FORMS = (
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ')", "epoch_us(date_trunc('second', ts))"),
    ("yyyy-MM-dd HH:mm:ss'+0200'", "strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S+0200')", "epoch_us(date_trunc('second', ts)) - 7200000000"),
    ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'-04:00'", "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f-04:00')", "epoch_us(ts) + 14400000000"),
    ("yyyy-MM-dd HH:mm:ss", "strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S')", "epoch_us(date_trunc('second', ts))"),
    ("yyyy-MM-dd", "strftime(ts, '%Y-%m-%d')", "epoch_us(date_trunc('day', ts))"),
    ("yyyy", "strftime(ts, '%Y')", "NULL"),
    ("'at 'HH:mm", "strftime(ts, 'at %H:%M')", "NULL"),
)
query("parse_timestamp", "SELECT event_id, v.s, CAST(v.us AS BIGINT) AS us FROM events, LATERAL (VALUES " + ", ".join(f"({text}, {us})" for _, text, us in FORMS) + ") v(s, us)")(
    lambda s, d: P.table(s, d, "events").select("event_id", F.explode(F.array(*[F.date_format("ts", f) for f, _, _ in FORMS])).alias("s")).select("event_id", "s", X.parse_timestamp(F.col("s")).alias("us"))
)
# the index comes in pages of twenty devices, each an answer of the service
query("src_device_index", "SELECT CAST(s_suppkey AS VARCHAR) AS name, s_name AS label FROM supplier")(
    lambda s, d: I.device_index(
        P.table(s, d, "supplier").groupBy(F.expr("s_suppkey div 20").alias("page")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("s_suppkey").cast("string").alias("name"), F.col("s_name").alias("label"))).alias("devices"))).alias("body"))
    ).select("name", F.get_json_object("device", "$.label").alias("label"))
)
for other in ("as_int", "as_float", "as_str"):
    QUERIES[other], ORACLES[other] = QUERIES["as_scalars"], ORACLES["as_scalars"]
