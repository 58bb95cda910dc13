"""Registered queries of rules, operators, streams, recursion, transactions and functions, each beside its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import operators as O
from .cluster import program as cluster_program
from .functions import bigint, groups, numeric, options, sets, strings, vectors
from .functions.selectors import label_selector_matches
from .plans.fixpoint import reachable
from .plans.program import INPUT, OUTPUT, Program
from .plans.session import Session
from .registry import ORACLE_SQL, QUERIES, Query, query, table
from .registry import joined_text as _text
from .storage import written
from .streaming import delayed, differentiate, epoch_rows
from .streaming import stream_transform as epoch_transform
from .types import REQUIREMENT

# --- cluster objects derived from the tables ------------------------------------------------------------------------------

_SVC = """SELECT n_name AS ns, s_name AS name,
  CASE s_suppkey % 4 WHEN 0 THEN 'ClusterIP' WHEN 1 THEN 'NodePort' WHEN 2 THEN 'LoadBalancer' ELSE 'ExternalName' END AS typ,
  CASE s_suppkey % 5 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'HOUSEHOLD' WHEN 3 THEN 'FURNITURE' ELSE 'AUTOMOBILE' END AS sel_segment
  FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
_POD = """SELECT n_name AS ns, c_name AS name, c_mktsegment AS segment, CASE WHEN c_acctbal < 0 THEN 'low' ELSE 'high' END AS tier,
  concat('node', CAST(c_custkey % 7 AS VARCHAR(9))) AS node FROM customer JOIN nation ON c_nationkey = n_nationkey"""
_ING = """SELECT * FROM (SELECT n_name AS ns, s_name AS name, concat('c', CAST(s_suppkey % 3 AS VARCHAR(9))) AS cls,
  lead(s_name) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS backend
  FROM supplier JOIN nation ON s_nationkey = n_nationkey) t WHERE backend IS NOT NULL"""
_IC = """SELECT n_name AS ns, s_name AS name, concat('c', CAST(CASE WHEN s_suppkey % 5 = 0 THEN 9 ELSE s_suppkey % 3 END AS VARCHAR(9))) AS cls
  FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
_VIEWS = f"WITH RECURSIVE svc AS ({_SVC}), pod AS ({_POD}), ing AS ({_ING}), ic AS ({_IC})"


def _labels(**entries: Column) -> Column:
    return F.array_sort(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in entries.items()]))


def _no_requirements() -> Column:
    return F.array().cast(T.ArrayType(REQUIREMENT))


def _meta(labels: Column | None = None) -> Column:
    empty = F.array().cast("array<struct<key:string,value:string>>")
    return F.struct(F.col("ns").alias("namespace"), F.col("name"), (empty if labels is None else labels).alias("labels"), empty.alias("annotations")).alias("meta")


def cluster_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The cluster relations, derived from customers, suppliers and nations."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("ns"))
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    c = customer.join(nation, customer.c_nationkey == nation.n_nationkey).withColumn("name", F.col("c_name"))
    s = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).withColumn("name", F.col("s_name"))
    key = F.col("s_suppkey")
    typ = F.element_at(F.array(*map(F.lit, ("ClusterIP", "NodePort", "LoadBalancer", "ExternalName"))), (key % 4 + 1).cast("int"))
    segment = F.element_at(F.array(*map(F.lit, ("BUILDING", "MACHINERY", "HOUSEHOLD", "FURNITURE", "AUTOMOBILE"))), (key % 5 + 1).cast("int"))
    selector = F.struct(_labels(segment=segment).alias("matchLabels"), _no_requirements().alias("matchExpressions"))
    operator = F.element_at(F.array(*map(F.lit, ("In", "NotIn", "Exists", "DoesNotExist"))), (key % 4 + 1).cast("int"))
    values = F.when(key % 4 < 2, F.array(segment)).otherwise(F.array().cast("array<string>"))
    wanted = F.when(key % 4 < 2, F.lit("segment")).otherwise(F.lit("zone"))
    requirement = F.array(F.struct(wanted.alias("reqkey"), operator.alias("operator"), values.alias("values")))
    expressions = F.struct(F.array().cast("array<struct<key:string,value:string>>").alias("matchLabels"), requirement.alias("matchExpressions"))
    from pyspark.sql import Window

    after = F.lead("s_name").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    rules = F.array(F.struct(F.concat("name", F.lit(".example.com")).alias("host"), F.col("backend")))
    tier = F.when(F.col("c_acctbal") < 0, "low").otherwise("high")
    node = F.concat(F.lit("node"), (F.col("c_custkey") % 7).cast("string"))
    return {
        "Pod": c.select(_meta(_labels(segment=F.col("c_mktsegment"), tier=tier)), F.struct(node.alias("nodeName")).alias("spec"), F.struct(F.lit("Running").alias("phase")).alias("status")),
        "Service": s.select(_meta(), F.struct(typ.alias("typ"), selector.alias("selector")).alias("spec")),
        "ReplicaSet": s.select(_meta(), F.struct(expressions.alias("selector")).alias("spec")),
        "Ingress": s.withColumn("backend", after).where("backend is not null").select(_meta(), F.struct(F.concat(F.lit("c"), (key % 3).cast("string")).alias("ingressClassName"), rules.alias("rules")).alias("spec")),
        "IngressController": s.select("ns", "name", F.concat(F.lit("c"), F.when(key % 5 == 0, 9).otherwise(key % 3).cast("string")).alias("className")),
        "Selectors": s.select(selector.alias("s")).distinct(),
    }


def _cluster(spark: SparkSession, sf_dir: str, output: str) -> DataFrame:
    """One output relation of the program."""
    return cluster_program().evaluate(spark, cluster_inputs(spark, sf_dir), only=[output])[output]


@query(f"{_VIEWS}, p(ns, name) AS (SELECT ns, name FROM svc WHERE typ = 'LoadBalancer' UNION SELECT s.ns, s.name FROM p JOIN ic ON ic.ns = p.ns AND ic.name = p.name JOIN ing ON ing.ns = p.ns AND ing.name = p.name AND ing.cls = ic.cls JOIN svc s ON s.ns = ing.ns AND s.name = ing.backend) SELECT * FROM p")
def rule_is_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cluster(spark, sf_dir, "IsPublic").select(F.col("svc.meta.namespace").alias("ns"), F.col("svc.meta.name").alias("name"))


@query(f"{_VIEWS} SELECT svc.ns AS ns, svc.name AS svc, pod.name AS pod FROM svc JOIN pod ON svc.ns = pod.ns AND svc.sel_segment = pod.segment")
def rule_service_matches_pod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cluster(spark, sf_dir, "ServiceMatchesPod").select(F.col("rs.meta.namespace").alias("ns"), F.col("rs.meta.name").alias("svc"), F.col("pod.meta.name").alias("pod"))


@query(f"{_VIEWS}, rs AS (SELECT n_name AS ns, s_name AS name, s_suppkey % 4 AS k, CASE s_suppkey % 5 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'HOUSEHOLD' WHEN 3 THEN 'FURNITURE' ELSE 'AUTOMOBILE' END AS seg FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT rs.ns AS ns, rs.name AS rs, pod.name AS pod FROM rs JOIN pod ON rs.ns = pod.ns WHERE (k = 0 AND segment = seg) OR (k = 1 AND segment <> seg) OR k = 3")
def rule_replicaset_matches_pod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cluster(spark, sf_dir, "ReplicaSetMatchesPod").select(F.col("rs.meta.namespace").alias("ns"), F.col("rs.meta.name").alias("rs"), F.col("pod.meta.name").alias("pod"))


@query(f"{_VIEWS} SELECT DISTINCT node AS name FROM pod")
def rule_nodes_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cluster(spark, sf_dir, "NodesInUse")


@query(f"{_VIEWS} SELECT DISTINCT ing.ns AS ns, ing.name AS ing, svc.name AS svc FROM ing JOIN svc ON svc.ns = ing.ns AND svc.name = ing.backend")
def rule_ingress_to_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cluster(spark, sf_dir, "IngressToService").select(F.col("ing.meta.namespace").alias("ns"), F.col("ing.meta.name").alias("ing"), F.col("svc.meta.name").alias("svc"))


_MATCHES = f"{_VIEWS}, sel AS (SELECT DISTINCT sel_segment AS seg FROM svc UNION ALL SELECT NULL) SELECT coalesce(seg, '*') AS seg, pod.ns AS ns, pod.name AS pod FROM sel JOIN pod ON seg IS NULL OR seg = segment"


def _matches(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce(F.get("selector.matchLabels", F.lit(0))["value"], F.lit("*")).alias("seg"), F.col("namespace").alias("ns"), F.col("pod.meta.name").alias("pod"))


@query(_MATCHES)
def rule_matches_pod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(_cluster(spark, sf_dir, "MatchesPod"))


def _indexed(spark: SparkSession, sf_dir: str) -> Session:
    p = Program()
    p.relation("Customer", table(spark, sf_dir, "customer").schema, kind=INPUT, key=("c_custkey",))
    p.relation("BySegment", T.StructType([T.StructField("segment", T.StringType()), T.StructField("nation", T.IntegerType()), T.StructField("name", T.StringType())]), kind=OUTPUT)
    p.rule("BySegment", ["Customer"], lambda s: s["Customer"].select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name")))
    p.index("BySegmentNation", "BySegment", "segment", "nation")
    session = Session(spark, p)
    session.start()
    session.insert("Customer", table(spark, sf_dir, "customer"))
    session.commit(changes=False)
    return session


@query("SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS nation, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir).query_index("BySegmentNation", "BUILDING", 3)


@query("SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS nation, c_name AS name FROM customer")
def index_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir).dump_index("BySegmentNation")


def _committed(spark: SparkSession, sf_dir: str) -> Session:
    """The cluster's pods and selectors in a session."""
    p = cluster_program()
    p.rules = [r for r in p.rules if r.head in p.needed(["MatchesPod"])]
    session, inputs = Session(spark, p), cluster_inputs(spark, sf_dir)
    session.start()
    for name in ("Pod", "Selectors"):
        session.insert(name, inputs[name])
    session.commit(changes=False)
    return session


_BUILDING = ([("segment", "BUILDING")], [])


@query(f"{_VIEWS} SELECT ns, name AS pod FROM pod WHERE segment = 'BUILDING' AND ns = (SELECT min(ns) FROM pod)")
def index_matches_pod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pods that one selector matches in one namespace."""
    session = _committed(spark, sf_dir)
    first = session.relation("Pod").agg(F.min("meta.namespace")).first()[0]
    return session.query_index("MatchesPod", _BUILDING, first).select(F.col("namespace").alias("ns"), F.col("pod.meta.name").alias("pod"))


@query(f"{_VIEWS} SELECT ns, name AS pod FROM pod WHERE segment = 'BUILDING'")
def index_matches_pod_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _committed(spark, sf_dir).query_index("MatchesPodAll", _BUILDING).select(F.col("namespace").alias("ns"), F.col("pod.meta.name").alias("pod"))


# --- operators ------------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem")
def op_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.map_rows(table(spark, sf_dir, "lineitem"), l_orderkey=F.col("l_orderkey"), l_linenumber=F.col("l_linenumber"), twice=F.col("l_quantity") * 2)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45")
def op_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.filter_rows(table(spark, sf_dir, "lineitem"), F.col("l_quantity") > 45).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, upper(l_returnflag) AS flag FROM lineitem WHERE l_returnflag <> 'N'")
def op_filter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.filter_map(table(spark, sf_dir, "lineitem"), F.col("l_returnflag") != "N", l_orderkey=F.col("l_orderkey"), l_linenumber=F.col("l_linenumber"), flag=F.upper("l_returnflag"))


@query("SELECT vec_id, unnest(embedding) AS x FROM embeddings")
def op_flat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.flat_map(table(spark, sf_dir, "embeddings"), F.col("embedding"), "x", "vec_id")


@query("SELECT o_custkey AS key0, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 7 <> 0")
def op_arrange(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey"))  # rows without a key go
    return O.arrange(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), key).select("key0", "o_orderkey")


@query("SELECT count(*) AS n, max(o_totalprice) AS most, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS filled FROM orders")
def op_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was observed of the rows that passed."""
    filled = F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    observed, seen = O.inspect(table(spark, sf_dir, "orders"), "orders_seen", n=F.count(F.lit(1)), most=F.max("o_totalprice"), filled=filled)
    observed.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["n"], seen.get["most"], seen.get["filled"])], "n long, most double, filled long")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def op_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.distinct(O.union(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))))


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    plus = O.weighted(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")))
    minus = O.negate(O.weighted(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))))
    return O.union(plus, minus)


@query("SELECT k, CAST(sum(w) AS BIGINT) AS w FROM (SELECT c_nationkey AS k, 1 AS w FROM customer UNION ALL SELECT s_nationkey, -1 FROM supplier) GROUP BY k HAVING sum(w) <> 0")
def op_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.consolidate(_signed(spark, sf_dir)).withColumnRenamed("__w", "w")


@query("SELECT k FROM (SELECT c_nationkey AS k, 1 AS w FROM customer UNION ALL SELECT s_nationkey, -1 FROM supplier) GROUP BY k HAVING sum(w) <> 0")
def op_diff_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.distinct(_signed(spark, sf_dir))


@query("SELECT p_size AS k FROM part EXCEPT SELECT CAST(l_quantity AS INTEGER) FROM lineitem WHERE l_quantity < 30")
def op_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.difference(table(spark, sf_dir, "part").select(F.col("p_size").alias("k")), table(spark, sf_dir, "lineitem").where("l_quantity < 30").select(F.col("l_quantity").cast("int").alias("k")))


@query("SELECT p_size AS k FROM part INTERSECT SELECT CAST(l_quantity AS INTEGER) FROM lineitem WHERE l_quantity < 30")
def op_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.intersection(table(spark, sf_dir, "part").select(F.col("p_size").alias("k")), table(spark, sf_dir, "lineitem").where("l_quantity < 30").select(F.col("l_quantity").cast("int").alias("k")))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def op_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.equi_join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), {"o_custkey": "c_custkey"}).select("o_orderkey", "c_name")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > c_acctbal * 20")
def op_join_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.equi_join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), {"o_custkey": "c_custkey"}, F.col("o_totalprice") > F.col("c_acctbal") * 20).select("o_orderkey", "c_name")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region WHERE n_regionkey < r_regionkey")
def op_cross_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.cross_join(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), F.col("n_regionkey") < F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def op_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.semijoin(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 300000"), {"c_custkey": "o_custkey"}).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 250000)")
def op_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_totalprice > 250000")
    return O.antijoin(table(spark, sf_dir, "customer"), large, {"c_custkey": "o_custkey"}).select("c_custkey")


# --- aggregates -----------------------------------------------------------------------------------------------------------

_L = "(SELECT DISTINCT l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS q FROM lineitem)"


def _group(spark: SparkSession, sf_dir: str, **aggregates: Column) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("q"))
    return O.aggregate(rows, ["l_returnflag"], ["l_linestatus", "q"], **aggregates)


@query(f"SELECT l_returnflag, count(*) AS n, min(q) AS lo, max(q) AS hi FROM {_L} GROUP BY l_returnflag")
def agg_count_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group(spark, sf_dir, n=groups.count_distinct("l_linestatus", "q"), lo=groups.minimum("q"), hi=groups.maximum("q"))


@query(f"SELECT l_returnflag, l_linestatus AS status, q FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_linestatus, q) AS r FROM {_L}) WHERE r = 1")
def agg_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group(spark, sf_dir, v=groups.first("l_linestatus", "q")).select("l_returnflag", F.col("v.l_linestatus").alias("status"), F.col("v.q").alias("q"))


@query(f"SELECT l_returnflag, q FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_linestatus, q) AS r FROM {_L}) WHERE r = 4")
def agg_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group(spark, sf_dir, v=groups.nth(3, "l_linestatus", "q")).select("l_returnflag", F.col("v.q").alias("q"))


@query(f"SELECT l_returnflag, array_to_string(list_sort(list(DISTINCT q)), ',') AS qs FROM {_L} GROUP BY l_returnflag")
def agg_to_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group(spark, sf_dir, s=groups.to_set("q")).select("l_returnflag", _text(F.col("s")).alias("qs"))


@query(f"SELECT l_returnflag, string_agg(CAST(q AS VARCHAR), ',' ORDER BY l_linestatus, q) AS qs FROM {_L} GROUP BY l_returnflag")
def agg_to_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group(spark, sf_dir, v=groups.to_vec(lambda p: p["q"], "l_linestatus", "q")).select("l_returnflag", _text(F.col("v")).alias("qs"))


@query(f"SELECT l_returnflag, string_agg(concat(l_linestatus, '=', CAST(m AS VARCHAR)), ',' ORDER BY l_linestatus) AS m FROM (SELECT l_returnflag, l_linestatus, max(q) AS m FROM {_L} GROUP BY ALL) GROUP BY l_returnflag")
def agg_to_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.transform("v", lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return _group(spark, sf_dir, v=groups.to_map("l_linestatus", "q")).select("l_returnflag", F.array_join(entries, ",").alias("m"))


@query(f"SELECT l_returnflag, string_agg(concat(l_linestatus, '=', vs), ';' ORDER BY l_linestatus) AS m FROM (SELECT l_returnflag, l_linestatus, string_agg(CAST(q AS VARCHAR), ',' ORDER BY q) AS vs FROM {_L} GROUP BY ALL) GROUP BY l_returnflag")
def agg_to_setmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.transform("v", lambda e: F.concat(e["key"], F.lit("="), _text(e["value"])))
    return _group(spark, sf_dir, v=groups.to_setmap("l_linestatus", "q")).select("l_returnflag", F.array_join(entries, ";").alias("m"))


@query(f"SELECT l_returnflag, string_agg(l_linestatus, ',' ORDER BY l_linestatus, q) AS a, string_agg(CAST(q AS VARCHAR), ',' ORDER BY l_linestatus, q) AS b FROM {_L} GROUP BY l_returnflag")
def agg_unzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group(spark, sf_dir, v=groups.unzip("l_linestatus", "q")).select("l_returnflag", _text(F.col("v._1")).alias("a"), _text(F.col("v._2")).alias("b"))


@query("SELECT o_orderstatus, array_to_string(list_sort(list(DISTINCT x)), ',') AS xs FROM (SELECT o_orderstatus, unnest([o_custkey % 10, o_custkey % 7]) AS x FROM orders) GROUP BY o_orderstatus")
def agg_set_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.array(F.col("o_custkey") % 10, F.col("o_custkey") % 7).alias("s"))
    return O.aggregate(rows, ["o_orderstatus"], ["s"], xs=groups.set_unions("s")).select("o_orderstatus", _text(F.col("xs")).alias("xs"))


@query("SELECT n FROM (SELECT 1 AS k, count(*) AS n FROM orders WHERE o_totalprice < 0 GROUP BY k)")
def agg_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.aggregate(table(spark, sf_dir, "orders"), [], ["o_orderkey"], where=F.col("o_totalprice") < 0, n=F.count(F.lit(1)))


# --- streams and epochs ---------------------------------------------------------------------------------------------------

_E = "(SELECT event_id % 5 AS epoch, user_id, event_type FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("event_id") % 5).alias("epoch"), "user_id", "event_type")


@query(f"SELECT user_id, event_type, c_name FROM {_E} JOIN customer ON user_id = c_custkey WHERE epoch = 4")
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = epoch_rows(_events(spark, sf_dir), 4)
    return O.stream_join(now, table(spark, sf_dir, "customer"), {"user_id": "c_custkey"}).select("user_id", "event_type", "c_name")


@query(f"SELECT user_id, event_type FROM {_E} WHERE epoch = 4 AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def stream_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return O.stream_semijoin(epoch_rows(_events(spark, sf_dir), 4), state, {"user_id": "c_custkey"})


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM {_E} WHERE epoch = 4)")
def stream_semijoin_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.stream_semijoin(epoch_rows(_events(spark, sf_dir), 4), table(spark, sf_dir, "customer"), {"user_id": "c_custkey"}, keep_state=True).select("c_custkey", "c_name")


@query(f"SELECT epoch, event_type, count(*) AS n FROM (SELECT DISTINCT * FROM {_E}) GROUP BY epoch, event_type")
def stream_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda rows: O.aggregate(rows, ["event_type"], ["user_id"], n=F.count(F.lit(1)))
    return epoch_transform(_events(spark, sf_dir), count, list(range(5))).withColumn("epoch", F.col("epoch").cast("long"))


@query(f"SELECT DISTINCT epoch + 1 AS epoch, user_id FROM {_E}")
def stream_delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delayed(_events(spark, sf_dir).select("epoch", "user_id").distinct(), 1)


@query(f"SELECT epoch, user_id, CAST(sum(w) AS BIGINT) AS w FROM (SELECT DISTINCT epoch, user_id, 1 AS w FROM {_E} UNION ALL SELECT DISTINCT epoch + 1, user_id, -1 FROM {_E} WHERE epoch < 4) GROUP BY ALL HAVING sum(w) <> 0")
def stream_differentiate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differentiate(_events(spark, sf_dir).select("epoch", "user_id").distinct()).withColumnRenamed("__w", "w")


# --- recursion ------------------------------------------------------------------------------------------------------------


@query("WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0), path(src, dst) AS (SELECT src, dst FROM e UNION SELECT path.src, e.dst FROM path JOIN e ON path.dst = e.src) SELECT * FROM path")
def recursion_acyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reachable(table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst")))


@query("WITH RECURSIVE n AS (SELECT count(*) AS n FROM supplier), e AS (SELECT s_suppkey AS src, (7 * s_suppkey + 3) % n AS dst FROM supplier, n), path(src, dst) AS (SELECT src, dst FROM e UNION SELECT path.src, e.dst FROM path JOIN e ON path.dst = e.src) SELECT * FROM path")
def recursion_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    n = supplier.count()
    edges = supplier.select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * 7 + 3) % n).alias("dst"))
    return reachable(edges)


#: Nodes in one group that others meet together, and tasks a core over which these groups are dealt.
CHUNK, TASKS = 1024, 16


def unrelated(s: dict[str, DataFrame]) -> DataFrame:
    """Pairs that have an ancestor in common and of which none is the other's, each once; nothing may be its own ancestor.

    What two nodes have in common has a topmost ancestor, which they have in common too. Nodes with the same topmost ancestors
    are a class, so that a pair belongs to one pair of classes. A node meets a group of a class as one array, less the few
    nodes there that are its own kin: neither shuffled nor judged is any pair, they are only listed.
    """
    ancestor = s["Ancestor"].where("a IS NOT NULL AND d IS NOT NULL")
    dealt = TASKS * ancestor.sparkSession.sparkContext.defaultParallelism
    tops = O.antijoin(ancestor, ancestor.select(F.col("d").alias("below")).distinct(), {"a": "below"})
    classed = tops.groupBy(F.col("d").alias("node")).agg(F.sort_array(F.collect_set("a")).alias("tops"))
    classes = classed.groupBy("tops").agg(F.min("node").alias("cls"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    place = written(classed.join(classes, "tops").select("node", "tops", "cls", "chunks", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk")))
    under = place.select("cls", "chunks", "tops").distinct().select("cls", "chunks", F.explode("tops").alias("top"))
    met = under.select(F.col("cls").alias("mine"), "top").join(under, "top").select("mine", "cls", "chunks").distinct()

    own = place.select(F.col("node").alias("p"), F.col("cls").alias("mine"))
    kin = ancestor.select(F.col("a").alias("p"), F.col("d").alias("node")).unionByName(ancestor.select(F.col("d").alias("p"), F.col("a").alias("node"))).unionByName(place.select(F.col("node").alias("p"), "node"))
    kin = kin.join(own.select("p"), "p", "left_semi").join(place.select("node", "cls", "chunk"), "node")
    some = kin.groupBy("p", "cls", "chunk").agg(F.collect_list("node").alias("less"))
    seen = some.groupBy("p", "cls").agg(F.collect_list("chunk").alias("seen"))
    others = F.array_except(F.sequence(F.lit(0), F.col("chunks") - 1), F.coalesce("seen", F.array().cast("array<int>")))
    rest = own.join(met, "mine").join(seen, ["p", "cls"], "left").select("p", "cls", F.explode(others).alias("chunk"), F.lit(None).cast("array<long>").alias("less"))

    each = some.select("p", "cls", "chunk", "less").unionByName(rest).repartition(dealt, "cls", "chunk")
    groups = place.groupBy("cls", "chunk").agg(F.collect_list("node").alias("group")).repartition(dealt, "cls", "chunk")
    free = F.when(F.col("less").isNull(), F.col("group")).otherwise(F.array_except("group", "less"))
    return each.join(groups.hint("merge"), ["cls", "chunk"]).select("p", F.explode(free).alias("q"))


@query("WITH RECURSIVE e AS (SELECT p_partkey // 16 AS parent, p_partkey AS child FROM part WHERE p_partkey >= 16), anc(a, d) AS (SELECT parent, child FROM e UNION SELECT e.parent, anc.d FROM e JOIN anc ON e.child = anc.a) SELECT x.d AS p, y.d AS q FROM anc x JOIN anc y ON x.a = y.a WHERE x.d <> y.d AND NOT EXISTS (SELECT 1 FROM anc z WHERE z.a = x.d AND z.d = y.d) AND NOT EXISTS (SELECT 1 FROM anc z WHERE z.a = y.d AND z.d = x.d) GROUP BY x.d, y.d")
def recursion_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Program()
    pair = lambda a, b: T.StructType([T.StructField(a, T.LongType()), T.StructField(b, T.LongType())])
    p.relation("Parent", pair("parent", "child"), kind=INPUT)
    p.relation("Ancestor", pair("a", "d"), kind=OUTPUT)
    p.relation("Common", pair("p", "q"), kind=OUTPUT)
    p.rule("Ancestor", ["Parent"], lambda s: s["Parent"].toDF("a", "d"))
    p.rule("Ancestor", ["Parent", "Ancestor"], lambda s: O.equi_join(s["Parent"], s["Ancestor"], {"child": "a"}).select(F.col("parent").alias("a"), "d"))

    p.rule("Common", ["Ancestor"], unrelated, negated=["Ancestor"], unique=True)
    parts = table(spark, sf_dir, "part").where("p_partkey >= 16")  # the others are roots
    return p.evaluate(spark, {"Parent": parts.select(F.expr("p_partkey div 16").alias("parent"), F.col("p_partkey").alias("child"))})["Common"]


# --- transactions ---------------------------------------------------------------------------------------------------------


def _suppliers(spark: SparkSession, sf_dir: str) -> tuple[Session, DataFrame]:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    p = Program()
    p.relation("Supplier", rows.schema, kind=INPUT, key=("s_suppkey",))
    p.relation("Nations", T.StructType([T.StructField("n", T.IntegerType())]), kind=OUTPUT)
    p.rule("Nations", ["Supplier"], lambda s: s["Supplier"].select(F.col("s_nationkey").alias("n")))
    session = Session(spark, p)
    session.start()
    session.insert("Supplier", rows.where("s_suppkey % 2 = 0"))
    session.commit(changes=False)
    session.start()
    return session, rows


def _transaction(sql: str):
    def add(f: Callable[[Session, DataFrame], None]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            session, rows = _suppliers(spark, sf_dir)
            f(session, rows)
            if session.staged is not None:
                session.commit(changes=False)
            return session.relation("Supplier")

        run.__name__ = f.__name__
        return query(sql)(run)

    return add


_S = "SELECT s_suppkey, s_name, s_nationkey FROM supplier"


@_transaction(f"{_S} WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
def txn_insert(session: Session, rows: DataFrame) -> None:
    session.insert("Supplier", rows.where("s_suppkey % 2 = 1 AND s_suppkey % 3 = 0"))


@_transaction("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE s_name END AS s_name, s_nationkey FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
def txn_insert_or_update(session: Session, rows: DataFrame) -> None:
    session.insert_or_update("Supplier", rows.where("s_suppkey % 3 = 0").withColumn("s_name", F.upper("s_name")))


@_transaction(f"{_S} WHERE s_suppkey % 2 = 0 AND s_nationkey <> 4")
def txn_delete(session: Session, rows: DataFrame) -> None:
    session.delete("Supplier", rows.where("s_suppkey % 2 = 0 AND s_nationkey = 4"))


@_transaction(f"{_S} WHERE s_suppkey % 2 = 0 AND s_suppkey % 10 <> 0")
def txn_delete_key(session: Session, rows: DataFrame) -> None:
    session.delete_key("Supplier", rows.where("s_suppkey % 10 = 0").select("s_suppkey"))


@_transaction("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 10 = 0 THEN 99 ELSE s_nationkey END AS s_nationkey FROM supplier WHERE s_suppkey % 2 = 0")
def txn_modify(session: Session, rows: DataFrame) -> None:
    session.modify("Supplier", rows.where("s_suppkey % 10 = 0").select("s_suppkey"), {"s_nationkey": F.lit(99)})


@_transaction(f"{_S} WHERE false")
def txn_clear(session: Session, rows: DataFrame) -> None:
    session.clear("Supplier")


@_transaction(f"{_S} WHERE s_suppkey % 2 = 0")
def txn_rollback(session: Session, rows: DataFrame) -> None:
    session.clear("Supplier")
    session.rollback()


@query("SELECT s_nationkey AS n, CAST(CASE WHEN min(s_suppkey % 2) = 1 THEN 1 END AS BIGINT) AS w FROM supplier GROUP BY s_nationkey HAVING min(s_suppkey % 2) = 1 UNION ALL SELECT 99, 1")
def txn_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of an output relation by one commit."""
    session, rows = _suppliers(spark, sf_dir)
    session.insert("Supplier", rows.where("s_suppkey % 2 = 1").unionByName(rows.where("s_suppkey = 1").withColumns({"s_suppkey": F.lit(-1).cast("long"), "s_nationkey": F.lit(99)})))
    return session.commit()["Nations"].withColumnRenamed("__w", "w")


# --- functions ------------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, strlen(text) AS bytes, lower(source) AS low, upper(source) AS up, reverse(source) AS rev, contains(text, 'th') AS has,
  starts_with(source, 'src1') AS pre, suffix(source, '7') AS post, replace(source, 'src', 'S') AS rep, substr(source, 2, 2) AS sub,
  array_to_string(string_split(source, 'r'), '|') AS cut, concat(lang, '-', source) AS app,
  TRY_CAST(substr(source, 4) AS BIGINT) AS num, printf('%x', CAST(doc_id AS BIGINT)) AS hex FROM documents""")
def fn_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, lit = F.col("source"), F.lit
    return table(spark, sf_dir, "documents").select(
        "doc_id", strings.length(F.col("text")).alias("bytes"), strings.to_lowercase(s).alias("low"), strings.to_uppercase(s).alias("up"),
        strings.reverse(s).alias("rev"), strings.contains(F.col("text"), lit("th")).alias("has"), strings.starts_with(s, lit("src1")).alias("pre"),
        strings.ends_with(s, lit("7")).alias("post"), strings.replace(s, "src", "S").alias("rep"), strings.substr(s, lit(1), lit(3)).alias("sub"),
        strings.join(strings.split(s, "r"), "|").alias("cut"), strings.append(strings.append(F.col("lang"), lit("-")), s).alias("app"),
        strings.parse_dec_i64(strings.substr(s, lit(3), lit(99))).alias("num"), strings.hex_of(F.col("doc_id")).alias("hex"),
    )


@query("""SELECT p_partkey, least(p_size, 20) AS lo, greatest(p_size, 20) AS hi, CAST((p_size * p_size * p_size) % 256 AS BIGINT) AS cube,
  array_to_string(range(0, p_size, 7), ',') AS steps, ((p_size & 255) << 8) | ((p_size >> 8) & 255) AS swapped FROM part""")
def fn_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", numeric.minimum(n, F.lit(20)).alias("lo"), numeric.maximum(n, F.lit(20)).alias("hi"), numeric.pow32(n, F.lit(3), 8, False).alias("cube"),
        _text(numeric.range_vec(F.lit(0), n, F.lit(7))).alias("steps"), numeric.htons(n).alias("swapped"),
    )


_V = "[l_orderkey % 7, l_partkey % 7, l_suppkey % 7]"


@query(f"""SELECT l_orderkey, l_linenumber, CAST(3 AS BIGINT) AS len, list_contains(v, 3) AS has, v[2] AS nth, array_to_string(list_sort(v), ',') AS sorted,
  array_to_string(list_reverse(v), ',') AS rev, array_to_string(list_sort(list_distinct(v)), ',') AS st, array_to_string(list_append(v, 9), ',') AS push,
  v[3] AS last, array_to_string(v[1:2], ',') AS rest FROM (SELECT *, {_V} AS v FROM lineitem)""")
def fn_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.array(F.col("l_orderkey") % 7, F.col("l_partkey") % 7, F.col("l_suppkey") % 7)
    popped = vectors.pop(v)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", vectors.length(v).alias("len"), vectors.contains(v, F.lit(3).cast("long")).alias("has"), vectors.nth(v, F.lit(1)).alias("nth"),
        _text(vectors.sort(v)).alias("sorted"), _text(vectors.reverse(v)).alias("rev"), _text(vectors.to_set(v)).alias("st"),
        _text(vectors.push(v, F.lit(9).cast("long"))).alias("push"), popped["last"].alias("last"), _text(popped["rest"]).alias("rest"),
    )


@query(f"""SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(list_concat(v, [1, 2]))), ',') AS un,
  array_to_string(list_sort(list_filter(list_distinct(v), lambda x: x IN (1, 2))), ',') AS inter,
  array_to_string(list_sort(list_filter(list_distinct(v), lambda x: x NOT IN (1, 2))), ',') AS diff FROM (SELECT *, {_V} AS v FROM lineitem)""")
def fn_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vectors.to_set(F.array(F.col("l_orderkey") % 7, F.col("l_partkey") % 7, F.col("l_suppkey") % 7))
    other = F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", _text(sets.union(s, other)).alias("un"), _text(sets.intersection(s, other)).alias("inter"), _text(sets.difference(s, other)).alias("diff")
    )


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal * 2 END AS twice, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0) AS kept,
  NOT c_acctbal > 0 AS gone, CASE WHEN NOT c_acctbal > 0 THEN 'negative' END AS err, CAST(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS INTEGER) AS n FROM customer""")
def fn_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    result = options.ok_or(o, F.lit("negative"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", options.and_then(o, lambda x: x * 2).alias("twice"), options.unwrap_or(o, F.lit(0.0)).alias("kept"), options.is_err(result).alias("gone"),
        result["err"].alias("err"), F.size(options.to_vec(o)).alias("n"),
    )


@query("SELECT o_orderkey, CAST(CAST(o_orderkey AS HUGEINT) * 1000000007 * 1000003 AS VARCHAR) AS prod, CAST(o_orderkey // 7 AS VARCHAR) AS quot, CAST(o_orderkey % 7 AS VARCHAR) AS rem FROM orders")
def fn_bigint(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", bigint.exact("mul", bigint.exact("mul", k, F.lit("1000000007")), F.lit("1000003")).alias("prod"),
        bigint.quotient(k, F.lit(7)).cast("string").alias("quot"), bigint.remainder(k, F.lit(7)).cast("string").alias("rem"),
    )


@query("""SELECT c_custkey, seg IN ('BUILDING', 'MACHINERY') AS is_in, seg <> 'BUILDING' AS not_in, odd AS there, NOT odd AS absent, NOT odd OR seg <> 'BUILDING' AS not_in_or_absent, false AS none, true AS every,
  seg = 'BUILDING' AND low AS both, seg = 'BUILDING' AND odd AS mixed FROM (SELECT c_custkey, c_mktsegment AS seg, c_custkey % 2 = 1 AS odd, c_acctbal < 0 AS low FROM customer)""")
def selector_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels segment and tier of every customer, and of every other one zone (the segment)."""
    segment, tier = F.col("c_mktsegment"), F.when(F.col("c_acctbal") < 0, "low").otherwise("high")
    labels = F.when(F.col("c_custkey") % 2 == 1, _labels(segment=segment, tier=tier, zone=segment)).otherwise(_labels(segment=segment, tier=tier))
    empty_map, no = F.array().cast("array<struct<key:string,value:string>>"), F.array().cast("array<string>")
    listed = lambda *v: F.array(*map(F.lit, v))

    def need(key: str, op: str, values: Column) -> Column:
        return F.array(F.struct(F.lit(key).alias("reqkey"), F.lit(op).alias("operator"), values.alias("values")))

    def matches(named: Column, needs: Column) -> Column:
        return label_selector_matches(F.struct(named.alias("matchLabels"), needs.alias("matchExpressions")), labels)

    building = _labels(segment=F.lit("BUILDING"))
    missing = F.when(F.lit(False), F.struct(empty_map.alias("matchLabels"), _no_requirements().alias("matchExpressions")))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", matches(empty_map, need("segment", "In", listed("BUILDING", "MACHINERY"))).alias("is_in"), matches(empty_map, need("segment", "NotIn", listed("BUILDING"))).alias("not_in"),
        matches(empty_map, need("zone", "Exists", no)).alias("there"), matches(empty_map, need("zone", "DoesNotExist", no)).alias("absent"),
        matches(empty_map, need("zone", "NotIn", listed("BUILDING"))).alias("not_in_or_absent"), label_selector_matches(missing, labels).alias("none"), matches(empty_map, _no_requirements()).alias("every"),
        matches(_labels(segment=F.lit("BUILDING"), tier=F.lit("low")), _no_requirements()).alias("both"), matches(building, need("zone", "Exists", no)).alias("mixed"),
    )


from . import function_queries, session_queries  # noqa: E402, F401  (they register theirs)

__all__ = ["ORACLE_SQL", "QUERIES"]
