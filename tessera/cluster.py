"""Rules over cluster objects: pods, services, replica sets, ingresses and label selectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import types as S
from .functions.selectors import label_selector_matches
from .operators import flat_map
from .plans.fixpoint import State
from .plans.program import INPUT, OUTPUT, Program


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


def by_name(df: DataFrame, name: str) -> DataFrame:
    """An object with its namespace and name."""
    return df.select(F.struct("*").alias(name), F.col("meta.namespace").alias("ns"), F.col("meta.name").alias("name"))


def nodes_in_use(s: State) -> DataFrame:
    """Also the node '' of pods that are not placed yet."""
    return s["Pod"].select(F.col("spec.nodeName").alias("name"))


def _choices(selector: Column) -> Column:
    """Ways to look a selector up in an index of labels, each an array of (key, value) of which a matching object has exactly
    one; a null value stands for any. Negative requirements and empty selectors offer none."""
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    anything = F.lit(None).cast("string")
    named = F.transform(selector["matchLabels"], lambda e: F.array(entry(e["key"], e["value"])))
    positive = F.filter(selector["matchExpressions"], lambda r: r["operator"].isin("In", "Exists"))
    required = F.transform(
        positive,
        lambda r: F.when(r["operator"] == "In", F.transform(F.array_distinct(r["values"]), lambda v: entry(r["reqkey"], v))).otherwise(F.array(entry(r["reqkey"], anything))),
    )
    return F.concat(named, required)


#: Parts that pods are dealt to besides the keys of a join: a label, namespace or selector of most pods is no single task.
PARTS = 32


def _in_parts(pods: DataFrame) -> DataFrame:
    return pods.distinct().withColumn("part", F.pmod(F.xxhash64("pod"), F.lit(PARTS)).cast("int"))


def _for_each_part(df: DataFrame) -> DataFrame:
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))


def matching(tests: DataFrame, pods: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """tests (distinct selectors, none null, with columns of ``scope``) with the pods (in parts) that they match, once each.

    Each selector is looked up by the choice that the fewest pods meet, in an index of labels; the whole selector is tested
    on what that finds. Selectors without a choice match almost everything: they meet all pods of their scope. Pods are
    never broadcast: compressed tables look smaller to Spark than a driver's memory.
    """
    held = F.transform("pod.meta.labels", lambda e: F.array(F.struct(e["key"].alias("key"), e["value"].alias("value")), F.struct(e["key"].alias("key"), F.lit(None).cast("string").alias("value"))))
    index = pods.select("pod", "part", *scope, F.explode(F.array_distinct(F.flatten(held))).alias("l")).select("pod", "part", *scope, F.col("l.key").alias("key"), F.col("l.value").alias("value"))
    counts = index.groupBy("key", "value").agg(F.count("*").alias("pods")).withColumnsRenamed({"key": "ck", "value": "cv"})
    choices = tests.select("selector").distinct().withColumn("choices", _choices(F.col("selector")))
    ways = choices.select("selector", F.posexplode("choices").alias("no", "entries"))
    each = ways.select("selector", "no", "entries", F.explode_outer("entries").alias("e"))
    costs = each.join(counts.hint("merge"), (F.col("e.key") == F.col("ck")) & F.col("e.value").eqNullSafe(F.col("cv")), "left").groupBy("selector", "no").agg(F.sum(F.coalesce("pods", F.lit(0))).alias("cost"))
    best = costs.groupBy("selector").agg(F.min(F.struct("cost", "no"))["no"].alias("best")).withColumnRenamed("selector", "s1")
    probes = each.join(best, (F.col("selector") == F.col("s1")) & (F.col("no") == F.col("best"))).select(F.col("selector").alias("s2"), F.col("e.key").alias("pk"), F.col("e.value").alias("pv"), "entries")
    asked = _for_each_part(tests.join(probes, F.col("selector") == F.col("s2")).select(*tests.columns, "pk", "pv", "entries"))
    test = label_selector_matches(F.col("selector"), F.col("pod.meta.labels"))

    place = ["part", *scope]
    there = {c: f"at_{c}" for c in place}
    same_place = reduce(Column.__and__, [F.col(c) == F.col(there[c]) for c in place])

    # a pod that meets several entries of a choice counts by the first
    has = lambda e: F.exists("pod.meta.labels", lambda x: (x["key"] == e["key"]) & (e["value"].isNull() | (x["value"] == e["value"])))
    first = F.get(F.filter("entries", has), F.lit(0))
    once = (F.size("entries") == 1) | (first["key"].eqNullSafe(F.col("pk")) & first["value"].eqNullSafe(F.col("pv")))
    met = asked.join(index.withColumnsRenamed(there).hint("merge"), same_place & (F.col("pk") == F.col("key")) & F.col("pv").eqNullSafe(F.col("value")))
    found = met.where(test & once).select("selector", *place, "pod")
    broad = _for_each_part(tests.where(F.size(_choices(F.col("selector"))) == 0))
    rest = broad.join(pods.withColumnsRenamed(there).hint("merge"), same_place).where(test)
    return found.unionByName(rest.select("selector", *place, "pod"))


def selected(owners: DataFrame, pods: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """owners (owner, selector and the columns of ``scope``) with the pods (pod and those columns) that their selectors match,
    once each. Owners with the same selector and scope share its look-up and tests."""
    owners = owners.where("selector is not null").distinct()
    found = matching(owners.select("selector", *scope).distinct(), _in_parts(pods), scope)
    return found.join(_for_each_part(owners).hint("merge"), ["selector", *scope, "part"]).select("owner", "pod")


def matches_pod(s: State) -> DataFrame:
    """Every selector with every pod that it matches."""
    tests = s["Selectors"].select(F.col("s").alias("selector")).where("selector is not null").distinct()
    found = matching(tests, _in_parts(s["PodByName"].select("pod")), ())
    return found.select("selector", F.col("pod.meta.namespace").alias("namespace"), "pod")


def _selects(owner: str, relation: str):
    def body(s: State) -> DataFrame:
        owners = s[relation].select(F.col(owner).alias("owner"), F.col(f"{owner}.spec.selector").alias("selector"), "ns")
        return selected(owners, s["PodByName"].select("pod", "ns"), ("ns",)).select(F.col("owner").alias("rs"), "pod")

    return body


def ingress_to_service(s: State) -> DataFrame:
    ingresses = s["Ingress"].select(F.struct("*").alias("ing"))
    rules = flat_map(ingresses, F.col("ing.spec.rules"), "rule", "ing")
    services = s["ServiceByName"]
    return rules.join(services, (F.col("ing.meta.namespace") == services["ns"]) & (F.col("rule.backend") == services["name"])).select("ing", "svc")


def public_names(s: State) -> DataFrame:
    return s["Service"].where(F.col("spec.typ") == "LoadBalancer").select(F.col("meta.namespace").alias("ns"), F.col("meta.name").alias("name"))


def exposes(s: State) -> DataFrame:
    """Which service leads to which: the ingress that has a service's namespace and name, and whose class the service's
    controller serves, leads to its backends."""
    routed = s["IngressToService"].select(
        F.col("ing.meta.namespace").alias("ns"), F.col("ing.meta.name").alias("name"), F.col("ing.spec.ingressClassName").alias("className"),
        F.col("svc.meta.namespace").alias("to_ns"), F.col("svc.meta.name").alias("to_name"),
    )
    return routed.join(s["IngressController"], ["ns", "name", "className"]).select("ns", "name", "to_ns", "to_name")


def public_through_ingress(s: State) -> DataFrame:
    return s["Exposes"].join(s["PublicName"], ["ns", "name"]).select(F.col("to_ns").alias("ns"), F.col("to_name").alias("name"))


def is_public(s: State) -> DataFrame:
    """The services that have a public name."""
    return s["ServiceByName"].join(s["PublicName"], ["ns", "name"], "left_semi").select("svc")


def program() -> Program:
    p = Program()
    key = ("meta.namespace", "meta.name")
    for name, schema in (("Pod", S.POD), ("Service", S.SERVICE), ("ReplicaSet", S.REPLICA_SET), ("Ingress", S.INGRESS)):
        p.relation(name, schema, kind=INPUT, key=key)
    p.relation("Selectors", _fields(s=S.SELECTOR), kind=INPUT, key=("s",))
    p.relation("IngressController", S.CONTROLLER, kind=INPUT)
    p.facts["Selectors"] = [(([], []),)]
    text = T.StringType()
    for name, column, schema in (("Pod", "pod", S.POD), ("Service", "svc", S.SERVICE), ("ReplicaSet", "rs", S.REPLICA_SET), ("Ingress", "ing", S.INGRESS)):
        p.relation(f"{name}ByName", _fields(**{column: schema, "ns": text, "name": text}), distinct=False)
        p.rule(f"{name}ByName", [name], lambda s, name=name, column=column: by_name(s[name], column))
    p.relation("NodesInUse", _fields(name=text), kind=OUTPUT)
    p.rule("NodesInUse", ["Pod"], nodes_in_use)
    p.relation("MatchesPod", _fields(selector=S.SELECTOR, namespace=text, pod=S.POD), kind=OUTPUT)
    p.rule("MatchesPod", ["Selectors", "PodByName"], matches_pod, unique=True)
    p.index("MatchesPod", "MatchesPod", "selector", "namespace")
    p.index("MatchesPodAll", "MatchesPod", "selector")
    p.relation("ServiceMatchesPod", _fields(rs=S.SERVICE, pod=S.POD), kind=OUTPUT)
    p.rule("ServiceMatchesPod", ["ServiceByName", "PodByName"], _selects("svc", "ServiceByName"), unique=True)
    p.relation("ReplicaSetMatchesPod", _fields(rs=S.REPLICA_SET, pod=S.POD), kind=OUTPUT)
    p.rule("ReplicaSetMatchesPod", ["ReplicaSetByName", "PodByName"], _selects("rs", "ReplicaSetByName"), unique=True)
    p.relation("IngressToService", _fields(ing=S.INGRESS, svc=S.SERVICE), kind=OUTPUT)
    p.rule("IngressToService", ["Ingress", "ServiceByName"], ingress_to_service)
    # the recursion runs on names; the services themselves join once
    p.relation("Exposes", _fields(ns=text, name=text, to_ns=text, to_name=text))
    p.rule("Exposes", ["IngressToService", "IngressController"], exposes)
    p.relation("PublicName", _fields(ns=text, name=text))
    p.rule("PublicName", ["Service"], public_names)
    p.rule("PublicName", ["PublicName", "Exposes"], public_through_ingress)
    p.relation("IsPublic", _fields(svc=S.SERVICE), kind=OUTPUT)
    p.rule("IsPublic", ["ServiceByName", "PublicName"], is_public)
    return p
