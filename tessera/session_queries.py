"""Registered queries of sessions, commands, feeds, transformers and epochs, each beside its SQL equivalent."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import operators as O
from .plans.commands import Interpreter, Recorder
from .plans.program import INPUT, MULTISET, OUTPUT, STREAM, Program, Transformer
from .plans.session import Session, UpdateError
from .registry import Query, query, table
from .sources import jsonfeed
from .storage import shared_dir
from .streaming import handlers, run_epochs

_NATIONS = T.StructType([T.StructField("n", T.IntegerType())])
_SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey FROM supplier"


def _program(schema: T.StructType) -> Program:
    p = Program()
    p.relation("Supplier", schema, kind=INPUT, key=("s_suppkey",))
    p.relation("Nations", _NATIONS, kind=OUTPUT)
    p.rule("Nations", ["Supplier"], lambda s: s["Supplier"].select(F.col("s_nationkey").alias("n")))
    p.index("ByNation", "Nations", "n")
    return p


def _session(spark: SparkSession, sf_dir: str) -> Session:
    """All suppliers, committed."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    session = Session(spark, _program(rows.schema))
    session.start()
    session.insert("Supplier", rows)
    session.commit(changes=False)
    return session


def _lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    """What commands print."""
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


_EDITS = """
start;
insert Supplier(-1, "new one", 90), insert Supplier(-2, "new two", 91);
insert_or_update Supplier(3, "third", 92);
delete_key Supplier 5;
modify Supplier 7 <- Supplier{.s_nationkey = 93};
insert Supplier(-3, "never", 94), insert Supplier(-1, "again", 95);
commit;
"""
#: Key 1 exists and -1 is inserted twice: the last batch fails as a whole, and an interactive session goes on.
_EDITED = """SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN 'third' ELSE s_name END AS s_name, CASE s_suppkey WHEN 3 THEN 92 WHEN 7 THEN 93 ELSE s_nationkey END AS s_nationkey
  FROM supplier WHERE s_suppkey <> 5 UNION ALL SELECT -1, 'new one', 90 UNION ALL SELECT -2, 'new two', 91"""


@query(_EDITED)
def cmd_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _session(spark, sf_dir)
    list(Interpreter(session, interactive=True).run(_EDITS))
    return session.relation("Supplier")


@query("SELECT CAST(0 AS INTEGER) AS line, 'error: insert: duplicate key in Supplier' AS text UNION ALL SELECT 1, 'bye'")
def cmd_failed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, list(Interpreter(_session(spark, sf_dir), interactive=True).run(_EDITS + "echo bye; exit; echo never;")))


def _printed(commands: str, sql: str, name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _lines(spark, list(Interpreter(_session(spark, sf_dir)).run(commands)))

    run.__name__ = name
    return query(sql)(run)


def _numbered(sql: str, order: str = "encode(text)", first: int = 0) -> str:
    """Lines of text, numbered in an order."""
    return f"SELECT CAST(row_number() OVER (ORDER BY {order}) - 1 + {first} AS INTEGER) AS line, text FROM ({sql})"


_LINE = "SELECT DISTINCT s_nationkey AS n, concat('{.n = ', s_nationkey, '}') AS text FROM supplier"
_CHANGES = f"SELECT n, concat(text, ': -1') AS text FROM ({_LINE}) UNION ALL SELECT 70, '{{.n = 70}}: +1'"
_printed("dump Nations;", _numbered(_LINE, "n"), "cmd_dump")
_printed("query_index ByNation(3);", _numbered(f"{_LINE} WHERE s_nationkey = 3", "n"), "cmd_query_index")
_printed("dump_index ByNation;", _numbered(_LINE, "n"), "cmd_dump_index")
_printed("start; clear Supplier; rollback; start; clear Supplier; commit; dump Nations; echo cleared;", "SELECT CAST(0 AS INTEGER) AS line, 'cleared' AS text", "cmd_clear")
_printed(
    'start; clear Supplier; insert Supplier(1, "a", 70); commit dump_changes;', f"SELECT CAST(0 AS INTEGER) AS line, 'Nations:' AS text UNION ALL {_numbered(_CHANGES, 'n', 1)}", "cmd_dump_changes"
)
_printed("profile cpu on; log_level 3; mssleep 1; profile;", _numbered("SELECT concat('Nations: ', count(DISTINCT s_nationkey), ' rows') AS text FROM supplier UNION ALL SELECT concat('Supplier: ', count(*), ' rows') FROM supplier"), "cmd_profile")


@query(_numbered("""SELECT concat('insert Supplier[Supplier{.s_suppkey = ', s_suppkey, ', .s_name = "', s_name, '", .s_nationkey = ', s_nationkey, '}];') AS text FROM supplier"""))
def cmd_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sorted(Interpreter(_session(spark, sf_dir)).snapshot(), key=str.encode))


@query(f"{_SUPPLIER} WHERE s_suppkey <> 5 UNION ALL SELECT -1, 'new', 90")
def cmd_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls on one session, recorded as commands, and run on another."""
    first, second = _session(spark, sf_dir), _session(spark, sf_dir)
    recorded: list[str] = []
    recorder = Recorder(first, recorded.append)
    recorder.start()
    recorder.insert("Supplier", [(-1, "new", 90)])
    recorder.delete_key("Supplier", [5])
    recorder.commit()
    list(Interpreter(second).run("\n".join(recorded)))
    return second.relation("Supplier")


def _complaint(act: Callable[[], object]) -> str:
    try:
        act()
    except UpdateError as e:
        return str(e)
    return "none"


@query("""SELECT * FROM (VALUES (0, 'no transaction in progress'), (1, 'apply_update: unknown input relation Nope'), (2, 'unknown index Nope'), (3, 'unknown relation Nope'), (4, 'transaction already in progress'),
  (5, 'delete_key: key not found in Supplier'), (6, 'insert: duplicate key in Supplier'), (7, 'delete: key not found or another value in Supplier'), (8, 'index ByNation takes 1 arguments'), (9, 'the session is stopped')) AS t(line, text)""")
def txn_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    found = [_complaint(lambda: s.insert("Supplier", [(1, "a", 1)])), _complaint(lambda: s.insert("Nope", [(1,)])), _complaint(lambda: s.query_index("Nope", 1)), _complaint(lambda: s.relation("Nope"))]
    s.start()
    found += [_complaint(s.start), _complaint(lambda: s.delete_key("Supplier", [-9])), _complaint(lambda: s.insert("Supplier", [(1, "a", 1)])), _complaint(lambda: s.delete("Supplier", [(1, "other", 1)]))]
    found += [line.removeprefix("error: ") for line in Interpreter(s).run("query_index ByNation(1, 2);")]
    s.stop()
    return _lines(spark, [*found, _complaint(s.commit)])


@query(f"{_SUPPLIER} WHERE s_suppkey % 2 = 0")
def txn_input_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An input relation as an open transaction sees it."""
    s = _session(spark, sf_dir)
    s.start()
    s.delete_key("Supplier", table(spark, sf_dir, "supplier").where("s_suppkey % 2 <> 0").select("s_suppkey"))
    return s.input_data("Supplier")


@query(f"{_SUPPLIER} UNION ALL SELECT -7, 'from a file' || chr(10), 1")
def cmd_file_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A string value read from a file of the driver's."""
    session = _session(spark, sf_dir)
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, "name.txt")
        path.write_text("from a file\n")
        list(Interpreter(session).run(f'start; insert Supplier(-7, %"{path}", 1); commit;'))
    return session.relation("Supplier")


@query(_SUPPLIER)
def txn_dump_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows handed to a callback, all of them; a second callback stops after the first."""
    session, seen, few = _session(spark, sf_dir), [], []
    session.dump_table("Supplier", lambda row, weight: seen.append(tuple(row)) or weight == 1)
    session.dump_table("Supplier", lambda row, weight: few.append(row) or False)
    return spark.createDataFrame(seen if len(few) == 1 else [], session.program.relations["Supplier"].schema)


@query("SELECT n_name AS nation, CAST(a.w * b.w AS BIGINT) AS w FROM nation JOIN (SELECT c_nationkey AS k, count(*) AS w FROM customer GROUP BY k) a ON n_nationkey = a.k JOIN (SELECT s_nationkey AS k, count(*) AS w FROM supplier GROUP BY k) b ON a.k = b.k")
def op_weighted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = O.consolidate(O.weighted(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))))
    suppliers = O.consolidate(O.weighted(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("j"))))
    named = O.weighted(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    joined = O.equi_join(named, O.equi_join(customers, suppliers, {"k": "j"}), {"n_nationkey": "k"})
    return joined.select(F.col("n_name").alias("nation"), F.col("__w").alias("w"))


@query("SELECT c_custkey AS c, CAST(w AS BIGINT) AS w FROM customer JOIN (SELECT s_nationkey AS k, count(*) AS w FROM supplier WHERE s_acctbal > 0 GROUP BY k) ON c_nationkey = k")
def op_weighted_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = O.weighted(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), "c_nationkey"))
    suppliers = O.weighted(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_nationkey"))
    return O.semijoin(customers, suppliers, {"c_nationkey": "s_nationkey"}).select("c", F.col("__w").alias("w"))


@query("WITH RECURSIVE e AS (SELECT p_partkey // 4 AS a, p_partkey AS d FROM part WHERE p_partkey >= 4 AND p_partkey % 10 <> 3), anc(a, d) AS (SELECT a, d FROM e UNION SELECT e.a, anc.d FROM e JOIN anc ON e.d = anc.a) SELECT a, d FROM anc")
def recursion_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursive relation after rows under it were deleted."""
    pair = T.StructType([T.StructField("a", T.LongType()), T.StructField("d", T.LongType())])
    p = Program()
    p.relation("Parent", pair, kind=INPUT)
    p.relation("Ancestor", pair, kind=OUTPUT)
    p.rule("Ancestor", ["Parent"], lambda s: s["Parent"])
    p.rule("Ancestor", ["Parent", "Ancestor"], lambda s: O.equi_join(s["Parent"].toDF("p", "c"), s["Ancestor"], {"c": "a"}).select(F.col("p").alias("a"), "d"))
    s = Session(spark, p)
    rows = table(spark, sf_dir, "part").where("p_partkey >= 4").select(F.expr("p_partkey div 4").alias("a"), F.col("p_partkey").alias("d"))
    s.start()
    s.insert("Parent", rows)
    s.commit(changes=False)
    s.start()
    s.delete("Parent", rows.where("d % 10 = 3"))
    s.commit()
    return s.relation("Ancestor")


@query("SELECT s_nationkey AS k, CAST(count(*) AS BIGINT) AS w FROM supplier GROUP BY s_nationkey")
def txn_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multiset relation keeps weights."""
    p = Program()
    p.relation("Bag", T.StructType([T.StructField("k", T.IntegerType())]), kind=INPUT, caching=MULTISET)
    s = Session(spark, p)
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    s.start()
    s.insert("Bag", rows)
    s.insert("Bag", rows)
    s.delete("Bag", rows)
    s.commit()
    return O.consolidate(s.input_data("Bag")).withColumnRenamed("__w", "w")


_TAGGED = "SELECT s_suppkey AS id, s_nationkey AS nation FROM supplier"


@query(f"""SELECT id, CASE WHEN id % 2 = 0 THEN 'a=' || nation || ',z=9' ELSE 'a=' || nation || ',b=' || id END AS m, CASE WHEN id % 2 = 0 THEN concat(id + 1000000, ',', id + 2000000) ELSE concat(id, ',', id + 1000000) END AS s,
  CASE WHEN id % 2 = 0 THEN '7' ELSE '1,2' END AS v FROM ({_TAGGED})""")
def txn_mutators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """modify: map entries are set or deleted, set members toggled, vectors replaced."""
    entries = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.LongType())]))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("m", entries), T.StructField("s", T.ArrayType(T.LongType()), metadata={"kind": "set"}), T.StructField("v", T.ArrayType(T.LongType()))])
    p = Program()
    p.relation("Tagged", schema, kind=INPUT, key=("id",))
    k, pair = F.col("s_suppkey"), lambda a, b: F.struct(F.lit(a).alias("key"), b.cast("long").alias("value"))
    rows = table(spark, sf_dir, "supplier").select(
        k.alias("id"), F.array(pair("a", F.col("s_nationkey")), pair("b", k)).alias("m"), F.array(k, k + 1000000).alias("s"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long")).alias("v")
    )
    s = Session(spark, p)
    s.start()
    s.insert("Tagged", rows)
    gone, new = pair("b", F.lit(None)), pair("z", F.lit(9))
    even = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select("s_suppkey")
    s.mutate("Tagged", even, {"m": F.array(gone, new), "s": F.array(F.col("id"), F.col("id") + 2000000), "v": F.array(F.lit(7).cast("long"))})
    s.commit(changes=False)
    shown = F.array_join(F.transform("m", lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return s.relation("Tagged").select("id", shown.alias("m"), text("s").alias("s"), text("v").alias("v"))


# --- feeds ----------------------------------------------------------------------------------------------------------------


@query("SELECT '_' || s_suppkey AS _uuid, s_name AS name, CAST(CASE WHEN s_suppkey % 3 = 1 THEN 99 ELSE s_nationkey END AS BIGINT) AS nation, CASE WHEN s_suppkey % 3 = 1 THEN '' ELSE '1,2' END AS tags FROM supplier WHERE s_suppkey % 3 < 2")
def feed_to_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table updates as JSON, applied as transactions: inserts, then changes of some rows and deletions of others."""
    schema = T.StructType([T.StructField("_uuid", T.StringType()), T.StructField("name", T.StringType()), T.StructField("nation", T.LongType()), T.StructField("tags", T.ArrayType(T.LongType()))])
    p = Program()
    p.relation("Port", schema, kind=INPUT, key=("_uuid",))
    s = Session(spark, p)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey").collect()
    insert = {f"_{r[0]}": {"insert": {"name": r[1], "nation": r[2], "tags": ["set", [1, 2]]}} for r in rows}
    change = {f"_{r[0]}": {"modify": {"nation": 99, "tags": ["set", []]}} for r in rows if r[0] % 3 == 1}
    gone = {f"_{r[0]}": {"old": {"name": r[1]}} for r in rows if r[0] % 3 == 2}
    for part in (insert, change, gone):
        s.start()
        jsonfeed.apply(s, jsonfeed.updates_from_json("", json.dumps({"port": part})))
        s.commit(changes=False)
    return s.relation("Port").withColumn("tags", F.array_join(F.col("tags").cast("array<string>"), ","))


@query("""SELECT CASE s_suppkey % 3 WHEN 0 THEN concat('{"op":"insert","table":"Sup","row":{"name":"', s_name, '"}}')
  WHEN 1 THEN concat('{"op":"delete","table":"Sup","where":[["_uuid","==",["uuid","', s_suppkey, '"]]]}')
  ELSE concat('{"op":"update","table":"Sup","where":[["_uuid","==",["uuid","', s_suppkey, '"]]],"row":{"name":"', upper(s_name), '"}}') END AS statement FROM supplier""")
def feed_from_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted changes as JSON statements."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("_uuid"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 3).alias("k"))
    plus = O.weighted(rows.where("k = 0").unionByName(rows.where("k = 2").withColumn("name", F.upper("name"))).drop("k"))
    return jsonfeed.changes_to_json("Sup", O.union(plus, O.negate(O.weighted(rows.where("k > 0").drop("k")))))


# --- transformers, delays and streams inside programs ---------------------------------------------------------------------


@query("SELECT c_nationkey AS k, min(c_custkey) AS least FROM customer GROUP BY c_nationkey")
def program_transformer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function from tables to tables as part of a program, with a rule on top."""
    pair = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("least", T.LongType())])
    p = Program()
    p.relation("Customer", T.StructType([T.StructField("c", T.LongType()), T.StructField("n", T.IntegerType())]), kind=INPUT)
    p.relation("Least", pair)
    p.relation("Out", pair, kind=OUTPUT)
    p.transformers.append(Transformer(("Customer",), ("Least",), lambda s: {"Least": s["Customer"].groupBy(F.col("n").alias("k")).agg(F.min("c").alias("least"))}))
    p.rule("Out", ["Least"], lambda s: s["Least"])
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n"))
    return p.evaluate(spark, {"Customer": rows})["Out"]


_USERS = T.StructType([T.StructField("u", T.LongType())])


def _epochs(spark: SparkSession, sf_dir: str, p: Program, relation: str, count: int, value: str = "user_id") -> Session:
    """A session with one commit for each epoch of the events."""
    s = Session(spark, p)
    events = table(spark, sf_dir, "events")
    for epoch in range(count):
        s.start()
        s.insert(relation, events.where(F.col("event_id") % 5 == epoch).select(F.expr(value).cast("long").alias("u")).distinct())
        s.commit(changes=False)
    return s


@query("SELECT DISTINCT user_id AS u FROM events WHERE event_id % 5 = 2 AND user_id IN (SELECT user_id FROM events WHERE event_id % 5 = 1)")
def program_delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule that reads a stream of this epoch and the same stream one epoch before."""
    p = Program()
    p.relation("Seen", _USERS, kind=INPUT, caching=STREAM)
    p.relation("Again", _USERS, kind=OUTPUT)
    p.rule("Again", ["Seen", "Seen-1"], lambda s: O.semijoin(s["Seen"], s["Seen-1"], {"u": "u"}))
    return _epochs(spark, sf_dir, p, "Seen", 3).relation("Again")


@query("SELECT DISTINCT user_id AS u, c_name AS name FROM events JOIN customer ON user_id = c_custkey WHERE event_id % 5 = 2")
def program_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream joined with a relation inside a program: only the epoch's rows count."""
    p = Program()
    p.relation("Seen", _USERS, kind=INPUT, caching=STREAM)
    p.relation("Customer", T.StructType([T.StructField("c", T.LongType()), T.StructField("name", T.StringType())]), kind=INPUT)
    p.relation("Named", T.StructType([T.StructField("u", T.LongType()), T.StructField("name", T.StringType())]), kind=OUTPUT)
    p.rule("Named", ["Seen", "Customer"], lambda s: O.stream_join(s["Seen"], s["Customer"], {"u": "c"}).select("u", "name"))
    s = Session(spark, p)
    events = table(spark, sf_dir, "events")
    s.start()
    s.insert("Customer", table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_name").alias("name")))
    s.commit(changes=False)
    for epoch in range(3):
        s.start()
        s.insert("Seen", events.where(F.col("event_id") % 5 == epoch).select(F.col("user_id").alias("u")))
        s.commit(changes=False)
    return s.relation("Named")


@query("SELECT event_type AS t, CAST(count(DISTINCT user_id) AS BIGINT) AS n FROM events GROUP BY event_type")
def stream_run_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A structured stream whose micro-batches are transactions; an aggregate of the relation they fill."""
    kept = T.StructType([T.StructField("t", T.StringType()), T.StructField("u", T.LongType())])
    p = Program()
    p.relation("Event", kept, kind=INPUT)
    p.relation("Users", T.StructType([T.StructField("t", T.StringType()), T.StructField("n", T.LongType())]), kind=OUTPUT)
    p.rule("Users", ["Event"], lambda s: O.aggregate(s["Event"], ["t"], ["u"], n=F.count(F.lit(1))))
    s = Session(spark, p)
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/event[s].parquet")
    rows = source.select(F.col("event_type").alias("t"), F.col("user_id").alias("u"))
    run_epochs(rows, s, "Event", f"{shared_dir(spark)}/epochs-{uuid.uuid4().hex}").awaitTermination()
    return s.relation("Users")


@query("SELECT n, CAST(w AS BIGINT) AS w FROM (SELECT DISTINCT s_nationkey AS n, -1 AS w FROM supplier UNION ALL SELECT 70, 1)")
def handler_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a commit through chained handlers, the last one on its own thread."""
    session, seen = _session(spark, sf_dir), []
    session.start()
    session.clear("Supplier")
    session.insert("Supplier", [(1, "a", 70)])
    with handlers.Threaded(lambda name, row, weight: seen.append((row.n, weight))) as last:
        handlers.dispatch(session.commit(), handlers.chained(handlers.null, handlers.only({"Nations"}, last)))
    return spark.createDataFrame(seen, "n int, w long")


@query("SELECT * FROM (VALUES (0, 'Timestamp: #'), (1, 'said # times')) AS t(line, text)")
def cmd_misc(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = Interpreter(_session(spark, sf_dir)).run("# a comment\nlog_level 1; mssleep 2; timestamp; echo said 2 times; exit; echo never;")
    return _lines(spark, [re.sub("[0-9]+", "#", line) for line in lines])


_WEIGHED = T.StructType([T.StructField("u", T.LongType()), T.StructField("w", T.LongType())])
_EPOCH = "SELECT DISTINCT user_id AS u FROM events WHERE event_id % 5 ="


_PLACE = "SELECT DISTINCT user_id * 100 + CAST(floor(value) AS BIGINT) % 100 AS u FROM events WHERE event_id % 5 ="


@query(f"SELECT u, CAST(sum(w) AS BIGINT) AS w FROM (SELECT u, 1 AS w FROM ({_PLACE} 2) UNION ALL SELECT u, -1 FROM ({_PLACE} 1)) GROUP BY u HAVING sum(w) <> 0")
def program_differentiate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule that gives what a stream gained and lost since the epoch before."""
    p = Program()
    p.relation("Seen", _USERS, kind=INPUT, caching=STREAM)
    p.relation("Change", _WEIGHED, kind=OUTPUT)
    p.rule("Change", ["Seen", "Seen-1"], lambda s: O.delta(s["Seen-1"], s["Seen"]).withColumnRenamed("__w", "w"), negated=["Seen-1"])
    return _epochs(spark, sf_dir, p, "Seen", 3, "user_id * 100 + floor(value) % 100").relation("Change")


@query(f"SELECT u % 3 AS u, count(*) AS w FROM ({_EPOCH} 2) GROUP BY u % 3")
def program_stream_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule that aggregates an epoch of a stream."""
    p = Program()
    p.relation("Seen", _USERS, kind=INPUT, caching=STREAM)
    p.relation("Counts", _WEIGHED, kind=OUTPUT)
    p.rule("Counts", ["Seen"], lambda s: O.aggregate(s["Seen"].select("u", (F.col("u") % 3).alias("k")), ["k"], ["u"], w=F.count(F.lit(1))).select(F.col("k").alias("u"), "w"), negated=["Seen"])
    return _epochs(spark, sf_dir, p, "Seen", 3).relation("Counts")


@query(f"SELECT c_custkey AS u, CAST(c_nationkey AS BIGINT) AS w FROM customer WHERE c_custkey IN ({_EPOCH} 2)")
def program_stream_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a relation that an epoch of a stream names."""
    p = Program()
    p.relation("Seen", _USERS, kind=INPUT, caching=STREAM)
    p.relation("Customer", _WEIGHED, kind=INPUT)
    p.relation("Named", _WEIGHED, kind=OUTPUT)
    p.rule("Named", ["Seen", "Customer"], lambda s: O.stream_semijoin(s["Seen"].toDF("seen"), s["Customer"], {"seen": "u"}, keep_state=True))
    s = Session(spark, p)
    events = table(spark, sf_dir, "events")
    s.start()
    s.insert("Customer", table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("u"), F.col("c_nationkey").cast("long").alias("w")))
    s.commit(changes=False)
    s.start()
    s.insert("Seen", events.where("event_id % 5 = 2").select(F.col("user_id").alias("u")))
    s.commit(changes=False)
    return s.relation("Named")


@query(f"{_SUPPLIER} UNION ALL SELECT -s_suppkey - 1, s_name, s_nationkey + 50 FROM supplier")
def txn_added_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit of new rows only: the state after its changes."""
    session = _session(spark, sf_dir)
    rows = session.relation("Supplier")
    session.start()
    session.insert("Supplier", rows.select((-F.col("s_suppkey") - 1).alias("s_suppkey"), "s_name", (F.col("s_nationkey") + 50).alias("s_nationkey")))
    session.commit()
    return session.relation("Supplier")


@query("SELECT DISTINCT s_nationkey + 50 AS n, CAST(1 AS BIGINT) AS w FROM supplier")
def txn_added_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What such a commit adds to an output."""
    session = _session(spark, sf_dir)
    rows = session.relation("Supplier")
    session.start()
    session.insert("Supplier", rows.select((-F.col("s_suppkey") - 1).alias("s_suppkey"), "s_name", (F.col("s_nationkey") + 50).alias("s_nationkey")))
    return session.commit()["Nations"].withColumnRenamed("__w", "w")
