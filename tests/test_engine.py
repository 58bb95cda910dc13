import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import operators as O
from tessera import queries
from tessera import types as S
from tessera.cluster import program as cluster_program
from tessera.functions import maps, numeric, strings, vectors
from tessera.plans.commands import Interpreter, ParseError, Parser, Struct
from tessera.plans.fixpoint import fixpoint
from tessera.plans.program import INPUT, MULTISET, OUTPUT, STREAM, Program
from tessera.plans.session import Session, UpdateError
from tessera.sources import updates_from_json
from tessera.sources.jsonfeed import FeedError
from tessera.storage import drop, written

LONG = T.StructType([T.StructField("x", T.LongType())])
PAIR = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
SCRIPT = """
start;
insert Selectors(LabelSelector{[("app","web")], []});
insert_or_update Pod[Pod{ObjectMeta{"a", "p1", [("app","web")], []}, PodSpec{"n0"}, PodStatus{Running}}],
insert_or_update Pod[Pod{ObjectMeta{"b", "p2", [("app","web"),("x","y")], []}, PodSpec{"n1"}, PodStatus{Running}}];
insert_or_update Service[Service{ObjectMeta{"a", "back", [], []}, ServiceSpec{ClusterIP, LabelSelector{[("app","web")], []}}, ServiceStatus{}}];
insert_or_update Service[Service{ObjectMeta{"a", "gate", [], []}, ServiceSpec{LoadBalancer, LabelSelector{[("app","gate")], []}}, ServiceStatus{}}];
insert_or_update Ingress[Ingress{ObjectMeta{"a", "gate", [], []}, IngressSpec{"std", [IngressRule{"h.example", "back"}]}, IngressStatus{}}];
insert IngressController("a", "gate", "std");
commit;
dump NodesInUse;
echo done;
"""


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_strings(spark):
    lit = F.lit
    assert one(spark, strings.split(lit("ab"), "")) == ["", "a", "b", ""]
    assert one(spark, strings.length(lit("é"))) == 2
    assert one(spark, strings.trim(lit("  a\t"))) == "a"
    assert one(spark, strings.replace(lit("ab"), "", "-")) == "-a-b-"
    assert one(spark, strings.parse_dec_u64(lit("18446744073709551615"))) == 2**64 - 1
    assert one(spark, strings.parse_dec_u64(lit("18446744073709551616"))) is None
    assert one(spark, strings.parse_dec_i64(lit(" 1"))) is None
    assert one(spark, strings.hex_of(lit(-1), 8)) == "ff"
    assert one(spark, strings.from_utf16(strings.encode_utf16(lit("a😀")))) == "a😀"
    assert one(spark, strings.from_utf16(F.array(lit(0xD800)))) is None


@pytest.mark.parametrize("bits,signed", [(8, False), (8, True), (16, True), (32, False), (32, True), (64, False), (64, True)])
def test_pow_wraps(spark, bits, signed):
    want = pow(7, 41, 1 << bits)
    want = want - (1 << bits) if signed and want >= 1 << (bits - 1) else want
    assert int(one(spark, numeric.pow32(F.lit(7), F.lit(41), bits, signed))) == want


@pytest.mark.parametrize("bits,signed", [(8, True), (32, False), (64, False), (64, True)])
def test_pow_of_large_numbers(spark, bits, signed):
    bases, exponents = [-3, 2**63 - 1, 2**31 - 1, 10**18 + 7], [0, 1, 3, 2_000_000_000, 2**32 - 1]
    rows = [(b, e) for b in bases for e in exponents] + [(None, 1), (1, None)]
    got = spark.createDataFrame(rows, "b long, e long").select("b", "e", numeric.pow32(F.col("b"), F.col("e"), bits, signed).cast("string").alias("p")).collect()
    for b, e, p in got:
        want = None if b is None or e is None else pow(b, e, 1 << bits)
        assert p == (None if want is None else str(want - (1 << bits) if signed and want >= 1 << (bits - 1) else want))


def test_rules_that_use_a_relation_twice(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(30, 5), (40, 41)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    body = lambda s: s["path"].toDF("x", "y").join(s["path"], F.col("y") == F.col("a")).select(F.col("x").alias("a"), "b")
    got = {tuple(r) for r in fixpoint({"path": edges}, [("path", ["path"], body)])["path"].collect()}
    want = set(pairs)
    while True:
        more = want | {(a, d) for a, b in want for c, d in pairs if b == c}
        if more == want:
            break
        want = more
    assert got == want and len(fixpoint({"path": edges.limit(0)}, [("path", ["path"], body)])["path"].collect()) == 0


def test_weights_are_multiplied(spark):
    left = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "x long, __w long")
    right = spark.createDataFrame([(1, 5), (1, -1), (2, 1), (2, -1)], "y long, __w long")
    assert values(O.consolidate(O.equi_join(left, right, {"x": "y"}).drop("y"))) == [(1, 8)]
    assert values(O.semijoin(left, right, {"x": "y"})) == [(1, 8)]


@pytest.mark.parametrize("seed", range(3))
def test_selected_pods_against_every_pair(spark, seed):
    """The label index against the predicate on all pairs."""
    import random

    r = random.Random(seed)
    keys, vals = "abc", "xyz"
    pods = [((f"n{r.randrange(3)}", f"p{i}", sorted({k: (k, r.choice(vals)) for k in keys if r.random() < 0.6}.values()), []), (f"node{i % 2}",), ("Running",)) for i in range(40)]

    def requirement():
        op = r.choice(["In", "NotIn", "Exists", "DoesNotExist"])
        return r.choice(keys), op, [r.choice(vals) for _ in range(r.randrange(3))] if op in ("In", "NotIn") else []

    selectors = [([], [])] + [(sorted({k: (k, r.choice(vals)) for k in keys if r.random() < 0.4}.values()), [requirement() for _ in range(r.choice([0, 0, 1, 2]))]) for _ in range(25)]
    owners = [((f"n{r.randrange(3)}", f"s{i}", [], []), ("ClusterIP", s if i else None)) for i, s in enumerate(selectors)]

    def matches(selector, labels):
        if selector is None:
            return False
        held = dict(labels)
        ok = {"In": lambda k, v: held.get(k) in v, "NotIn": lambda k, v: held.get(k) not in v, "Exists": lambda k, v: k in held, "DoesNotExist": lambda k, v: k not in held}
        return all(held.get(k) == v for k, v in selector[0]) and all(ok[op](k, v) for k, op, v in selector[1])

    state = cluster_program().evaluate(spark, {
        "Pod": spark.createDataFrame(pods, S.POD), "Service": spark.createDataFrame(owners, S.SERVICE), "ReplicaSet": spark.createDataFrame([], S.REPLICA_SET), "Ingress": spark.createDataFrame([], S.INGRESS),
        "IngressController": spark.createDataFrame([], S.CONTROLLER), "Selectors": spark.createDataFrame([(s,) for s in selectors[1:]], T.StructType([T.StructField("s", S.SELECTOR)])).distinct(),
    })
    got = sorted((x["rs"]["meta"]["name"], x["pod"]["meta"]["name"]) for x in state["ServiceMatchesPod"].collect())
    assert got == sorted((o[0][1], p[0][1]) for o in owners for p in pods if o[0][0] == p[0][0] and matches(o[1][1], p[0][2]))
    distinct = {json.dumps(s): s for s in selectors}.values()
    assert state["MatchesPod"].count() == sum(matches(s, p[0][2]) for s in distinct for p in pods)


def labelled(spark, n):
    """Pods with a label, some of them twice, in two namespaces."""
    pods = [((f"n{i % 2}", f"p{i}", [("segment", "ab"[i % 3 > 0])], []), (f"node{i % 2}",), ("Running",)) for i in range(n)]
    return spark.createDataFrame(pods + pods[:3], S.POD)


def indexed(spark):
    p = cluster_program()
    p.rules = [r for r in p.rules if r.head in p.needed(["MatchesPod"])]
    s = Session(spark, p)
    s.start()
    s.insert("Pod", labelled(spark, 12).distinct())
    s.insert("Selectors", [(([("segment", "a")], []),), (([], [("segment", "NotIn", ["a"])]),)])
    s.commit(changes=False)
    return s


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_look_up_in_one_namespace_broadcasts_no_pods(spark):
    found = indexed(spark).query_index("MatchesPod", ([("segment", "a")], []), "n0")
    assert "Broadcast" not in plan(found)
    assert sorted(r["pod"]["meta"]["name"] for r in found.collect()) == ["p0", "p6"]


def test_index_look_up_in_all_namespaces_broadcasts_no_pods(spark):
    s = indexed(spark)
    names = lambda df: sorted(r["pod"]["meta"]["name"] for r in df.collect())
    found = s.query_index("MatchesPodAll", ([("segment", "a")], []))
    assert "Broadcast" not in plan(found)
    assert names(found) == ["p0", "p3", "p6", "p9"]
    assert names(s.query_index("MatchesPodAll", ([], [("segment", "NotIn", ["a"])]))) == sorted(f"p{i}" for i in range(12) if i % 3)
    assert s.query_index("MatchesPodAll", ([], [])).count() == 12 and s.query_index("MatchesPodAll", None).count() == 0


def test_pairs_of_selectors_and_pods_come_once_and_are_not_compared(spark):
    """Repeated rows, values that are listed twice and a pod that meets two of the listed values."""
    selectors = [([], [("segment", "In", ["a", "a", None, "b"])]), ([("segment", "a")], []), ([], [("segment", "Exists", [])]), ([], [])]
    sets = [((f"n{i % 2}", f"r{i}", [], []), (selectors[i % 4],)) for i in range(8)]
    inputs = {"Pod": labelled(spark, 12), "ReplicaSet": spark.createDataFrame(sets + sets[:5], S.REPLICA_SET)}
    found = cluster_program().evaluate(spark, inputs, only=["ReplicaSetMatchesPod"])["ReplicaSetMatchesPod"]
    assert "Aggregate" not in "".join(plan(found).split("\n")[:4])  # not made distinct once more
    got = sorted((r["rs"]["meta"]["name"], r["pod"]["meta"]["name"]) for r in found.collect())
    assert got == sorted((f"r{i}", f"p{j}") for i in range(8) for j in range(12) if i % 2 == j % 2 and (i % 4 != 1 or j % 3 == 0))


def test_commits_of_new_rows_follow_as_changes(spark):
    """Random insertions and deletions, with recursion, a join of a relation with itself, a bag and a negation, against a
    session that evaluates everything anew."""
    import random

    two = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def made(negates):
        p = Program()
        p.relation("E", two, kind=INPUT)
        p.relation("Path", two, kind=OUTPUT)
        p.rule("Path", ["E"], lambda s: s["E"])
        p.rule("Path", ["E", "Path"], lambda s: s["E"].toDF("x", "y").join(s["Path"], F.col("y") == F.col("a")).select(F.col("x").alias("a"), "b"))
        p.relation("Two", two, kind=OUTPUT)
        p.rule("Two", ["E"], lambda s: s["E"].toDF("x", "y").join(s["E"], F.col("y") == F.col("a")).select(F.col("x").alias("a"), "b"))
        p.relation("Bag", LONG, distinct=False)
        p.rule("Bag", ["E"], lambda s: s["E"].select(F.col("a").alias("x")))
        p.relation("Starts", LONG, kind=OUTPUT)
        p.rule("Starts", ["Bag"], lambda s: s["Bag"])
        if negates:
            p.relation("Ends", LONG, kind=OUTPUT)
            p.rule("Ends", ["E"], lambda s: O.antijoin(s["E"].select(F.col("b").alias("x")), s["E"], {"x": "a"}).distinct(), negated=["E"])
        return p

    for negates in (False, True):
        r, session = random.Random(negates), Session(spark, made(negates))
        rows, steps = set(), 0
        for round_ in range(5):
            session.start()
            new = {(r.randrange(12), r.randrange(12)) for _ in range(4)}
            session.insert("E", sorted(new))
            rows |= new
            if round_ == 3:
                gone = sorted(rows)[:2]
                session.delete("E", gone)
                rows -= set(gone)
            before = {n: values(session.relation(n)) for n in ("Path", "Two", "Starts")}
            changes = session.commit()
            steps += session.advanced > 0
            whole = session.program.evaluate(spark, {"E": spark.createDataFrame(sorted(rows), two)})
            for name in ("Path", "Two", "Starts", "Bag", *(["Ends"] if negates else [])):
                assert values(session.relation(name)) == values(whole[name])
                if name in before:
                    old, new_ = set(before[name]), set(values(whole[name]))
                    assert sorted(map(tuple, changes[name].collect()) if name in changes else []) == sorted([(*x, 1) for x in new_ - old] + [(*x, -1) for x in old - new_])
        assert steps == (0 if negates else 3)  # not the first one, nor the one with deletions


def test_delayed_relations_that_feed_themselves(spark):
    p = Program()
    p.relation("Now", LONG, kind=INPUT, caching=STREAM)
    p.relation("Ever", LONG, kind=OUTPUT)
    p.rule("Ever", ["Now"], lambda s: s["Now"])
    p.rule("Ever", ["Ever-1"], lambda s: s["Ever-1"])
    s = Session(spark, p)
    for i in range(4):
        s.start()
        s.insert("Now", [(i,)])
        s.commit()
    assert values(s.relation("Ever")) == [(0,), (1,), (2,), (3,)] and values(s.relation("Now")) == [(3,)]
    assert values(s.relation("Ever", delay=2)) == [(0,), (1,)]


def test_vectors_and_maps(spark):
    lit = F.lit
    assert one(spark, numeric.range_vec(lit(0), lit(5), lit(2))) == [0, 2, 4]
    assert one(spark, numeric.range_vec(lit(5), lit(0), lit(-2))) == [5, 3, 1]
    assert one(spark, numeric.range_vec(lit(0), lit(5), lit(0))) == []
    assert len(one(spark, vectors.zip_vectors(F.array(lit(1), lit(2)), F.array(lit(3))))) == 1
    m = maps.from_vec(F.array(F.struct(lit("a").alias("_1"), lit(1).alias("_2")), F.struct(lit("a").alias("_1"), lit(2).alias("_2"))))
    assert one(spark, maps.get(m, lit("a"))) == 2


def test_aggregate_of_nothing_has_no_row(spark):
    empty = spark.createDataFrame([], LONG)
    assert O.aggregate(empty, [], ["x"], n=F.count(F.lit(1))).count() == 0


def test_antijoin_treats_missing_values_as_equal(spark):
    a = spark.createDataFrame([(None,), (1,)], LONG)
    assert values(O.antijoin(a, a.toDF("y"), {"x": "y"})) == []


def test_weights(spark):
    d = O.union(O.weighted(spark.createDataFrame([(1,), (2,)], LONG)), O.negate(O.weighted(spark.createDataFrame([(2,), (3,)], LONG))))
    assert values(O.consolidate(d)) == [(1, 1), (3, -1)]
    assert values(O.distinct(d)) == [(1,), (3,)]


def chain():
    p = Program()
    p.relation("R", PAIR, kind=INPUT, key=("k",))
    p.relation("S", LONG, kind=INPUT)
    p.relation("M", LONG, kind=INPUT, caching=MULTISET)
    p.relation("Out", PAIR, kind=OUTPUT)
    p.rule("Out", ["R", "S"], lambda s: O.semijoin(s["R"], s["S"], {"k": "x"}))
    p.index("ByKey", "Out", "k")
    return p


def test_transactions(spark):
    s = Session(spark, chain())
    with pytest.raises(UpdateError, match="no transaction in progress"):
        s.insert("R", [(1, "a")])
    s.start()
    with pytest.raises(UpdateError):
        s.start()
    with pytest.raises(UpdateError, match="unknown input relation Q"):
        s.insert("Q", [(1, "a")])
    s.insert("R", [(1, "a"), (2, "b")])
    s.insert("S", [(1,), (1,)])
    s.insert("M", [(5,)])
    s.insert("M", [(5,)])
    changes = s.commit()
    assert values(changes["Out"]) == [(1, "a", 1)] and s.epoch == 2
    s.start()
    for bad in (lambda: s.insert("R", [(1, "a")]), lambda: s.delete("R", [(1, "z")]), lambda: s.delete_key("R", [9]), lambda: s.insert_or_update("S", [(1,)]), lambda: s.modify("R", [9], {"v": F.lit("q")})):
        with pytest.raises(UpdateError):
            bad()
    s.modify("R", [1], {"v": F.lit("c")})
    s.delete("S", [(7,)])
    assert values(s.commit()["Out"]) == [(1, "a", -1), (1, "c", 1)]
    assert values(s.query_index("ByKey", 1)) == [(1, "c")]
    assert values(s.relation("Out", delay=1)) == [(1, "a")]
    s.start()
    s.clear("R")
    s.rollback()
    s.start()
    assert s.commit() == {} and s.epoch == 3
    assert values(s.relation("R")) == [(1, "c"), (2, "b")]


def test_recursion_with_deletion(spark):
    two = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    p = Program()
    p.relation("Parent", two, kind=INPUT)
    p.relation("Ancestor", two, kind=OUTPUT)
    p.rule("Ancestor", ["Parent"], lambda s: s["Parent"])
    p.rule("Ancestor", ["Parent", "Ancestor"], lambda s: s["Parent"].toDF("p", "c").join(s["Ancestor"], F.col("c") == F.col("a")).select(F.col("p").alias("a"), "b"))
    s = Session(spark, p)
    s.start()
    s.insert("Parent", [("A", "B"), ("B", "C"), ("B", "D"), ("A", "E")])
    s.commit()
    assert {"".join(r) for r in values(s.relation("Ancestor"))} == {"AB", "BC", "BD", "AE", "AC", "AD"}
    s.start()
    s.delete("Parent", [("A", "B")])
    s.commit()
    assert {"".join(r) for r in values(s.relation("Ancestor"))} == {"BC", "BD", "AE"}


@pytest.mark.parametrize("chunk", [1024, 3])
def test_unrelated_pairs_of_any_order(spark, monkeypatch, chunk):
    """Nodes with several parents and several topmost ancestors, against every pair; no pair is shuffled."""
    import random

    monkeypatch.setattr(queries, "CHUNK", chunk)
    r = random.Random(chunk)
    over = {i: {p for p in r.sample(range(i), min(i, r.choice([0, 1, 1, 2])))} for i in range(30)}
    above = {}
    for i in range(30):
        above[i] = over[i].union(*[above[p] for p in over[i]])
    rows = spark.createDataFrame([(a, d) for d in above for a in above[d]], "a long, d long")
    found = queries.unrelated({"Ancestor": rows})
    assert sorted(tuple(x) for x in found.collect()) == sorted((x, y) for x in above for y in above if x != y and above[x] & above[y] and x not in above[y] and y not in above[x])
    joined = plan(found).split("SortMergeJoin")[0]
    assert "Exchange" not in joined and "Aggregate" not in joined


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_recursion_negation_shuffles_no_pair(spark):
    above_join = plan(queries.QUERIES["recursion_negation"](spark, "/root/testdata/sf0.01")).split("SortMergeJoin")[0]
    assert "Exchange" not in above_join and "Aggregate" not in above_join


def test_unrelated_pairs_are_listed_and_not_judged_one_by_one(spark):
    """A root with two chains below it and nulls: nodes meet groups as arrays, and only a node's kin is taken out of them."""
    chains = {2: 1, 4: 2, 6: 4, 3: 1, 5: 3}
    above = lambda n: {chains[n]} | above(chains[n]) if n in chains else set()
    rows = spark.createDataFrame([(a, d) for d in chains for a in above(d)] + [(None, 4), (7, None)], "a long, d long")
    found = queries.unrelated({"Ancestor": rows})
    assert sorted(tuple(x) for x in found.collect()) == sorted((x, y) for left in ((2, 4, 6), (3, 5)) for x in left for y in {2, 3, 4, 5, 6} - set(left))
    head, joined = plan(found).split("SortMergeJoin")[:2]
    assert "Generate explode" in head and "Filter" not in head
    assert "array_contains" not in head and "array_contains" not in joined.split("\n")[0]


def test_input_relation_in_recursion_is_refused():
    p = Program()
    p.relation("R", LONG, kind=INPUT)
    with pytest.raises(ValueError):
        p.rule("R", ["R"], lambda s: s["R"])
    p.relation("A", LONG)
    p.rule("A", ["A"], lambda s: s["A"], negated=["A"])
    with pytest.raises(ValueError, match="negation"):
        p.check()


def test_cluster_script(spark):
    s = Session(spark, cluster_program())
    assert list(Interpreter(s).run(SCRIPT)) == ['{.name = "n0"}', '{.name = "n1"}', "done"]
    assert sorted(r["svc"]["meta"]["name"] for r in s.relation("IsPublic").collect()) == ["back", "gate"]
    assert s.relation("MatchesPod").count() == 4
    web = ([("app", "web")], [])
    assert s.query_index("MatchesPod", web, "a").count() == 1
    assert s.query_index("MatchesPodAll", web).count() == 2
    assert [r["pod"]["meta"]["name"] for r in s.relation("ServiceMatchesPod").collect()] == ["p1"]


def test_command_line(spark, monkeypatch, capsys, tmp_path):
    import io

    from tessera.__main__ import main

    text = SCRIPT.replace("commit;", "commit;\nprofile cpu on;").replace("echo done;", "echo done;\ninsert Nope(1);\necho never;")
    monkeypatch.setattr("sys.stdin", io.StringIO(text))
    main(["--delta", "--init-snapshot", "--record", str(tmp_path / "log")])
    out = capsys.readouterr().out.split("\n")
    assert "NodesInUse:" in out and '{.name = "n0"}: +1' in out and "done" in out
    assert any(line.startswith("error: apply_update: unknown input relation Nope") for line in out) and "never" not in out
    assert "commit dump_changes;" in (tmp_path / "log").read_text() and "Nope" not in (tmp_path / "log").read_text()


def test_a_failing_handler_is_heard(spark):
    from tessera.streaming import handlers

    changes = {"R": spark.createDataFrame([(i, 1) for i in range(5)], "x long, __w long")}
    seen = []
    handlers.dispatch(changes, lambda name, row, weight: seen.append(row.x) or len(seen) < 3)
    assert len(seen) == 3

    def fails(name, row, weight):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError, match="no"), handlers.Threaded(fails) as last:
        handlers.dispatch(changes, last)


def test_parser():
    def parsed(text):
        return list(Parser(text).commands())[0]

    assert parsed("insert R(true);").value == Struct("R", (True,))
    assert parsed("modify R true <- R{.f1 = 5};").change == Struct("R", (), (("f1", 5),))
    assert parsed("delete R[(true,false)];").value == (True, False)
    assert parsed('delete N::R("foo", 0xabcdef1, true) , ').more
    for text, want in (("1_000_000_", 1000000), ("0xabcd", 43981), ("-5", -5), ("1.0", 1.0), ("32E-2", 0.32), (".567", 0.567)):
        assert Parser(text).value() == want
    with pytest.raises(ParseError):
        parsed("nonsense;")


def test_json_feed():
    text = json.dumps({"tab": {"u1": {"insert": {"name": "br0", "tags": ["set", [1, 2]], "opts": ["map", [["k", "v"]]]}}, "u2": {"old": {"a": 1}, "new": {"a": 2}}}})
    got = list(updates_from_json("", text))
    assert [(u.op, u.relation) for u in got] == [("insert", "Tab"), ("delete_key", "Tab"), ("insert", "Tab")]
    assert got[0].row["tags"] == [1, 2]
    for bad in ({"tab": {"u": {"x": 1}}}, {"tab": {"u": {"insert": {"a": -1}}}}, {"tab": {"u": {"insert": {"a": 1.5}}}}):
        with pytest.raises(FeedError):
            list(updates_from_json("", json.dumps(bad)))


def test_written_tables_start_few_processes_and_are_verified(spark):
    """A chmod process is started for every file and checksum file of a mounted folder: there are the data files only."""
    back = written(spark.range(1000, numPartitions=3).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h")))
    place = back._tessera_path.removeprefix("file://")
    names = sorted(os.listdir(place))
    assert len(names) == 3 and all(n.startswith("part-") for n in names)
    assert back.count() == 1000 and back.agg(F.sum("id")).first()[0] == 499500
    whole = open(f"{place}/{names[1]}", "rb").read()
    with open(f"{place}/{names[1]}", "wb") as f:
        f.write(whole[:8000] + bytes([whole[8000] ^ 1]) + whole[8001:])
    with pytest.raises(Exception, match="(?i)corrupt|crc|checksum"):
        back.agg(F.sum(F.length("h"))).collect()
    drop(back)
    assert not os.path.exists(place)
