"""Registered queries of the function library, each beside its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import bigint, groups, maps, numeric, options, sets, strings, values, vectors
from .operators import aggregate
from .registry import joined_text as text
from .registry import query, table


def _entries(m: Column) -> Column:
    return F.array_join(F.transform(m, lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",")


@query("""SELECT doc_id, source AS trimmed, hex(encode(lang)) AS bytes, lower(source) AS low, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE source END AS valid,
  array_to_string(list_transform(string_split(concat(source, 'é'), ''), lambda c: CAST(unicode(c) AS VARCHAR)), ',') AS units, concat(source, 'é') AS back,
  CAST(TRY_CAST(substr(source, 4) AS UBIGINT) AS VARCHAR) AS num, CAST(n_chars AS VARCHAR) AS shown, concat('{"v":"', source, '"}') AS debug, source AS interned FROM documents""")
def fn_string_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("source")
    accented = F.concat(s, F.lit("é"))
    units = strings.encode_utf16(accented)
    return table(spark, sf_dir, "documents").select(
        "doc_id", strings.trim(F.concat(F.lit("  "), s, F.lit(" \t"))).alias("trimmed"), F.hex(strings.to_bytes(F.col("lang"))).alias("bytes"), strings.str_to_lower(s).alias("low"),
        strings.from_utf8(F.unhex(F.concat(F.hex(strings.to_bytes(s)), F.when(F.col("doc_id") % 2 == 0, "FF").otherwise("")))).alias("valid"),
        text(units).alias("units"), strings.from_utf16(units).alias("back"), strings.parse_dec_u64(strings.substr(s, F.lit(3), F.lit(99))).cast("string").alias("num"),
        strings.to_string(F.col("n_chars")).alias("shown"), strings.to_string_debug(s).alias("debug"), strings.ival(strings.intern(s)).alias("interned"),
    )


@query("""SELECT doc_id, string_split(source, '') = string_split(source, '') AS same, array_to_string(string_split(source, 'r'), '|') AS cut, contains(source, '1') AS has,
  substr(source, 2, 2) AS sub, replace(source, 'src', 'S') AS rep, starts_with(source, 'src1') AS pre, suffix(source, '7') AS post, CAST(strlen(source) AS BIGINT) AS len,
  lower(source) AS low, upper(source) AS up, reverse(source) AS rev, source AS trimmed, hex(encode(source)) AS bytes, TRY_CAST(substr(source, 4) AS BIGINT) AS num FROM documents""")
def fn_istring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The string functions on interned strings."""
    s = strings.intern(F.col("source"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", (strings.split(s, "") == strings.split(s, "")).alias("same"), strings.join(strings.split(s, "r"), "|").alias("cut"), strings.contains(s, F.lit("1")).alias("has"),
        strings.substr(s, F.lit(1), F.lit(3)).alias("sub"), strings.replace(s, "src", "S").alias("rep"), strings.starts_with(s, F.lit("src1")).alias("pre"),
        strings.ends_with(s, F.lit("7")).alias("post"), strings.length(s).alias("len"), strings.to_lowercase(s).alias("low"), strings.to_uppercase(s).alias("up"),
        strings.reverse(s).alias("rev"), strings.trim(s).alias("trimmed"), F.hex(strings.to_bytes(s)).alias("bytes"), strings.parse_dec_i64(strings.substr(s, F.lit(3), F.lit(99))).alias("num"),
    )


def _cube(bits: int, signed: bool, base: str = "b") -> str:
    low = f"((({base} * {base} * {base}) % {1 << bits}::HUGEINT + {1 << bits}::HUGEINT) % {1 << bits}::HUGEINT)"
    return f"CAST(CASE WHEN {low} >= {1 << (bits - 1)}::HUGEINT THEN {low} - {1 << bits}::HUGEINT ELSE {low} END AS VARCHAR)" if signed else f"CAST({low} AS VARCHAR)"


_POWERS = [(bits, signed) for bits in (8, 16, 32, 64) for signed in (False, True)]


@query(f"""SELECT p_partkey, {", ".join(f"{_cube(bits, signed)} AS {'s' if signed else 'u'}{bits}" for bits, signed in _POWERS)},
  CAST(b * b * b AS VARCHAR) AS s128, CAST(-(b * b * b) AS VARCHAR) AS u128, CAST(b * b * b AS VARCHAR) AS big, CAST(b % 2 = 0 AS BIGINT) AS parity
  FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN -1 ELSE 1 END * p_partkey::HUGEINT * 1000003 AS b FROM part)""")
def fn_pow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapping powers of every width; s128 and big do not wrap here, u128 is a power of the negated base, signed again."""
    b = F.when(F.col("p_size") % 2 == 0, -1).otherwise(1) * F.col("p_partkey") * 1000003
    three = F.lit(3)
    powers = [numeric.pow32(b, three, bits, signed).cast("string").alias(f"{'s' if signed else 'u'}{bits}") for bits, signed in _POWERS]
    return table(spark, sf_dir, "part").select(
        "p_partkey", *powers, bigint.wrapped_pow(b, three, 128, True).alias("s128"),
        bigint.truncate_to(bigint.wrapped_pow(-b, three, 128, False), 128, True).alias("u128"), bigint.exact("pow32", b, three).alias("big"),
        (1 - numeric.pow32(b, F.lit(4_000_000_000), 8, False) % 2).alias("parity"),  # an exponent of 32 bits
    )


@query("""SELECT p_partkey, CAST(((p_partkey & 255) << 24) | (((p_partkey >> 8) & 255) << 16) | (((p_partkey >> 16) & 255) << 8) | ((p_partkey >> 24) & 255) AS BIGINT) AS l,
  p_partkey AS there_and_back, CAST(((p_partkey & 255) << 8) | ((p_partkey >> 8) & 255) AS INTEGER) AS s FROM part""")
def fn_byte_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", numeric.ntohl(n).alias("l"), numeric.ntohl(numeric.htonl(n)).alias("there_and_back"), numeric.ntohs(n).alias("s"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_type) AS n32, count(*) OVER (PARTITION BY p_type) AS n64, count(*) OVER (PARTITION BY p_type) AS n128, true AS in32, CAST(32 AS INTEGER) AS digits FROM part")
def fn_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal values have equal hashes and others do not (of 32 bits by luck); widths. The values themselves are Spark's."""
    t = F.col("p_type")
    hashed = table(spark, sf_dir, "part").select("p_partkey", strings.hash32(t).alias("h32"), strings.hash64(t).alias("h64"), strings.hash128(t).alias("h128"))
    from pyspark.sql import Window

    counts = [F.count("*").over(Window.partitionBy(f"h{n}")).alias(f"n{n}") for n in (32, 64, 128)]
    return hashed.select("p_partkey", *counts, F.col("h32").between(0, (1 << 32) - 1).alias("in32"), F.length("h128").alias("digits"))


_V = "[l_orderkey % 7, l_partkey % 7, l_suppkey % 7]"


def _v() -> Column:
    return F.array(F.col("l_orderkey") % 7, F.col("l_partkey") % 7, F.col("l_suppkey") % 7)


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


@query(f"""SELECT l_orderkey, l_linenumber, concat(v[1], ',', v[1]) AS repeated, CAST(v[2] AS VARCHAR) AS one, array_to_string(list_concat(v, [1, 2]), ',') AS appended,
  v[1] > 9 AS none, concat(array_to_string(v, ','), ',0,0') AS wider, array_to_string(v[1:2], ',') AS narrower, array_to_string(v[1:1], ',') AS cut,
  true AS swapped, concat(v[1], ',9,', v[3]) AS after, v[2] AS was, false AS missed, 9 AS kept, true AS updated, concat(v[1], ',', v[2], ',8') AS changed,
  concat(v[1], '=1,', v[2], '=2') AS zipped, concat(v[1], ',', v[2]) AS first, '1,2' AS second, CASE WHEN v[1] = v[2] THEN concat(v[1], '=2') WHEN v[1] < v[2] THEN concat(v[1], '=1,', v[2], '=2') ELSE concat(v[2], '=2,', v[1], '=1') END AS mapped,
  '' AS nothing, CAST(v[1] AS VARCHAR) AS grown FROM (SELECT *, {_V} AS v FROM lineitem)""")
def fn_vec_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _v()
    pair = F.array(_long(1), _long(2))
    inside, outside, update = vectors.swap_nth(v, F.lit(1), _long(9)), vectors.swap_nth(v, F.lit(7), F.lit(9)), vectors.update_nth(v, F.lit(2), _long(8))
    zipped = vectors.zip_vectors(v, pair)
    halves = vectors.unzip(zipped)
    shown = F.array_join(F.transform(zipped, lambda p: F.concat(p["_1"].cast("string"), F.lit("="), p["_2"].cast("string"))), ",")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", text(vectors.with_length(F.lit(2), vectors.nth(v, F.lit(0)))).alias("repeated"), text(vectors.singleton(vectors.nth(v, F.lit(1)))).alias("one"),
        text(vectors.append(v, pair)).alias("appended"), vectors.is_empty(v).alias("none"), text(vectors.resize(v, F.lit(5), _long(0))).alias("wider"), text(vectors.resize(v, F.lit(2), _long(0))).alias("narrower"),
        text(vectors.truncate(v, F.lit(1))).alias("cut"), inside["ok"].alias("swapped"), text(inside["v"]).alias("after"), inside["x"].alias("was"), outside["ok"].alias("missed"), outside["x"].cast("int").alias("kept"),
        update["ok"].alias("updated"), text(update["v"]).alias("changed"), shown.alias("zipped"), text(halves["_1"]).alias("first"), text(halves["_2"]).alias("second"), _entries(maps.from_vec(zipped)).alias("mapped"),
        text(vectors.empty("bigint")).alias("nothing"), text(vectors.push_imm(vectors.with_capacity("bigint", 8), vectors.nth(v, F.lit(0)))).alias("grown"),
    )


@query(f"""SELECT l_orderkey, l_linenumber, CAST(len(s) AS BIGINT) AS n, CAST(v[1] AS VARCHAR) AS one, array_to_string(list_sort(list_distinct(list_append(v, 3))), ',') AS added, list_contains(v, 3) AS has,
  len(v) = 0 AS none, CAST(s[2] AS VARCHAR) AS second, array_to_string(s, ',') AS vec, array_to_string(list_sort(list_distinct(list_concat(v, [8, 1]))), ',') AS all_of, '' AS nothing,
  array_to_string(list_sort(list_concat(list_filter(s, lambda x: x NOT IN (1, 2)), list_filter([1::BIGINT, 2::BIGINT], lambda x: NOT list_contains(s, x)))), ',') AS toggled
  FROM (SELECT *, {_V} AS v, list_sort(list_distinct({_V})) AS s FROM lineitem)""")
def fn_set_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _v()
    s = vectors.to_set(v)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", sets.size(s).alias("n"), text(sets.singleton(vectors.nth(v, F.lit(0)))).alias("one"), text(sets.insert(s, _long(3))).alias("added"), sets.contains(s, _long(3)).alias("has"),
        sets.is_empty(s).alias("none"), sets.nth(s, F.lit(1)).cast("string").alias("second"), text(sets.to_vec(s)).alias("vec"), text(sets.unions(F.array(s, sets.insert_imm(sets.singleton(_long(8)), _long(1))))).alias("all_of"),
        text(sets.empty("bigint")).alias("nothing"), text(sets.symmetric_difference(s, F.array(_long(1), _long(2)))).alias("toggled"),
    )


_M = "SELECT c_custkey, c_mktsegment AS seg, c_name AS name, c_nationkey AS nation FROM customer"


@query(f"""SELECT c_custkey, CASE WHEN seg < 'M' THEN concat(seg, '=', nation, ',M=', c_custkey) WHEN seg = 'M' THEN concat('M=', c_custkey) ELSE concat('M=', c_custkey, ',', seg, '=', nation) END AS entries,
  CAST(c_custkey AS VARCHAR) AS taken, concat(seg, '=', nation) AS left_over, seg < 'M' AS early, CASE WHEN seg < 'M' THEN seg ELSE 'M' END AS k0, CASE WHEN seg < 'M' THEN CAST(nation AS BIGINT) ELSE c_custkey END AS v0,
  CAST(CASE WHEN seg = 'BUILDING' THEN c_custkey * 2 END AS VARCHAR) AS building, seg = 'BUILDING' AS has, false AS none, true AS empty, '' AS nothing, CAST(CASE WHEN seg = 'BUILDING' THEN 2 ELSE 3 END AS BIGINT) AS merged,
  CAST(CASE WHEN seg = 'BUILDING' THEN 0 ELSE 1 END AS BIGINT) AS after_delete FROM ({_M})""")
def fn_map_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg, key, nation = F.col("c_mktsegment"), F.col("c_custkey"), F.col("c_nationkey").cast("long")
    m = maps.insert(maps.singleton(F.lit("M"), key), seg, nation)
    removed = maps.remove(m, F.lit("M"))
    won = maps.union(m, maps.insert_imm(maps.singleton(F.lit("BUILDING"), key * 2), F.lit("M"), _long(5)))
    gone = maps.mutate(maps.singleton(seg, key), maps.singleton(F.lit("BUILDING"), F.lit(None).cast("long")))
    got = F.when(maps.contains_key(m, F.lit("BUILDING")), maps.get(won, F.lit("BUILDING")))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", _entries(m).alias("entries"), removed["value"].cast("string").alias("taken"), _entries(removed["rest"]).alias("left_over"),
        (maps.nth_key(m, F.lit(0)) == seg).alias("early"), maps.nth_key(m, F.lit(0)).alias("k0"), maps.nth_value(m, F.lit(0)).alias("v0"), got.cast("string").alias("building"),
        maps.contains_key(m, F.lit("BUILDING")).alias("has"), maps.is_empty(m).alias("none"), maps.is_empty(maps.empty("string", "bigint")).alias("empty"), _entries(maps.empty("string", "bigint")).alias("nothing"),
        maps.size(won).alias("merged"), maps.size(gone).alias("after_delete"),
    )


@query(f"""SELECT c_custkey, seg, CASE WHEN seg <> 'BUILDING' THEN 'missing' END AS other, CASE WHEN seg = 'BUILDING' THEN c_custkey ELSE 0 END AS found, seg = 'BUILDING' AS has, CAST(2 AS BIGINT) AS n,
  CASE WHEN seg < name THEN concat(seg, ',', name) ELSE concat(name, ',', seg) END AS ks, CASE WHEN seg < name THEN concat(c_custkey, ',', nation) ELSE concat(nation, ',', c_custkey) END AS vs,
  CASE WHEN seg = 'BUILDING' THEN -1 ELSE c_custkey END AS wins FROM ({_M})""")
def fn_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg, name, key, nation = F.col("c_mktsegment"), F.col("c_name"), F.col("c_custkey"), F.col("c_nationkey").cast("long")
    m = maps.insert(maps.singleton(name, nation), seg, key)
    building = maps.get(m, F.lit("BUILDING"))
    won = maps.union(m, maps.singleton(F.lit("BUILDING"), _long(-1)))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", seg.alias("seg"), F.when(building.isNull(), "missing").alias("other"), F.coalesce(building, F.lit(0)).alias("found"), maps.contains_key(m, F.lit("BUILDING")).alias("has"),
        maps.size(m).alias("n"), F.array_join(maps.keys(m), ",").alias("ks"), text(maps.values(m)).alias("vs"), maps.get(won, seg).alias("wins"),
    )


@query("""SELECT c_custkey, CASE WHEN p THEN c_acctbal * 2 END AS ok, CASE WHEN NOT p THEN 'no!' END AS err, NOT p AS none, p AS some, p AS fine, coalesce(CASE WHEN p THEN c_acctbal END, 0) AS or_zero,
  CASE WHEN p THEN c_acctbal ELSE -1 END AS or_less, CASE WHEN p THEN c_acctbal ELSE 0 END AS or_default, CAST(CASE WHEN p THEN 1 ELSE 0 END AS INTEGER) AS members, CASE WHEN p THEN c_acctbal END AS same,
  CASE WHEN NOT p THEN 'no' END AS lazily FROM (SELECT *, c_acctbal > 0 AS p FROM customer)""")
def fn_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    r = options.res2std(options.ok_or(o, F.lit("no")))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", options.map_result(r, lambda x: x * 2)["ok"].alias("ok"), options.map_err(r, lambda e: F.concat(e, F.lit("!")))["err"].alias("err"), options.is_none(o).alias("none"),
        options.is_some(o).alias("some"), options.is_ok(r).alias("fine"), options.unwrap_or_default(o, F.lit(0.0)).alias("or_zero"), options.result_unwrap_or(r, F.lit(-1.0)).alias("or_less"),
        options.result_unwrap_or_default(r, values.default(T.DoubleType())).alias("or_default"), F.size(options.to_set(o)).alias("members"),
        options.std2option(options.option2std(options.map_option(o, lambda x: x))).alias("same"), options.ok_or_else(o, F.lit("no"))["err"].alias("lazily"),
    )


@query("""SELECT c_custkey, CASE WHEN odd THEN c_name END AS name, CAST(CASE WHEN NOT odd THEN c_custkey END AS VARCHAR) AS number, CAST(NULL AS DOUBLE) AS neither, c_name AS seen, '' AS text, CAST(0 AS BIGINT) AS zero,
  false AS no, CAST(0 AS INTEGER) AS items, '' AS inner_text FROM (SELECT *, c_custkey % 2 = 1 AS odd FROM customer)""")
def fn_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("c_custkey") % 2 == 1, values.to_any(F.col("c_name"))).otherwise(values.to_any(F.col("c_custkey")))
    nested = values.default(T.StructType([T.StructField("a", T.ArrayType(T.LongType())), T.StructField("b", T.StringType())]))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", values.from_any(a, "string").alias("name"), values.from_any(a, "bigint").cast("string").alias("number"), values.from_any(a, "double").alias("neither"), values.deref(values.ref_new(F.col("c_name"))).alias("seen"),
        values.default(T.StringType()).alias("text"), values.default(T.LongType()).alias("zero"), values.default(T.BooleanType()).alias("no"), F.size(nested["a"]).alias("items"), nested["b"].alias("inner_text"),
    )


@query("""SELECT l_returnflag AS flag, l_returnflag AS k, string_agg(l_linestatus, ',' ORDER BY l_linestatus, q) AS inputs, string_agg(CAST(q AS VARCHAR), ',' ORDER BY l_linestatus, q) AS vals,
  count(*) AS n, min(l_linestatus) AS least FROM (SELECT DISTINCT l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY l_returnflag""")
def agg_key_and_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("q"))
    made = aggregate(
        rows.withColumn("flag", F.col("l_returnflag")), ["flag"], ["l_returnflag", "l_linestatus", "q"], k=groups.key("l_returnflag"), s=groups.debug_split("l_linestatus", "q"),
        n=groups.count_distinct("l_linestatus", "q"), least=groups.minimum("l_linestatus"),
    )
    return made.select("flag", "k", text(F.col("s._1")).alias("inputs"), text(F.col("s._2")).alias("vals"), "n", "least")


_B = "(SELECT o_orderkey, o_orderkey::HUGEINT * 1000000007 AS b, o_custkey::HUGEINT AS c, -(o_orderkey::HUGEINT * 1000003) AS d FROM orders)"


@query(f"""SELECT o_orderkey, CAST(b + c AS VARCHAR) AS plus, CAST(b - c AS VARCHAR) AS minus, CAST(-b AS VARCHAR) AS neg, CAST(b & c AS VARCHAR) AS both, CAST(b | c AS VARCHAR) AS either,
  CAST(b * 1048576 AS VARCHAR) AS shl, CAST(b // 8 AS VARCHAR) AS shr, CAST(d // 1000 AS VARCHAR) AS quot, CAST(d % 1000 AS VARCHAR) AS rem, CAST(o_orderkey AS VARCHAR) AS parsed, CAST(NULL AS VARCHAR) AS unparsed,
  CAST(CASE WHEN c < 256 THEN c END AS VARCHAR) AS u8, CAST(CASE WHEN c < 32768 THEN c END AS VARCHAR) AS s16, CAST(CASE WHEN c < 4294967296 THEN c END AS VARCHAR) AS u32, CAST(d AS VARCHAR) AS s64, CAST(CASE WHEN d >= 0 THEN d END AS VARCHAR) AS u64,
  CAST(c % 256 AS VARCHAR) AS low8, CAST(CASE WHEN c % 256 >= 128 THEN c % 256 - 256 ELSE c % 256 END AS VARCHAR) AS slow8, CAST(b AS DOUBLE) AS dbl, CAST(c AS FLOAT) AS flt, CAST(NULL AS VARCHAR) AS missing FROM {_B}""")
def fn_bigint_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    b, d = bigint.exact("mul", k, F.lit("1000000007")), bigint.exact("mul", k, F.lit("-1000003"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", bigint.exact("add", b, c).alias("plus"), bigint.exact("sub", b, c).alias("minus"), bigint.negate(b).alias("neg"), bigint.exact("and", b, c).alias("both"), bigint.exact("or", b, c).alias("either"),
        bigint.exact("shl", b, F.lit(20)).alias("shl"), bigint.exact("shr", b, F.lit(3)).alias("shr"), bigint.exact("div", d, F.lit(1000)).alias("quot"), bigint.exact("rem", d, F.lit(1000)).alias("rem"),
        bigint.parse(F.lower(F.hex(k)), 16).alias("parsed"), bigint.parse(F.concat(F.lit("x"), k.cast("string"))).alias("unparsed"), bigint.checked(c, 8, False).alias("u8"), bigint.checked(c, 16, True).alias("s16"),
        bigint.checked(c, 32, False).alias("u32"), bigint.checked(d, 64, True).alias("s64"), bigint.checked(d, 64, False).alias("u64"), bigint.truncate_to(c, 8, False).alias("low8"), bigint.truncate_to(c, 8, True).alias("slow8"),
        bigint.to_double(b).alias("dbl"), bigint.to_float(c).alias("flt"), bigint.exact("add", F.lit(None).cast("string"), c).alias("missing"),
    )


@query("SELECT o_orderkey, CAST((o_orderkey::HUGEINT * 1000000007) * (o_orderkey::HUGEINT * 1000000009) AS VARCHAR) AS long_product, CAST(o_orderkey::HUGEINT * 1000000007 * 1000000009 // 7 AS VARCHAR) AS long_quotient FROM orders")
def fn_bigint_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operands of more than 18 digits."""
    k = F.col("o_orderkey")
    a, b = bigint.exact("mul", k, F.lit("1000000007")), bigint.exact("mul", k, F.lit("1000000009"))
    return table(spark, sf_dir, "orders").select("o_orderkey", bigint.exact("mul", a, b).alias("long_product"), bigint.exact("div", bigint.exact("mul", a, F.lit("1000000009")), F.lit(7)).alias("long_quotient"))
