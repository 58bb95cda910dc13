"""Sharding by extendible hashing.

Rows are placed by the leading bits of a hash. A directory tells how many bits a bucket uses: a bucket over the byte limit,
and only such a bucket, splits on one more bit, until every shard fits. The hash has 128 bits: XXH64 of the key, then XXH64
of key and text, so that rows of one key that alone exceed the limit are split by text as well. What no bit can part (one
row over the limit, or equal rows) stays together and is marked ``oversized``.

Scale: bytes are summed by the first ``step`` bits before the shuffle; the split of the directory works on these sums, and
rows of cells that are still too large are summed again ``step`` bits deeper. Rows meet the directory by their cell; the
directory has at most 2**step entries for each oversized cell above it. Nothing is collected.

Defined cases: a null text has 0 bytes; a null key hashes like any other; equal rows lie in the same shard; an empty table
has no shards; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def _bits(column: Column) -> Column:
    """64 bits as text of 0 and 1, so that prefixes are prefixes."""
    return F.lpad(F.conv(F.hex(column), 16, 2), 64, "0")


def _split(cells: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """cells: prefix (a bucket over the limit), cell (the prefix and some more bits), bytes, rows. Returns the leaves that
    splitting bit by bit reaches (shard, bytes, rows) and the cells still over the limit (prefix, bytes, rows).

    A bucket's bytes are the sum of its cells', and never more than its parent's: so the buckets within the limit whose
    parent is over it are the leaves.
    """
    levels = F.explode(F.sequence(F.length("prefix"), F.length("cell"))).alias("bits")
    buckets = cells.select("cell", "bytes", "rows", levels).select(F.expr("substring(cell, 1, bits)").alias("shard"), "bytes", "rows")
    sums = buckets.groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    over = sums.where(F.col("bytes") > limit).select(F.col("shard").alias("parent"))
    fit = sums.where(F.col("bytes") <= limit).withColumn("parent", F.expr("substring(shard, 1, length(shard) - 1)"))
    rest = cells.where(F.col("bytes") > limit).select(F.col("cell").alias("prefix"), "bytes", "rows")
    return fit.join(over, "parent", "left_semi").select("shard", "bytes", "rows"), rest


def _sized(docs: DataFrame, key_col: str, text_col: str) -> DataFrame:
    key, text = F.col(f"`{key_col}`"), F.col(f"`{text_col}`").cast("string")
    bits = F.concat(_bits(F.xxhash64(key)), _bits(F.xxhash64(key, text, F.lit(1))))
    return docs.select(F.col(f"`{key_col}`").alias("key"), bits.alias("bits"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))


def directory(sized: DataFrame, limit: int, step: int = 12) -> DataFrame:
    """sized: bits (128 characters of 0 and 1), bytes. The shards: shard (its prefix), bytes, rows, oversized."""
    total = sized.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")).where("rows > 0").select(F.lit("").alias("prefix"), "bytes", "rows")
    total = written(total)
    found = total.where(F.col("bytes") <= limit).select(F.col("prefix").alias("shard"), "bytes", "rows", F.lit(False).alias("oversized"))
    over, depth = written(total.where(F.col("bytes") > limit)), 0
    while depth < 128 and not over.isEmpty():
        width = min(step, 128 - depth)
        rows = sized.select(F.substring("bits", 1, depth).alias("prefix"), F.substring("bits", 1, depth + width).alias("cell"), "bytes")
        cells = written(rows.join(over.select("prefix"), "prefix", "left_semi").groupBy("prefix", "cell").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")))
        leaves, rest = _split(cells, limit)
        found = found.unionByName(leaves.withColumn("oversized", F.lit(False)))
        over, depth = written(rest), depth + width
        single = over.where("rows = 1").select(F.col("prefix").alias("shard"), "bytes", "rows", F.lit(True).alias("oversized"))
        found, over = written(found.unionByName(single)), over.where("rows > 1")
    return found.unionByName(over.select(F.col("prefix").alias("shard"), "bytes", "rows", F.lit(True).alias("oversized")))


def assign(docs: DataFrame, limit: int, key_col: str = "doc_id", text_col: str = "text", step: int = 12) -> DataFrame:
    """key, bytes, shard (leading bits of its hash), shard_bytes, shard_rows and oversized of every row."""
    sized = written(_sized(docs, key_col, text_col))
    shards = written(directory(sized, limit, step).withColumn("depth", F.length("shard")))
    depths = [r[0] for r in shards.select("depth").distinct().collect()]  # at most 129
    if not depths:
        depths = [0]
    prefixes = F.explode(F.array(*[F.expr(f"substring(bits, 1, {d})") for d in sorted(depths)]))
    known = shards.select("shard", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"), "oversized")
    met = sized.select("key", "bytes", prefixes.alias("shard")).join(known, "shard")
    return met.select("key", "bytes", "shard", "shard_bytes", "shard_rows", "oversized")


def write_shards(docs: DataFrame, path: str, limit: int, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs to one folder for each shard (``_shard=<bits>``) and returns the directory."""
    sized = _sized(docs, key_col, text_col)
    shards = written(directory(written(sized), limit))
    depths = sorted(r[0] for r in shards.select(F.length("shard")).distinct().collect())
    key, text = F.col(f"`{key_col}`"), F.col(f"`{text_col}`").cast("string")
    bits = F.concat(_bits(F.xxhash64(key)), _bits(F.xxhash64(key, text, F.lit(1))))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    prefixes = F.explode(F.array(*[F.expr(f"substring(bits, 1, {d})") for d in depths])).alias("_shard")
    cut = docs.select(row, bits.alias("bits")).select("row", prefixes)
    placed = cut.join(shards.select(F.col("shard").alias("_shard")), "_shard")
    placed.select("_shard", "row.*").repartition("_shard").write.partitionBy("_shard").parquet(path)
    return shards
