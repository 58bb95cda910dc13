"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop, shared_dir, written  # noqa: F401  (used by the operators)

#: Rows in one Arrow batch sent to Python: texts can be long, so batches are kept short.
ARROW_ROWS = 256


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of text rows small, unless the session asks for fewer rows already. The setting stays: it is read
    when a plan runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, as the contracts ask; lower() would also fold other alphabets."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the folds of the contracts. Null ids have no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


# --- a bit table of fixed size: which strings may belong to a set --------------------------------------------------------

#: Bits of the table: 1 MB, whatever the input. Strings that share a cell only cause needless work later.
TABLE_BITS = 23
_MASK = (1 << TABLE_BITS) - 1


def cell_of(value: str) -> int:
    """Spark's xxhash64 is XXH64 with seed 42, so Python and Spark agree on cells."""
    return xxhash.xxh64_intdigest(value.encode(), 42) & _MASK


def bit_table(strings: DataFrame, column: str) -> np.ndarray:
    """The cells of all strings of a column; at most 131072 rows come to the driver."""
    cells = strings.select(F.xxhash64(F.col(column)).bitwiseAND(F.lit(_MASK)).alias("c"))
    bit = F.expr("shiftleft(1L, cast(c & 63 as int))")
    words = cells.groupBy(F.shiftright("c", 6).alias("w")).agg(F.bit_or(bit).alias("bits"))
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    for w, word in words.collect():
        table[w] = word
    return table


def may_hold(table: np.ndarray, value: str) -> bool:
    cell = cell_of(value)
    return bool(int(table[cell >> 6]) >> (cell & 63) & 1)
