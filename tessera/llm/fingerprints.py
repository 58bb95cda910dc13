"""Exact document fingerprints: canonical text, wide xxhash, byte comparison inside equal buckets.

Canonical text: NFKC, case folded, runs of white space as one space, ends stripped. The digest is XXH3-128 of its UTF-8
bytes; rows with equal digests form a bucket. The canonical bytes inside each bucket are compared; in a bucket that holds
different ones (a collision) the fingerprint is the digest followed by SHA-256 of the canonical bytes. Equal fingerprints
thus mean equal canonical texts, and likeness of two fingerprints is 1 or 0.

Scale: the digest pass is local to each row. Only rows whose digest may occur twice (told by a bit table of fixed size)
ship their canonical bytes, compressed by a lossless and fixed encoder, so that equal and different bytes stay so. Those
are reduced to a minimum and a maximum before the shuffle: a bucket with a third of all rows sends one row from each task.
Collided digests are a table that rows are joined with; if it is empty, as it should be, nothing is joined.

Defined cases: a null text counts as empty; null ids come last and are kept; repeated rows share their fingerprint; an empty
table gives an empty result; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_table, may_hold, short_batches, written

def canonical(text: str | None) -> bytes:
    """NFKC, case folding, NFKC again (folding can undo it), and single spaces."""
    if not text:
        return b""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "replace")


@lru_cache(maxsize=2)
def _known(text: str) -> bytes:
    """canonical, remembering two: a row's text is the next text of the row before."""
    return canonical(text)


def digest(data: bytes, bits: int = 128) -> str:
    """XXH3-128 as 32 hex digits; fewer bits only to provoke collisions in tests."""
    return f"{xxhash.xxh3_128_intdigest(data) >> (128 - bits):032x}"


def _marks(data: bytes, bits: int) -> tuple[str, str]:
    """The digest, and what follows it in a bucket of different texts."""
    return digest(data, bits), hashlib.sha256(data).hexdigest()


def _rows(run: Callable[[Iterator[tuple]], Iterator[tuple]], types: dict[str, pa.DataType], batch_rows: int = 1000):
    """A mapInArrow function from an iterator over Python rows to rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))

        held: list[tuple] = []
        for row in run(read()):
            held.append(row)
            if len(held) >= batch_rows:
                yield _batch(held, types)
                held = []
        yield _batch(held, types)

    return each


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], list(types))


def _mixed(digests: DataFrame, packed: Callable[[Callable[[bytes], tuple[str, bytes] | None]], DataFrame], bits: int) -> DataFrame:
    """Byte comparison: the digests whose bucket holds different canonical texts.

    packed(pack) returns the rows digest, packed; its argument packs canonical bytes if their digest may occur twice. Of each
    bucket only the least and the greatest bytes travel from a task: they differ exactly if the bucket is mixed.
    """
    repeated = digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    table = digests.sparkSession.sparkContext.broadcast(bit_table(repeated, "digest"))

    def pack(data: bytes) -> tuple[str, bytes] | None:
        key = digest(data, bits)
        return (key, zstandard.ZstdCompressor(level=1).compress(data)) if may_hold(table.value, key) else None

    spread = packed(pack).groupBy("digest").agg(F.min("packed").alias("least"), F.max("packed").alias("greatest"))
    return written(spread.where("least <> greatest").select("digest"))


_PACKED = {"digest": pa.string(), "packed": pa.binary()}


def _full(rows: DataFrame, mixed: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """rows with the digests in columns ``names`` made fingerprints; their SHA-256 in ``<name>_sha`` goes."""
    collided = not mixed.isEmpty()
    for name in names:
        if collided:
            rows = rows.join(mixed.select(F.col("digest").alias("_mixed")), F.col(name) == F.col("_mixed"), "left")
            long = F.concat_ws(":", name, f"{name}_sha")
            rows = rows.withColumn(name, F.when(F.col("_mixed").isNull(), F.col(name)).otherwise(long)).drop("_mixed")
        rows = rows.drop(f"{name}_sha")
    return rows


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", bits: int = 128) -> DataFrame:
    """doc_id, n_chars and fingerprint of every row."""
    short_batches(docs.sparkSession)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, text in rows:
            yield key, len(text or ""), *_marks(canonical(text), bits)

    types = {"doc_id": pa.int64(), "n_chars": pa.int64(), "fingerprint": pa.string(), "fingerprint_sha": pa.string()}
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"))
    marked = written(rows.mapInArrow(_rows(run, types), "doc_id long, n_chars long, fingerprint string, fingerprint_sha string"))

    def packed(pack: Callable) -> DataFrame:
        def each(rows_: Iterator[tuple]) -> Iterator[tuple]:
            for (text,) in rows_:
                if row := pack(canonical(text)):
                    yield row

        return rows.select("t").mapInArrow(_rows(each, _PACKED), "digest string, packed binary")

    mixed = _mixed(marked.select(F.col("fingerprint").alias("digest")), packed, bits)
    return _full(marked, mixed, ("fingerprint",))


# --- the contract's edited texts -------------------------------------------------------------------------------------

_PAIR = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "fingerprint_sha": pa.string(),
    "edited_fingerprint": pa.string(), "edited_fingerprint_sha": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
}
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.float64(): "double"}


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by the first as many code points of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _with_next(docs: DataFrame, text_col: str, id_col: str, make: Callable[[int | None, str, str], Iterator[tuple]], types: dict[str, pa.DataType]) -> DataFrame:
    """The rows that make(id, text, next text) yields for every row, in descending order of ids; after the last, the first.

    The rows are dealt by ranges of ids and each range is read in order, so that a row meets the next one in passing.
    Only the first and the last row of each range are matched afterwards. Equal ids are ordered by the hash of their
    texts, null ids come last.
    """
    nothing = [None] * len(types)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId()
        held = None
        for key, text in rows:
            text = text or ""
            if held is None:
                yield 0, part, None, text, *nothing
            else:
                for made in make(*held, text):
                    yield 1, part, None, None, *made
            held = key, text
        if held is not None:
            yield 2, part, *held, *nothing

    ordered = (
        docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"))
        .withColumn("h", F.xxhash64("t"))
        .repartitionByRange(F.col("i").desc_nulls_last(), F.col("h"))
        .sortWithinPartitions(F.col("i").desc_nulls_last(), F.col("h"))
        .select("i", "t")
    )
    schema = ", ".join(f"{name} {_SQL[t]}" for name, t in types.items())
    ends = {"kind": pa.int32(), "part": pa.int32(), "own": pa.int64(), "text": pa.string()}
    passed = written(ordered.mapInArrow(_rows(run, ends | types), f"kind int, part int, own long, text string, {schema}"))

    firsts = passed.where("kind = 0").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    parts = firsts.select("next_part")  # one row for each range
    order = Window.orderBy("next_part")
    wrapped = F.coalesce(F.lead("next_part").over(order), F.min("next_part").over(Window.partitionBy()))
    after = parts.select(F.col("next_part").alias("part"), wrapped.alias("next_part"))
    lasts = passed.where("kind = 2").select("part", "own", "text")
    met = lasts.join(after, "part").join(firsts, "next_part").select("own", "text", "following")

    def finish(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row in rows:
            yield from make(*row)

    return passed.where("kind = 1").select(*types).unionByName(met.mapInArrow(_rows(finish, types), schema))


def against_next(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", bits: int = 128) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document's, in descending order of ids: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next (1 if the canonical bytes are equal)."""
    short_batches(docs.sparkSession)

    def pair(key: int | None, text: str, following: str) -> Iterator[tuple]:
        changed = edited(text, following)
        own, other = _known(text), canonical(changed)
        sha = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
        yield key, len(text), sha, *_marks(own, bits), *_marks(other, bits), float(own == other), float(own == _known(following))

    marked = written(_with_next(docs, text_col, id_col, pair, _PAIR))

    def packed(pack: Callable) -> DataFrame:
        def each(key: int | None, text: str, following: str) -> Iterator[tuple]:
            for data in (canonical(text), canonical(edited(text, following))):
                if row := pack(data):
                    yield row

        return _with_next(docs, text_col, id_col, each, _PACKED)

    both = ("fingerprint", "edited_fingerprint")
    digests = marked.select(F.explode(F.array(*both)).alias("digest"))
    return _full(marked, _mixed(digests, packed, bits), both)
