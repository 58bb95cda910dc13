"""SimHash near-duplicates found with BK-trees.

A fingerprint's bit is 1 if it is set in over half of the XXH64 values (seed 42) of a text's word shingles, repeats
included. Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. A text of fewer words than a shingle has its
whole sequence as one shingle; a text without words has fingerprint zero.

Two searches share the trees:

* ``link_fingerprints``: fingerprints that differ in at most ``radius`` bits. The bits are cut into radius + e blocks; two
  such fingerprints agree in e blocks at least, so one tree for each choice of e blocks and their value finds every link.
  e is the least from 1 to 3 whose keys have bits enough that trees of evenly spread fingerprints stay small: more of them
  need longer keys, or trees would grow with the corpus.
* ``near_duplicates``: texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more. Trees are sharded
  by ``anchors`` min-hash values (two texts of similarity s share a shard with probability 1 - (1 - s)**anchors, 99.8 %
  at 0.8 and 4), searched with a wide radius of fingerprints that count each distinct shingle once, and each link found is confirmed on the whole shingle sets.

The trees are not broadcast: all of them together grow with the corpus, so each is built where its shard lives, from rows
dealt by shard. Equal fingerprints (or equal texts) are one node. A shard with over ``block_rows`` nodes is cut into
blocks; every two blocks meet in one task, so memory is bounded whatever the shard's size. A task emits a spanning forest
of its links, never all pairs.

Defined cases: a null text has no words; a null doc_id is processed, and is the component's id only if it has no other;
repeated rows are linked like copies; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bktree import Forest, Union, neighbours
from .common import ascii_lower, bit_table, may_hold, partitions, short_batches, written
from .components import components

SEED = 42
#: Shingles that are unpacked to bits at once.
_BLOCK = 1 << 14
#: Odd multipliers of the min-hash permutations: a fixed rule, powers of the 64-bit golden ratio constant.
_GOLDEN = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only, as the definition asks."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of every shingle of k words, in order, repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(text, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    made = [digest(text[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
    return np.array(made, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        block = hashes[i : i + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = count * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def anchors_of(distinct: np.ndarray, anchors: int) -> list[int]:
    """The least value of each of several permutations of the shingle hashes."""
    out = []
    multiplier = _GOLDEN
    for _ in range(anchors):
        mixed = distinct * np.uint64(multiplier)
        mixed ^= mixed >> np.uint64(32)
        out.append(int((mixed * np.uint64(_GOLDEN)).min().astype(np.int64)) if len(distinct) else 0)
        multiplier = (multiplier * _GOLDEN) & (1 << 64) - 1 | 1
    return out


def fingerprints(docs: DataFrame, k: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(shingle_hashes(words_of(t), k)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, fp long")


# --- shards and their blocks -------------------------------------------------------------------------------------------


def _blocked(rows: DataFrame, block_rows: int) -> DataFrame:
    """rows: shard long, node, ... Drops shards of one node, cuts large ones into blocks, and sends a row to each pair of
    blocks that it belongs to: ``task`` identifies the pair, ``side`` is 0 for its first block, 1 for the second, 2 if
    the pair is a block with itself."""
    sizes = rows.groupBy("shard").agg(F.count("*").alias("_n")).where("_n > 1")
    cut = rows.join(sizes, "shard").withColumn("_p", F.ceil(F.col("_n") / block_rows).cast("int"))
    cut = cut.withColumn("_b", F.pmod(F.xxhash64("node"), F.col("_p")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_p") - 1))
    met = cut.withColumn("_o", other)
    low, high = F.least("_b", "_o"), F.greatest("_b", "_o")
    side = F.when(F.col("_b") == F.col("_o"), 2).when(F.col("_b") < F.col("_o"), 0).otherwise(1)
    return met.withColumns({"task": F.struct("shard", low.alias("low"), high.alias("high")), "side": side.cast("int")}).drop("_n", "_p", "_b", "_o")


def _by_task(rows: DataFrame, columns: list[str], run: Callable[[dict[str, list], np.ndarray], Iterator[tuple]], types: dict, schema: str, hold: int) -> DataFrame:
    """Deals rows by task and calls run on whole tasks, several small ones together: (columns, task numbers)."""
    dealt = (
        rows.select(F.xxhash64("task").alias("_t"), "task", *columns)
        .repartition(partitions(rows.sparkSession), "task")
        .sortWithinPartitions("_t", "task.shard", "task.low", "task.high")
        .select(F.col("task.shard").alias("a"), F.col("task.low").alias("b"), F.col("task.high").alias("c"), *columns)
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def emit(rows_: list[tuple]) -> pa.RecordBatch:
            keys = [r[:3] for r in rows_]
            number = np.cumsum([0] + [a != b for a, b in zip(keys[1:], keys)])
            out = list(run(dict(zip(columns, zip(*(r[3:] for r in rows_)))), number))
            found = list(zip(*out)) or [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, types.values())], list(types))

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if len(held) >= hold and row[:3] != held[-1][:3]:
                    yield emit(held)
                    held = []
                held.append(row)
        if held:
            yield emit(held)

    return dealt.mapInArrow(each, schema)


def _tree_pairs(prints: np.ndarray, number: np.ndarray, side: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of row pairs within the radius: rows of sides 0 and 2 ask the trees of the rows of sides 1 and 2."""
    nodes, asks = np.flatnonzero(side > 0), np.flatnonzero(side != 1)
    forest = Forest(prints[nodes], number[nodes])
    tasks, first, size = np.unique(number[nodes], return_index=True, return_counts=True)
    at = np.minimum(np.searchsorted(tasks, number[asks]), max(len(tasks) - 1, 0))
    if not len(tasks):
        return
    asks, at = asks[tasks[at] == number[asks]], at[tasks[at] == number[asks]]
    order = np.argsort(size[at], kind="stable")
    asks, at = asks[order], at[order]
    for a, b in neighbours(forest, prints[asks], first[at], size[at], radius):
        x, y = asks[a], nodes[b]
        yield x[x != y], y[x != y]


def _block_keys(radius: int, equal: int) -> tuple[Column, int]:
    """For each choice of ``equal`` of radius + equal blocks of a fingerprint a key of their bits; and how many bits at least."""
    blocks = radius + equal
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    keys = [F.xxhash64(F.lit(i), *[part[p] for p in pick]) for i, pick in enumerate(combinations(range(blocks), equal))]
    return F.array(*keys), equal * (64 // blocks)


def link_fingerprints(distinct: DataFrame, radius: int = 3, block_rows: int = 4096, equal: int | None = None) -> DataFrame:
    """distinct: fp (signed longs, each once). Links a, b that connect exactly what is within the radius."""
    if equal is None:
        count = distinct.count()
        equal = next((e for e in (1, 2) if count >> _block_keys(radius, e)[1] <= block_rows // 16), 3)
    shards = F.explode(_block_keys(radius, equal)[0])
    rows = _blocked(distinct.select(F.col("fp").alias("node"), shards.alias("shard")), block_rows)

    def run(columns: dict[str, list], number: np.ndarray) -> Iterator[tuple]:
        signed = np.array(columns["node"], np.int64)
        prints, union = signed.view(np.uint64), Union(len(signed))
        for a, b in _tree_pairs(prints, number, np.array(columns["side"]), radius):
            for x, y in union.join_all(a, b):
                yield int(signed[x]), int(signed[y])

    return _by_task(rows, ["node", "side"], run, {"a": pa.int64(), "b": pa.int64()}, "a long, b long", 50_000)


def near_fingerprints(docs: DataFrame, k: int = 3, radius: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable over links) of every row."""
    prints = written(fingerprints(docs, k, text_col, id_col))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = components(link_fingerprints(distinct.select("fp"), radius))
    rooted = distinct.join(linked, distinct.fp == linked.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- whole texts -------------------------------------------------------------------------------------------------------


def class_of(text: Column) -> Column:
    """128 bits of a text's words: texts with the same words in the same order are one class."""
    words = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " ")
    return F.md5(F.trim(words).cast("binary"))


def _signatures(docs: DataFrame, k: int, anchors: int, text_col: str, id_col: str) -> DataFrame:
    """doc_id, cls, fp and anchors (none for a text without words) of every row."""
    short_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), class_of(text).alias("cls"), text.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(words_of(t), k) for t in batch.column(2).to_pylist()]
            prints = pa.array([fingerprint(np.unique(h)) for h in hashes], pa.int64())
            mins = pa.array([anchors_of(h, anchors) if len(h) else [] for h in hashes], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), prints, mins], ["doc_id", "cls", "fp", "anchors"])

    return rows.mapInArrow(run, "doc_id long, cls string, fp long, anchors array<long>")


def _shingle_sets(docs: DataFrame, k: int, text_col: str, wanted: DataFrame) -> DataFrame:
    """cls and the sorted set of 32-bit shingle hashes for the classes of ``wanted`` (column node), each once."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(wanted, "node"))  # of fixed size
    text = F.col(f"`{text_col}`").cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {}
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name not in out and may_hold(table.value, name):
                    out[name] = np.unique(shingle_hashes(words_of(text), k).astype(np.uint32)).astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.binary())], ["node", "shingles"])

    rows = docs.select(class_of(text).alias("c"), text.alias("t")).mapInArrow(run, "node string, shingles binary")
    return rows.groupBy("node").agg(F.first("shingles").alias("shingles"))  # equal for all rows of a class


class _Sets:
    """Shingle sets of a task's rows, with an inverted list for rows that have many candidates."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets])
        self._lists: tuple | None = None

    def shared(self, row: int, others: np.ndarray) -> np.ndarray:
        """Shingles that a row shares with each of the others."""
        own = self.sets[row]
        if len(others) <= 16:
            return np.array([len(np.intersect1d(own, self.sets[o], assume_unique=True)) for o in others.tolist()])
        if self._lists is None:
            flat = np.concatenate(self.sets)
            owner = np.repeat(np.arange(len(self.sets)), self.sizes)
            order = np.argsort(flat, kind="stable")
            self._lists = flat[order], owner[order]
        values, owner = self._lists
        low, high = np.searchsorted(values, own), np.searchsorted(values, own, "right")
        count = high - low
        at = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.bincount(owner[at], minlength=len(self.sets))[others]


def link_texts(docs: DataFrame, classes: DataFrame, k: int, similarity: float, radius: int, block_rows: int, text_col: str) -> DataFrame:
    """classes: cls, fp, anchors, each class of docs once. Confirmed links a, b between classes."""
    shards = F.explode(F.transform("anchors", lambda v, i: F.xxhash64(i, v)))
    met = written(_blocked(classes.select(F.col("cls").alias("node"), "fp", shards.alias("shard")), block_rows))
    rows = met.join(_shingle_sets(docs, k, text_col, met.select("node")), "node")

    def run(columns: dict[str, list], number: np.ndarray) -> Iterator[tuple]:
        node = columns["node"]
        prints = np.array(columns["fp"], np.int64).view(np.uint64)
        sets, union = _Sets([np.frombuffer(s, "<u4") for s in columns["shingles"]]), Union(len(node))
        for a, b in _tree_pairs(prints, number, np.array(columns["side"]), radius):
            ratio = np.minimum(sets.sizes[a], sets.sizes[b]) / np.maximum(sets.sizes[a], sets.sizes[b])
            a, b = a[ratio >= similarity], b[ratio >= similarity]
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            rows_, starts = np.unique(a, return_index=True)
            for row, start, stop in zip(rows_.tolist(), starts.tolist(), [*starts[1:].tolist(), len(a)]):
                others = b[start:stop]
                others = others[union.roots(others) != union.roots(np.array([row]))[0]]
                if not len(others):
                    continue
                shared = sets.shared(row, others)
                close = shared >= similarity * (sets.sizes[row] + sets.sizes[others] - shared) - 1e-9
                for other in others[close].tolist():
                    if union.join(row, other):
                        yield node[row], node[other]

    return _by_task(rows, ["node", "fp", "shingles", "side"], run, {"a": pa.string(), "b": pa.string()}, "a string, b string", 2000)


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 18, anchors: int = 4, block_rows: int = 4096, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, cls (the text's class), root (its group) and group_id (the least doc_id of the group) of every row."""
    signed = written(_signatures(docs, k, anchors, text_col, id_col))
    classes = signed.groupBy("cls").agg(F.min("doc_id").alias("least"), F.first(F.struct("fp", "anchors")).alias("s"))
    links = link_texts(docs, classes.select("cls", "s.*"), k, similarity, radius, block_rows, text_col)
    linked = components(links)
    rooted = classes.join(linked, classes.cls == linked.node, "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("group_id"))
    return signed.select("doc_id", "cls").join(rooted.join(lowest, "root").select("cls", "root", "group_id"), "cls")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, all columns, that stay: of each group of near-duplicates the row with the least id (a null id only
    if the group has no other); of several such texts or equal rows one."""
    groups = near_duplicates(docs, text_col=text_col, id_col=id_col, **options)
    lowest = groups.where(F.col("doc_id").eqNullSafe(F.col("group_id")))
    stays = lowest.groupBy("root").agg(F.min("cls").alias("c"), F.first("group_id").alias("i")).select("c", "i")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = docs.select(row, class_of(F.col(f"`{text_col}`").cast("string")).alias("cls"), F.col(f"`{id_col}`").cast("long").alias("id"))
    met = marked.join(stays, (F.col("cls") == F.col("c")) & F.col("id").eqNullSafe(F.col("i")))
    return met.dropDuplicates(["cls", "id"]).select("row.*")  # equal rows are combined before the shuffle
