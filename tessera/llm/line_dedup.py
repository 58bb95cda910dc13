"""Line deduplication with a log-template tree, all in DataFrame operations.

A line is parsed to a leaf of a tree of fixed depth: number of tokens, then its first ``depth`` tokens (runs of digits are
one ``#``). Below the leaf the remaining tokens are cut into ``parts`` stretches of equal length; lines of a leaf that agree
in any ``equal`` of them share a template, in which the others are variable. So a line may differ from another in any fields
that touch at most ``parts - equal`` of the stretches, wherever they stand. Lines of fewer than ``least_general`` tokens
have one template, all their tokens. Lines of over ``long_bytes`` are parsed by sentences as well (short ones with the one
after them), each with one template, so that a passage is found inside longer or differently wrapped lines.

A template recurs if it occurs in two different texts. Of a recurring template the units of the text with the least doc_id
stay, all others are dropped, whatever share of a text they are: whole lines, and of other lines the stretches of consecutive
recurring sentences of ``run_bytes`` or more together. Exact copies of a text count as one text and are treated alike. A
text that shares ``copy_share`` or more of its bytes with one text that keeps them is compared with it: at a Jaccard
similarity of ``similarity`` of their sets of five-word shingles it is a near copy, which document deduplication takes as a
whole, and what only that text keeps stays.

Scale: units travel as hashes. One key a unit (the leaf) finds the leaves of two texts or more; only their lines are
compared by stretches. Counts are combined before each shuffle; a template with a third of all lines is one row from each
task. Texts are shuffled once, to meet what they lose; those to compare as near copies are found by hashes that are broadcast
only up to ``BROADCAST_ROWS`` (counted), and only their shingles are shuffled.

Defined cases: a null text stays null and has no lines; a line without tokens always stays; a line of which every sentence
is dropped goes; equal rows get equal results; ties for the text that keeps its lines go to the smaller text hash; a null
doc_id counts as the largest; an empty table gives an empty result; further columns are kept by ``drop_recurring``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .decontaminate import BROADCAST_ROWS, _joined


@dataclass(frozen=True)
class Settings:
    depth: int = 3
    parts: int = 5
    equal: int = 3
    least_general: int = 12
    long_bytes: int = 240
    run_bytes: int = 80
    copy_share: float = 0.5
    similarity: float = 0.8


_LAST = (1 << 63) - 1
_TEXT = ["h1", "h2"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _sentences(line: Column) -> Column:
    """A line cut at the spaces after sentences of over 40 characters; shorter ones stay with the next, since they recur by
    chance. Where a cut falls depends on the sentence before it alone. The space comes first, as the cheap test."""
    return F.split(line, r" (?<=[.!?] )(?<=[^.!?]{40}[.!?] )")


def _units(docs: DataFrame, text: Column, id_col: str, s: Settings) -> DataFrame:
    """id, h1, h2 (hashes of the text), size (its bytes), pos (line), sub (0: the whole line, else a sentence), bytes, key
    (leaf, or template of a unit that has only one) and parts (hashes of the stretches, null without)."""
    # the outer forms keep the optimiser from filtering on second copies of these expressions
    name = [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("h1"), F.crc32(text.cast("binary")).alias("h2"), F.octet_length(text).alias("size")]
    lines = docs.where(text.isNotNull()).select(*name, F.posexplode_outer(_lines(text)).alias("pos", "line"))
    pieces = F.when(F.octet_length("line") > s.long_bytes, F.concat(F.array("line"), _sentences(F.col("line")))).otherwise(F.array("line"))
    units = lines.select("id", *_TEXT, "size", "pos", F.posexplode_outer(pieces).alias("sub", "unit")).where(F.trim("unit") != "")
    masked = F.regexp_replace("unit", "[0-9]+", "#")
    units = units.select("id", *_TEXT, "size", "pos", "sub", F.octet_length("unit").alias("bytes"), masked.alias("masked"))
    units = units.withColumn("tokens", F.when(F.col("sub") == 0, F.split("masked", " "))).withColumn("n", F.size("tokens"))
    rest = F.col("n") - s.depth
    edge = [F.floor(rest * i / s.parts).cast("int") for i in range(s.parts + 1)]
    parts = F.array(*[F.xxhash64(F.slice("tokens", edge[i] + (s.depth + 1), edge[i + 1] - edge[i])) for i in range(s.parts)])
    general = (F.col("sub") == 0) & (F.col("n") >= s.least_general)
    key = F.when(general, F.xxhash64(F.lit(0), "n", F.slice("tokens", 1, s.depth))).otherwise(F.xxhash64(F.least("sub", F.lit(1)) + 1, "masked"))
    return units.select("id", *_TEXT, "size", "pos", "sub", "bytes", key.alias("key"), F.when(general, parts).alias("parts"))


def _templates(s: Settings) -> Column:
    """The templates of a unit: of a general line one for each choice of stretches that are not variable."""
    chosen = [F.xxhash64(F.lit(i), "key", *[F.col("parts")[p] for p in pick]) for i, pick in enumerate(combinations(range(s.parts), s.equal))]
    return F.when(F.col("parts").isNull(), F.array("key")).otherwise(F.array(*chosen))


def recurring_units(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """h1, h2 (hashes of a text), lines (numbers of its lines to drop, from 0) and cuts (other lines: pos and the numbers of
    the sentences to drop, from 1)."""
    s = settings
    text = F.col(f"`{text_col}`").cast("string")
    table = written(_units(docs, text, id_col, s))
    # written, so that the joins read plain tables and Spark can split a hot key's rows
    shared = written(table.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key"))
    met = written(table.join(shared, "key").select("id", *_TEXT, "size", "pos", "sub", "bytes", F.explode_outer(_templates(s)).alias("template")))
    owners = written(met.groupBy("template").agg(F.min(F.struct("id", *_TEXT)).alias("owner"), F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("template", "owner"))
    lost = met.join(owners, "template").where((F.col("owner.h1") != F.col("h1")) | (F.col("owner.h2") != F.col("h2")))
    units = lost.groupBy(*_TEXT, "pos", "sub").agg(F.first("bytes").alias("bytes"), F.first("size").alias("size"), F.collect_set(F.struct("owner.h1", "owner.h2")).alias("owners"))
    of_line = Window.partitionBy(*_TEXT, "pos")  # the units of one line of one text
    units = units.withColumn("whole", F.min("sub").over(of_line) == 0).where(~F.col("whole") | (F.col("sub") == 0))
    units = units.withColumn("run", F.col("sub") - F.row_number().over(of_line.orderBy("sub")))
    units = units.withColumn("together", F.sum("bytes").over(Window.partitionBy(*_TEXT, "pos", "run"))).where(F.col("whole") | (F.col("together") >= s.run_bytes))
    units = written(units.select(*_TEXT, "pos", "sub", "bytes", "size", "owners"))
    left = units.join(_near_copies(docs, units, text, s), _TEXT, "left").where(F.col("near").isNull() | (F.size(F.array_except("owners", "near")) > 0))
    by_line = left.groupBy(*_TEXT, "pos").agg(F.collect_list("sub").alias("subs")).withColumn("whole", F.array_contains("subs", 0))
    dropped, cut = F.collect_list(F.when(F.col("whole"), F.col("pos"))), F.collect_list(F.when(~F.col("whole"), F.struct("pos", "subs")))
    return by_line.groupBy(*_TEXT).agg(dropped.alias("lines"), cut.alias("cuts"))


def _shingles(docs: DataFrame, text: Column) -> DataFrame:
    """docs with ``set``: the distinct hashes of five words in a row, or of all words if there are fewer."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " ")), " ")
    made = docs.withColumn("words", words).withColumn("w1", F.transform("words", lambda w: F.xxhash64(w)))
    made = made.withColumn("w2", _joined(F.col("w1"), F.col("w1"), 1))
    made = made.withColumn("w4", _joined(F.col("w2"), F.col("w2"), 2))
    made = made.withColumn("w5", _joined(F.col("w4"), F.col("w1"), 4))
    return made.withColumn("set", F.when(F.size("words") < 5, F.array(F.xxhash64("words"))).otherwise(F.array_distinct("w5")))


def _near_copies(docs: DataFrame, units: DataFrame, text: Column, s: Settings) -> DataFrame:
    """h1, h2 and near: the texts (at most a few) of which this one is a near copy, verified on whole shingle sets."""
    shares = units.select(*_TEXT, "bytes", "size", F.explode("owners").alias("o")).groupBy(*_TEXT, "o").agg(F.sum("bytes").alias("shared"), F.first("size").alias("size"))
    pairs = written(shares.where(F.col("shared") >= s.copy_share * F.col("size")).select(*_TEXT, "o"))
    wanted = pairs.select(*_TEXT).unionByName(pairs.select("o.h1", "o.h2")).distinct()
    wanted = F.broadcast(wanted) if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else wanted
    asked = docs.where(text.isNotNull()).select(F.xxhash64(text).alias("h1"), F.crc32(text.cast("binary")).alias("h2"), text.alias("t")).join(wanted, _TEXT, "left_semi")
    sets = written(_shingles(asked.dropDuplicates(_TEXT), F.col("t")).select(*_TEXT, "set"))
    both = pairs.join(sets, _TEXT).join(sets.select(F.struct(*_TEXT).alias("o"), F.col("set").alias("kept")), "o")
    common = F.size(F.array_intersect("set", "kept"))
    close = common >= s.similarity * (F.size("set") + F.size("kept") - common) - 1e-9
    return both.where(close).groupBy(*_TEXT).agg(F.collect_set("o").alias("near"))


def _cleaned(docs: DataFrame, text_col: str, id_col: str, settings: Settings) -> DataFrame:
    """row (all columns), lines, gone and cuts (null: none)."""
    gone = recurring_units(docs, text_col, id_col, settings).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("lines").alias("gone"), "cuts")
    text = F.col(f"`{text_col}`").cast("string")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = docs.select(row, F.xxhash64(text).alias("h1"), F.crc32(text.cast("binary")).alias("h2"))
    joined = marked.join(gone, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    return joined.select("row", _lines(F.col(f"row.`{text_col}`").cast("string")).alias("lines"), "gone", "cuts")


def _kept() -> Column:
    """The text without what goes. Numbers of kept lines and sentences are set differences, so long texts take linear time."""
    numbered = lambda p, line: F.struct(p.alias("p"), line.alias("line"))
    whole = F.array_except(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), F.transform("cuts", lambda c: c.pos))

    def rest(cut: Column) -> Column:
        sentences = _sentences(F.get("lines", cut.pos))
        left = F.array_except(F.sequence(F.lit(1), F.size(sentences)), cut.subs)
        return numbered(cut.pos, F.array_join(F.transform(left, lambda i: F.get(sentences, i - 1)), " "))

    cut = F.filter(F.transform("cuts", rest), lambda x: x.line != "")
    lines = F.concat(F.transform(whole, lambda p: numbered(p, F.get("lines", p))), cut)
    return F.array_join(F.transform(F.sort_array(lines), lambda x: x.line), "\n")


def drop_recurring(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", settings: Settings = Settings(), n_chars_col: str | None = None) -> DataFrame:
    """docs with the recurring lines and passages taken out of the text; n_chars_col, if given, is set to the new length."""
    cleaned = _cleaned(docs, text_col, id_col, settings)
    text = F.when(F.col("gone").isNull(), F.col(f"row.`{text_col}`")).otherwise(_kept())
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns} | {text_col: F.col("_kept")}
    if n_chars_col:
        columns[n_chars_col] = F.when(F.col("gone").isNull(), F.col(f"row.`{n_chars_col}`")).otherwise(F.length("_kept").cast(docs.schema[n_chars_col].dataType))
    return cleaned.withColumn("_kept", text).select(*[column.alias(c) for c, column in columns.items()])


def line_report(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_lines, n_dropped (lines), n_cut (sentences of other lines) and the text that stays, of every row."""
    cleaned = _cleaned(docs, text_col, id_col, settings)
    old = F.col(f"row.`{text_col}`")
    n = F.when(old.isNull(), 0).otherwise(F.size("lines"))
    text = F.when(F.col("gone").isNull(), old).otherwise(_kept())
    n_cut = F.aggregate("cuts", F.lit(0), lambda a, c: a + F.size(c.subs))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(name) for c, name in ((n, "n_lines"), (F.size("gone"), "n_dropped"), (n_cut, "n_cut"))]
    return cleaned.select(F.col(f"row.`{id_col}`").alias("doc_id"), *counts, text.alias("text"))
