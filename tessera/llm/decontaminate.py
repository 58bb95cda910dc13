"""Benchmark decontamination by templates, all in DataFrame operations.

Texts and benchmark items become templates: lower-cased words in which numbers are ``#``, capitalised words inside a
sentence (names) ``^`` and units after a number ``~``. A run of numbers or of names is one word ("1,200", "New York"). Windows of ``width`` template words are joined by their hash and then
compared word by word. Inserted and lost words shift the alignment, so the windows of a document and an item that match at
shifts at most ``slack`` words apart are added up. Such a match lists the slots: which value of the item stands where which
value of the document does. A place conflicts if its value is changed there and
changed to something else at another place; values that stay as they are conflict with nothing. If at most
``conflicts`` of the places do, the document holds the item, verbatim or with other numbers and names. It is contaminated
if that covers ``coverage`` of the item's windows, or, whatever the conflicts, if windows with equal slots cover ``verbatim``.

Case tells names, so there is a second, plain form beside the named one: the lower-cased words without names. Windows are
looked for in both forms; copies in capitals, title case or lower case agree in the plain one. A text or item without names
has one form that serves as both.

A window needs ``literals`` words that are no placeholders. An item shorter than ``width`` is one window. An item of fewer
than ``least_words`` words stands in any text by chance, so the documents that hold it are those that consist of its words
and nothing else.

Scale: windows of documents are made and probed within a task against the benchmark's windows, which are broadcast only up
to ``BROADCAST_BYTES`` (summed first) and joined by a shuffle beyond that. Only hits are shuffled.

Defined cases: null and empty texts hold nothing; null doc_ids are matched like others; equal rows give one result; an item
that occurs twice is reported at its best alignment (contaminated, then most windows); ties go to the earlier alignment; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows of two hashes that are broadcast at most, and bytes of windows.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 50 << 20
#: Units that are slots when they follow a number.
UNITS = "mm cm m km kg g mg lb lbs oz ml l mph kph kmh hours hour minutes minute seconds second days day weeks week months month years year dollars dollar cents euros percent degrees miles mile feet foot inches inch meters metres litres liters grams kilograms"


@dataclass(frozen=True)
class Settings:
    width: int = 8
    literals: int = 4
    least_words: int = 4
    coverage: float = 0.5
    slack: int = 16
    conflicts: float = 0.2
    verbatim: float = 2 / 3


def _words(text: Column) -> Column:
    """Raw words, lower-cased; a name has ``^`` in front. Names are capitalised words that follow a word within a sentence."""
    named = F.regexp_replace(text, r" (?<=[\p{L}\p{N},;:] )(?=\p{Lu}\p{L})", " ^")
    # single spaces between words are left alone: replacing every one of them would cost more than all the rest
    bare = F.regexp_replace(named, r" ?[^\p{L}\p{N}^ ]+ ?", " ")
    words = F.trim(F.lower(F.regexp_replace(bare, "  +", " ")))
    return F.regexp_replace(words, r" (?<=[0-9] )(?=[0-9]+(?: |$))(?<=(?:^| )[0-9]{1,40} )", "_")


def _forms(words: Column) -> Column:
    """The forms of a text: words, and kind (0 named, 1 plain, 2 both in one)."""
    form = lambda w, kind: F.struct(w.alias("words"), F.lit(kind).alias("kind"))
    return F.when(F.contains(words, F.lit("^")), F.array(form(F.regexp_replace(words, r" (?=\^)(?<=\^[^ ]{1,80} )", "_"), 0), form(F.translate(words, "^", ""), 1))).otherwise(F.array(form(words, 2)))


def _template(words: Column) -> Column:
    names = F.regexp_replace(words, r"\^+[^ ]*", "^")
    numbers = F.regexp_replace(names, r"[0-9]+(?:_[0-9]+)*", "#")
    return F.regexp_replace(numbers, rf"# (?:{UNITS.replace(' ', '|')})(?= |$)", "# ~")


def _joined(first: Column, then: Column, offset: int) -> Column:
    """Hashes of stretches: each of ``first`` with the one of ``then`` that starts ``offset`` words later."""
    later = F.slice(then, offset + 1, F.greatest(F.size(then) - offset, F.lit(0)))
    return F.zip_with(F.slice(first, 1, F.size(later)), later, lambda a, b: F.xxhash64(a, b))


def _windows(rows: DataFrame, sizes: list[int], keep: list[str]) -> DataFrame:
    """rows: words, template (strings) and further columns. One row for each window: pos, size, h, and the columns kept."""
    split = rows.select(*keep, F.split("words", " ").alias("raw"), F.split("template", " ").alias("canon"))
    # hashes of 1, 2, 4, ... words, each a column of its own made of two neighbours of the one before: slices or elements of
    # the word array inside a lambda would cost many times more
    split = split.withColumn("h1_", F.transform("canon", lambda x: F.xxhash64(x)))
    power = 1
    while power * 2 <= max(sizes):
        split = split.withColumn(f"h{power * 2}_", _joined(F.col(f"h{power}_"), F.col(f"h{power}_"), power))
        power *= 2

    def hashes(size: int) -> Column:
        made, done = None, 0
        for bit in reversed(range(size.bit_length())):
            if size >> bit & 1:
                made = F.col(f"h{1 << bit}_") if made is None else _joined(made, F.col(f"h{1 << bit}_"), done)
                done += 1 << bit
        return made

    out = None
    for size in sizes:
        # a lambda inside the generator would take it, and the join above it, out of code generation, and then the word
        # arrays would be copied for every window and not for hits only. The outer form keeps the optimiser from filtering
        # on a second copy of the whole expression; the join drops its null rows
        part = split.withColumn("hashes", hashes(size)).select(*keep, "raw", "canon", F.posexplode_outer("hashes").alias("pos", "h"), F.lit(size).alias("size"))
        out = part if out is None else out.unionByName(part)
    return out


def _short_items(docs: DataFrame, benchmark: DataFrame, s: Settings, doc_text: str, doc_id: str, text_col: str, id_col: str) -> DataFrame | None:
    """find_items for items of fewer than least_words words; None if there are none."""
    def few(rows: DataFrame, column: str) -> DataFrame:
        words = rows.withColumn("words", _words(F.col(f"`{column}`").cast("string"))).where(F.length("words") > 0)
        # the limit spares splitting whole texts
        return words.where(F.size(F.split("words", " ", s.least_words + 1)) < s.least_words).withColumn("words", F.translate("words", "^", ""))

    items = written(few(benchmark.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("t")), "t").select("item_id", "words").distinct())
    if items.isEmpty():
        return None
    text = F.col(f"`{doc_text}`").cast("string")
    asked = few(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), text.alias("t")), "t")
    one = F.lit(1).cast("long")
    met = asked.join(items, "words").select("doc_id", "h1", "item_id").distinct()
    return met.select("doc_id", "h1", "item_id", one.alias("matched"), one.alias("windows"), F.lit(1.0).alias("coverage"), F.lit(0).cast("long").alias("slots"), F.lit(True).alias("consistent"), F.lit(True).alias("contaminated"))


def benchmark_windows(benchmark: DataFrame, s: Settings, text_col: str, id_col: str) -> DataFrame:
    """item_id, bkind, bpos, size, windows (of the item's form), h, bcanon, braw, btext: the windows to look for."""
    text = F.col(f"`{text_col}`").cast("string")
    words = benchmark.select(F.col(f"`{id_col}`").alias("item_id"), _words(F.coalesce(text, F.lit(""))).alias("words"))
    words = words.select("item_id", F.explode(_forms(F.col("words"))).alias("f")).select("item_id", "f.words", F.col("f.kind").alias("bkind"))
    items = words.withColumn("template", _template(F.col("words"))).withColumn("n", F.size(F.split("words", " ")))
    items = items.where((F.col("n") >= s.least_words) & (F.length("words") > 0)).distinct()
    items = written(items)  # the filters below would otherwise be planned through all of the above, many times over
    sizes = [r[0] for r in items.select(F.least("n", F.lit(s.width)).alias("s")).distinct().orderBy("s").collect()]  # at most width values
    if not sizes:
        return None
    made = _windows(items, sizes, ["item_id", "bkind", "n"]).where(F.col("h").isNotNull() & (F.col("size") == F.least("n", F.lit(s.width))))
    cut = made.select("item_id", "bkind", F.col("pos").alias("bpos"), "size", "h", F.expr("slice(canon, pos + 1, size)").alias("bcanon"), F.expr("slice(raw, pos + 1, size)").alias("braw"))
    literal = F.size(F.filter("bcanon", lambda t: ~t.rlike("[#^~]")))
    kept = written(cut.where(literal >= F.least(F.lit(s.literals), F.col("size"))))
    kept = kept.withColumn("btext", F.concat(F.concat_ws(" ", "bcanon"), F.lit(" ")))
    totals = kept.groupBy("item_id", "bkind").agg(F.count_distinct("bpos").alias("windows"))
    return written(kept.join(totals, ["item_id", "bkind"]))


def find_items(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text_col: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row for each document and item of which any window matches: doc_id, h1 (hash of the text), item_id, matched,
    windows, coverage, slots (with another value), consistent, contaminated."""
    found = _long_items(docs, benchmark, settings, text_col, id_col, item_text, item_id)
    short = _short_items(docs, benchmark, settings, text_col, id_col, item_text, item_id)
    return found if short is None else found.unionByName(short)


def _long_items(docs: DataFrame, benchmark: DataFrame, settings: Settings, text_col: str, id_col: str, item_text: str, item_id: str) -> DataFrame:
    wanted = benchmark_windows(benchmark, settings, item_text, item_id)
    text = F.col(f"`{text_col}`").cast("string")
    if wanted is None:
        empty = docs.where("false").select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"))
        kind = benchmark.schema[item_id].dataType
        return empty.select("doc_id", "h1", F.lit(None).cast(kind).alias("item_id"), F.lit(0).cast("long").alias("matched"), F.lit(0).cast("long").alias("windows"), F.lit(0.0).alias("coverage"), F.lit(0).cast("long").alias("slots"), F.lit(True).alias("consistent"), F.lit(False).alias("contaminated"))
    sizes = [r[0] for r in wanted.select("size").distinct().orderBy("size").collect()]
    words = docs.where(text.isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), _words(text).alias("words"))
    words = words.select("doc_id", "h1", F.explode(_forms(F.col("words"))).alias("f")).select("doc_id", "h1", "f.words", "f.kind")
    probed = _windows(words.withColumn("template", _template(F.col("words"))), sizes, ["doc_id", "h1", "kind"])
    heavy = wanted.agg(F.sum(3 * F.octet_length("btext") + 200)).first()[0] or 0
    small = heavy <= BROADCAST_BYTES
    # a prefix test, not an equality of the two sides: that would become a join key computed for every window
    window = F.expr("concat(concat_ws(' ', slice(canon, pos + 1, size)), ' ')")
    hits = probed.join(F.broadcast(wanted) if small else wanted, ["h", "size"]).where(F.startswith(window, F.col("btext")))
    hits = hits.where(F.col("kind") + F.col("bkind") != 1)  # like meets like
    hits = hits.select("doc_id", "h1", "item_id", "windows", F.least("kind", "bkind").alias("kind"), "bpos", (F.col("pos") - F.col("bpos")).alias("shift"), "bcanon", "braw", F.expr("slice(raw, pos + 1, size)").alias("raw"))
    filled = F.transform("braw", lambda b, i: F.struct((F.col("bpos") + i).alias("place"), b.alias("b"), F.get("raw", i).alias("d")))
    hits = hits.withColumn("pairs", F.filter(filled, lambda p, i: F.get("bcanon", i).rlike("[#^~]"))).drop("braw", "raw", "bcanon")
    hits = hits.withColumn("same", F.forall("pairs", lambda p: p.b == p.d))
    # any two shifts at most slack apart share one of these overlapping stretches
    stretch = F.floor(F.col("shift") / settings.slack)
    hits = hits.withColumn("stretch", F.explode(F.array(stretch, stretch + 1)))
    one = hits.groupBy("doc_id", "h1", "item_id", "kind", "stretch").agg(
        F.first("windows").alias("windows"), F.count_distinct("bpos").alias("matched"), F.count_distinct(F.when(F.col("same"), F.col("bpos"))).alias("same"), F.min("shift").alias("shift"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )  # an item's windows bound what is collected
    places = lambda pairs: F.size(F.array_distinct(F.transform(pairs, lambda p: p.place)))
    one = one.withColumn("changed", F.array_distinct(F.transform(F.filter("pairs", lambda p: p.b != p.d), lambda p: F.struct(p.b.alias("b"), p.d.alias("d")))))
    clashing = F.filter("pairs", lambda p: (p.b != p.d) & F.exists("changed", lambda q: (q.b == p.b) & (q.d != p.d)))
    consistent = places(clashing) <= settings.conflicts * places(F.col("pairs"))
    one = one.withColumn("consistent", consistent).withColumn("coverage", F.col("matched") / F.col("windows"))
    held = F.col("consistent") & (F.col("coverage") >= settings.coverage) | (F.col("same") / F.col("windows") >= settings.verbatim)
    rated = one.select("doc_id", "h1", "item_id", F.struct(held.alias("contaminated"), "coverage", "consistent", (-F.col("shift")).alias("early"), "matched", "windows", F.size("changed").cast("long").alias("slots")).alias("r"))
    best = rated.groupBy("doc_id", "h1", "item_id").agg(F.max("r").alias("r"))
    return best.select("doc_id", "h1", "item_id", "r.matched", "r.windows", "r.coverage", "r.slots", "r.consistent", "r.contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text_col: str = "text", id_col: str = "doc_id", **names: str) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    found = written(find_items(docs, benchmark, settings, text_col, id_col, **names).where("contaminated").select(F.col("doc_id").alias("i"), F.col("h1").alias("h")).distinct())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = docs.select(row, F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("h1"))
    small = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return marked.join(F.broadcast(found) if small else found, F.col("id").eqNullSafe(F.col("i")) & (F.col("h1") == F.col("h")), "left_anti").select("row.*")
