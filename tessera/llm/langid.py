"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of labelled training text. A text is encoded with every
dictionary; the one that gives the fewest bytes names the language. All texts are encoded alike, in independent blocks, so
that the dictionary and not the text's own history decides in every part; sizes are summed over the whole text.

Defined cases: a null text or one without any letter gets ``und`` with score 0 and is rejected; equal sizes go to the
language with more training rows (then the smaller name) with score 0.5 and are rejected as too narrow; repeated rows get
the same answer each, and count as one text in the sample; an empty table gives an empty result; columns other than those
named are neither read nor needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import short_batches

UNKNOWN = "und"
#: Bytes of all dictionaries together, which go to every executor: with very many languages each one's is smaller.
MODEL_BYTES = 16 << 20
#: Labels above this number, more than there are languages, are refused: they name something else.
MAX_LANGUAGES = 8192
#: Groups that a language's texts are ranked in before the sample is picked, so that a common language is not one task's work.
_SALTS = 64
_ASCII_LETTER = re.compile("[A-Za-z]")
#: Bytes that are not letters separate words only; bytes of multi-byte characters stay.
_TO_SPACE = bytes(i if i > 127 or chr(i).isalpha() else 32 for i in range(256))


@dataclass(frozen=True)
class Model:
    """Languages (most training rows first), their dictionaries and how to encode with them."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    level: int
    block_bytes: int
    min_margin: float


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def canonical(text: str) -> bytes:
    """Lower-cased UTF-8 with ASCII punctuation and digits as spaces."""
    return text.lower().encode("utf-8", "replace").translate(_TO_SPACE)


def train(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = 96,
    dictionary_bytes: int = 32768,
    level: int = 12,
    block_bytes: int = 1024,
    min_margin: float = 0.0005,
) -> Model:
    """Dictionaries from a bounded sample of whole texts: of each language ``sample_docs`` texts at most, up to
    ``dictionary_bytes`` together. Texts of 1/64 of that or less come first, by their hash, then longer ones by length; texts
    over the limit are no sample. That is the documented bound of the training sample; what comes to the driver is at most
    MODEL_BYTES. Label counts cover all rows.
    """
    text, label = F.col(f"`{text_col}`").cast("string"), F.col(f"`{lang_col}`").cast("string")
    rows = labelled.select(text.alias("text"), label.alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} language labels")
    most = min(dictionary_bytes, MODEL_BYTES // max(len(counts), 1))
    size = F.octet_length("text")
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("size", size).withColumn("long", F.greatest("size", F.lit(most // 64)))
    order = ["long", "h"]
    first = Window.partitionBy("lang", F.pmod("h", F.lit(_SALTS))).orderBy(*order)
    last = Window.partitionBy("lang").orderBy(*order)
    picked = rows.where(F.col("size") <= most).select("lang", "h", "size", "long").distinct().withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample_docs)
    picked = picked.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= sample_docs).withColumn("upto", F.sum("size").over(last))
    picked = picked.where(F.col("upto") <= most).select("lang", "h")
    texts = rows.join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    found: dict[str, list[tuple[int, str]]] = {lang: [] for lang in counts}
    for r in texts:
        found[r["lang"]].append((r["h"], r["text"]))
    languages = sorted(counts, key=lambda lang: (-counts[lang], lang))
    contents = tuple(b" ".join(canonical(text) for _, text in sorted(found[lang])) for lang in languages)
    return Model(tuple(languages), contents, level, block_bytes, min_margin)


class Classifier:
    """Encodes texts with a model's dictionaries; made once in each Python worker."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.coders = [self._coders(data, model.level) for data in model.dictionaries]

    @staticmethod
    def _coders(data: bytes, level: int) -> zstandard.ZstdCompressor:
        if not data:
            return zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
        made = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)

    def sizes(self, data: bytes) -> list[int]:
        """Encoded bytes by language."""
        step = self.model.block_bytes
        blocks = [data[i : i + step] for i in range(0, len(data), step)]
        return [sum(len(coder.compress(b)) for b in blocks) for coder in self.coders]

    def classify(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score from 0 to 1, margin (bytes saved against the runner-up, per byte), and whether it is rejected."""
        if text is None or not self.coders or not has_letter(text):
            return UNKNOWN, 0.0, 0.0, True
        data = canonical(text)
        sizes = self.sizes(data)
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best = order[0]
        gap = sizes[order[1]] - sizes[best] if len(order) > 1 else len(data)
        margin = gap / len(data)
        return self.model.languages[best], 1.0 - 0.5 ** (1.0 + gap / 4.0), margin, margin < self.model.min_margin


_SCHEMA = "lang_pred string, score double, margin double, rejected boolean"


def _classified(docs: DataFrame, model: Model, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns under internal names, and the four results. One pass, no shuffle."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MODEL_BYTES at most
    kept = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]
    width = len(kept)
    rows = docs.select(*kept, F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for batch in batches:
            out = [classifier.classify(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = list(zip(*out)) or [(), (), (), ()]
            types = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(width)] + [pa.array(c, t) for c, t in zip(columns, types)],
                [f"_k{i}" for i in range(width)] + ["lang_pred", "score", "margin", "rejected"],
            )

    schema = ", ".join([f"_k{i} {rows.schema[f'_k{i}'].dataType.simpleString()}" for i in range(width)] + [_SCHEMA])
    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row with lang_pred, score, margin and rejected."""
    out = _classified(docs, model, text_col, keep)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "margin", "rejected")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language is told: what the classifier rejects goes."""
    out = _classified(docs, model, text_col, tuple(docs.columns)).where(~F.col("rejected"))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)])
