"""Order-preserving packing of token sequences by dynamic programming.

Documents are encoded, each followed by the end id, and laid end to end in the order of the table's partitions. Windows of
at most ``size`` tokens are cut from that line. Cuts fall at the ends of documents or sentences (inside a stretch without
any, at every ``grid``-th token); the dynamic programme chooses those that minimise padding plus penalties: ``cut_sentence``
for a document cut between sentences, ``cut_inside`` for a cut within one, ``extra`` for a window that is short.

With p the places, cost(j) = min over i of cost(i) + p(i) + size - p(j) + penalty(j), for p(j) - p(i) <= size: the least
cost(i) + p(i) of a sliding window, kept in a monotone queue, so each place enters and leaves once. A window whose length is
a power of two (from ``least_short``) needs no padding and is tried beside it.

A partition is packed in blocks of ``block_tokens``, each by an optimal choice of cuts; the last, open window of a block is
carried into the next one, so only the end of a partition is left with a short window. One pass, no shuffle, bounded memory:
texts are encoded some megabytes at a time, and nothing is remembered between them.

Defined cases: a null text is empty and is its end id alone; a null doc_id is packed like others; special tokens written in
a text become their ids, as in the tokenizer's plain call; repeated rows are packed each; an empty table has no pieces.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches


@dataclass(frozen=True)
class Settings:
    size: int = 1024
    end_id: int = 0
    block_tokens: int = 1 << 18
    grid: int = 64
    cut_sentence: int = 2
    cut_inside: int = 32
    extra: int = 24
    least_short: int = 128


def cuts(places: list[int], penalties: list[int], s: Settings) -> list[int]:
    """The chosen places, first and last included. places ascend from 0 with gaps of at most size."""
    n = len(places)
    at = {p: i for i, p in enumerate(places)}
    cost = [0] * n
    back = [0] * n
    queue: deque[int] = deque([0])
    short = [1 << k for k in range(s.size.bit_length()) if s.least_short <= 1 << k < s.size]
    size, extra = s.size, s.extra
    for j in range(1, n):
        p = places[j]
        while p - places[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        length = p - places[i]
        best = cost[i] + (size - length + extra if length < size else 0)
        k = at.get(p - size)  # a full window, which costs nothing, may stand behind the head of the queue
        if k is not None and cost[k] < best:
            best, i = cost[k], k
        for power in short:
            k = at.get(p - power)
            if k is not None and cost[k] + extra < best:
                best, i = cost[k] + extra, k
        cost[j] = best + penalties[j]
        back[j] = i
        key = cost[j] + p
        while queue and cost[queue[-1]] + places[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    chosen = [n - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return [places[i] for i in reversed(chosen)]


def places_of(total: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, s: Settings) -> tuple[list[int], list[int]]:
    """Places where a window may end, with penalties: ends of documents, of sentences, and a grid inside longer stretches."""
    known = np.unique(np.concatenate([[0, total], doc_ends, sentence_ends]))
    gaps = np.diff(known)
    wide = np.flatnonzero(gaps > s.size // 4)
    grid = [np.arange(known[i] + s.grid, known[i + 1], s.grid) for i in wide]
    places = np.unique(np.concatenate([known, *grid]))
    penalty = np.full(len(places), s.cut_inside)
    penalty[np.isin(places, sentence_ends)] = s.cut_sentence
    penalty[np.isin(places, doc_ends)] = 0
    return places.tolist(), penalty.tolist()


# --- encoding ----------------------------------------------------------------------------------------------------------


#: The byte-level pre-tokenizer's pattern.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _visible_bytes() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself, the others in order from U+0100 on."""
    as_is = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in as_is]
    return {chr(b): b for b in as_is} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranked(config: dict) -> tuple[Callable[[str], list[int]], np.ndarray] | tuple[None, None]:
    """The same byte-level merges as ranks, which encode a word several times faster, and each id's bytes; None for other
    kinds of tokenizer.

    Needs what makes ranks equal to merges: ids that ascend with the merges, and no normaliser, prefix or dropout.
    """
    model, before = config["model"], config["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and config["normalizer"] is None and before.get("type") == "ByteLevel"
    plain = plain and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None, None
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:])) or len(model["vocab"]) != len(made) + 256:
        return None, None
    import tiktoken

    table = _visible_bytes()
    ranks = {bytes(map(table.__getitem__, piece)): i for piece, i in model["vocab"].items()}
    encode = tiktoken.Encoding("ranked", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return encode, np.array([len(b) for b in sorted(ranks, key=ranks.__getitem__)])


class Encoder:
    """Encodes texts with a byte-level BPE tokenizer, some megabytes at a time; each word among them is encoded once.

    Its pre-tokenizer always parts a character that is no white space from a following white space, and white space from a
    following space and word. So the ids of a usual text are those of its words with the one space or line feed before each.
    Texts with longer stretches of white space are cut only before a stretch; a text with white space other than spaces and
    line feeds, or with an added token, is encoded in one piece. Words of Latin script go through the merges as ranks, others
    through the tokenizer.
    """

    _parts = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall
    _other_space = re.compile(r"[^\S \n]").search
    _latin_word = re.compile("[ \n]?[!-~\u00a1-\u024f]*").fullmatch
    _joins = r"\A[ \n][!-~\x{a1}-\x{24f}]+\z"
    _unusual = r"  | \n|\n\n\n|\n\n |\n\n\z|[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    _cut = "\x1f"  # in no usual text

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            self.ranked, self.id_bytes = _ranked(json.load(file))
        self.end_id = end_id
        size = self.tokenizer.get_vocab_size()
        self.ends_sentence = np.zeros(size, bool)
        for i in range(size):
            piece = self.tokenizer.decode([i])
            self.ends_sentence[i] = "\n" in piece or piece.rstrip("\"')]").endswith((".", "!", "?", "。"))

    def _has_added(self, text: str) -> bool:
        return any(token in text for token in self.added)

    def _any_added(self, texts: pa.Array) -> pa.Array:
        found = pa.nulls(len(texts), pa.bool_()).fill_null(False)
        for token in self.added:  # a handful
            found = pc.or_(found, pc.match_substring(texts, token))
        return found

    def _alone(self, words: list[str]) -> list[list[int]]:
        """The ids of words that are encoded each on its own."""
        latin = [bool(self.ranked and self._latin_word(w) and not self._has_added(w)) for w in words]
        others = iter(self.tokenizer.encode_batch_fast([w for w, x in zip(words, latin) if not x], add_special_tokens=False))
        return [self.ranked(w) if x else next(others).ids for w, x in zip(words, latin)]

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct words, and how many each has. Latin words that start with a space or line feed are encoded in
        one call: such a start always begins a new piece, and the bytes of the ids tell where each word ends."""
        joined = np.zeros(len(words), bool)
        if self.ranked:
            joined = pc.and_not(pc.match_substring_regex(words, self._joins), self._any_added(words)).to_numpy(zero_copy_only=False)
        counts = np.zeros(len(words), np.int64)
        ids = np.zeros(0, np.uint32)
        if joined.any():
            some = words.filter(pa.array(joined))
            ids = np.array(self.ranked("".join(some.to_pylist())), np.uint32)
            stops, ends = np.cumsum(self.id_bytes[ids]), np.cumsum(pc.binary_length(some).to_numpy())
            upto = np.searchsorted(stops, ends)
            if not (stops[upto] == ends).all():
                raise ValueError("words were not encoded one by one")
            counts[joined] = np.diff(upto + 1, prepend=0)
        alone = self._alone(words.filter(pa.array(~joined)).to_pylist())
        counts[~joined] = [len(x) for x in alone]
        out = np.empty(int(counts.sum()), np.uint32)
        of_joined = np.repeat(joined, counts)
        out[of_joined] = ids
        out[~of_joined] = list(chain.from_iterable(alone))
        return out, counts

    def _words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, in order, and the text of each."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        unusual = pc.or_(pc.match_substring_regex(texts, self._unusual), self._any_added(texts))
        odd = np.flatnonzero(unusual.to_numpy(zero_copy_only=False))
        marked = texts
        if len(odd):
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            marked = pc.if_else(pa.array(mask), "", texts)
        for space in " \n":
            marked = pc.replace_substring(marked, space, self._cut + space)
        lists = pc.split_pattern(marked, self._cut)
        words, owner = lists.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
        if len(odd):
            parts = [[t] if self._other_space(t) or self._has_added(t) else self._parts(t) for t in texts.take(pa.array(odd)).to_pylist()]
            words = pa.concat_arrays([words, pa.array(list(chain.from_iterable(parts)), words.type)])
            owner = np.concatenate([owner, np.repeat(odd, [len(p) for p in parts])])
            order = np.argsort(owner, kind="stable")
            words, owner = words.take(pa.array(order)), owner[order]
        return words, owner

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's end id included, and the ids of each text."""
        words, owner = self._words(texts)
        coded = words.dictionary_encode()
        flat, sizes = self._ids(coded.dictionary)
        number = coded.indices.to_numpy()
        lengths = sizes[number]
        counts = np.bincount(owner, lengths, len(texts)).astype(np.int64) + 1
        at = np.arange(int(lengths.sum())) + np.repeat((np.cumsum(sizes) - sizes)[number] - (np.cumsum(lengths) - lengths), lengths)
        out = np.full(int(counts.sum()), self.end_id, np.uint32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(counts) - 1] = False
        out[inner] = flat[at]
        return out, counts


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _groups(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts of about so many bytes at a time, whatever the batches' size."""
    keys: list = []
    texts: list[pa.Array] = []
    size = 0
    for batch in batches:
        column, start = batch.column(1), 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
            size += n
            if size >= most:
                keys += batch.column(0)[start : i + 1].to_pylist()
                yield keys, pa.concat_arrays([*texts, column[start : i + 1]])
                keys, texts, size, start = [], [], 0, i + 1
        if start < len(column):
            keys += batch.column(0)[start:].to_pylist()
            texts.append(column[start:])
    if texts:
        yield keys, pa.concat_arrays(texts)


# --- the operator ------------------------------------------------------------------------------------------------------

_PIECE = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Packs a stream of documents; yields pieces with their ids."""

    def __init__(self, first_sequence: int, ends_sentence: np.ndarray, settings: Settings) -> None:
        self.sequence, self.ends_sentence, self.s = first_sequence, ends_sentence, settings
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int, int]] = []  # id, tokens before the stretch, of the stretch, of the document
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        for at in range(0, len(ids), self.s.block_tokens):
            part = ids[at : at + self.s.block_tokens]
            self.ids.append(part)
            self.docs.append((doc_id, at, len(part), len(ids)))
            self.size += len(part)
            if self.size >= self.s.block_tokens:
                yield from self.pack(False)

    def pack(self, last: bool) -> Iterator[tuple]:
        if not self.size:
            return
        ids = np.concatenate(self.ids)
        lengths = np.array([d[2] for d in self.docs])
        ends = np.cumsum(lengths)
        whole = np.array([d[1] + d[2] == d[3] for d in self.docs])
        sentences = np.flatnonzero(self.ends_sentence[ids]) + 1
        chosen = np.array(cuts(*places_of(len(ids), ends[whole], sentences, self.s), self.s))
        stop = len(ids) if last or len(chosen) < 3 else int(chosen[-2])
        bounds = chosen[chosen <= stop]
        starts = ends - lengths
        edges = np.unique(np.concatenate([bounds, starts[starts < stop], [stop]]))
        doc = np.searchsorted(ends, edges[:-1], "right")
        window = np.searchsorted(bounds, edges[:-1], "right") - 1
        raw = ids.astype("<u4")
        for a, b, d, w in zip(edges[:-1].tolist(), edges[1:].tolist(), doc.tolist(), window.tolist()):
            key, before, _, tokens = self.docs[d]
            yield key, before + a - int(starts[d]), b - a, raw[a:b], tokens, self.sequence + w, a - int(bounds[w])
        self.sequence += len(bounds) - 1
        kept = np.flatnonzero(ends > stop)
        if not len(kept):
            self.ids, self.docs, self.size = [], [], 0
            return
        cut = max(0, stop - int(starts[kept[0]]))
        head = self.docs[kept[0]]
        self.docs = [(head[0], head[1] + cut, head[2] - cut, head[3])] + [self.docs[i] for i in kept[1:]]
        self.ids, self.size = [ids[stop:]], len(ids) - stop


def pack(docs: DataFrame, tokenizer: str, settings: Settings = Settings(), text_col: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start (ids of the document before it), length, ids_crc32, doc_tokens, sequence_id, offset, and with
    ``with_ids`` the ids themselves. Sequence numbers are unique; each partition of docs has its own range."""
    short_batches(docs.sparkSession)
    types = _PIECE | ({"ids": pa.list_(pa.int32())} if with_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, settings.end_id)
        packer = Packer(TaskContext.get().partitionId() << 40, coder.ends_sentence, settings)

        def rows(pieces: Iterator[tuple]) -> pa.RecordBatch:
            out = [(k, s, n, zlib.crc32(ids.tobytes()), t, q, o, *([ids.tolist()] if with_ids else [])) for k, s, n, ids, t, q, o in pieces]
            columns = list(zip(*out)) or [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], list(types))

        for keys, texts in _groups(batches):
            ids, counts = coder.encode(texts)
            for key, stop, count in zip(keys, np.cumsum(counts).tolist(), counts.tolist()):
                if (done := rows(packer.add(key, ids[stop - count : stop]))).num_rows:
                    yield done
        yield rows(packer.pack(True))

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return source.mapInArrow(run, _SCHEMA + (", ids array<int>" if with_ids else ""))
