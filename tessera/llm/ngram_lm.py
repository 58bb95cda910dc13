"""Bigram language model over a whole corpus, kept in sharded Elias-Fano tries.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, then one end token. With c the training counts,
N their sum, V the distinct training tokens and T(v) the distinct successors of v, the model interpolates by absolute
discounting with D = ``discount``:

    P1(w)    = (c(w) + 0.1) / (N + 0.1 (V + 1))
    P(w | v) = max(c(v,w) - D, 0) / c(v) + b(v) P1(w),   b(v) = D T(v) / c(v);   P1(w) where c(v) = 0

A pair seen once keeps a quarter of a count and one seen twice five times as much, so texts that occur again stand out.
Words are known by 63 bits of XXH64, and by 40 bits below their context (chance of a false successor: T(v) / 2**40).

How it scales. One pass turns the texts into chunks of at most ``chunk_tokens`` tokens: distinct words, distinct pairs with
training counts, and for each token the number of its pair. Chunks, not rows, are shuffled: the pairs of a chunk go to
shards by their context, so counts are combined before the shuffle; a chunk sends nothing to shards that it has no pair
for. There are as many shards as hold ``shard_tokens`` tokens each, so a shard's memory does not grow with the corpus. Each
shard merges its slices into a trie in a memory-mapped file, answers all chunks by successor search, and drops it. Contexts
with over a quarter of a shard's tokens are split over all shards by the following word. Of the corpus only those hot
contexts (at most 4 for each shard) and sums reach the driver.

Defined cases: a null text is empty and scores its end token; repeated rows are scored and counted each; a null fold flag
means not in training; with no training token at all every count is 0; an empty table gives an empty result.
"""

from __future__ import annotations


from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, short_batches, written
from .eliasfano import WORD_BITS, Trie, restore

#: These contain a space and so are never words.
END = xxhash.xxh64_intdigest(b" end") >> 1
BEGIN = xxhash.xxh64_intdigest(b" begin") >> 1
_LOW = np.uint64((1 << WORD_BITS) - 1)


#: Taken from the fold of rows whose id is null.
_NO_ID = 8


def squeeze(values: np.ndarray, dtype: str) -> bytes:
    """Compressed byte planes: the high bytes of small numbers take next to nothing."""
    wide = np.ascontiguousarray(values.astype(dtype))
    planes = wide.view(np.uint8).reshape(len(wide), wide.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand(data: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, each text's end token included, and the tokens of each text."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    per_text = np.diff(words.offsets.to_numpy())
    coded = words.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    table = np.fromiter((xxhash.xxh64_intdigest(w) >> 1 for w in names), np.uint64, len(names))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    hashes = table[codes] if len(names) else np.zeros(0, np.uint64)
    real = np.ones(len(codes), bool)
    if "" in names:  # white space at the ends of a text
        real = codes != names.index("")
    owner = np.repeat(np.arange(len(per_text)), per_text)[real]
    counts = np.bincount(owner, minlength=len(per_text)) + 1
    out = np.full(counts.sum(), END, np.uint64)
    ends = np.cumsum(counts) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = hashes[real]
    return out, counts


_CHUNK = {
    "kind": pa.string(), "chunk": pa.int64(), "tokens": pa.int64(), "trained": pa.int64(), "begun": pa.int64(), "vocabulary": pa.binary(),
    "word_counts": pa.binary(), "successors": pa.binary(), "next_words": pa.binary(), "pair_counts": pa.binary(),
    "pairs": pa.binary(), "rows": pa.binary(), "ids": pa.binary(), "folds": pa.binary(), "lengths": pa.binary(),
}
_CHUNK_SCHEMA = ", ".join(f"{k} {'string' if t == pa.string() else 'long' if t == pa.int64() else 'binary'}" for k, t in _CHUNK.items())


def _chunk(number: int, tokens: np.ndarray, before: np.ndarray, train: np.ndarray, rows: list[tuple]) -> list[dict]:
    """Two records: the counts of a chunk, and its tokens as numbers of pairs. rows: (row, id, fold, tokens)."""
    known, word = np.unique(tokens, return_inverse=True)
    odd = np.flatnonzero(before[1:] != tokens[:-1]) + 1  # elsewhere the context is the token before
    odd = np.concatenate([[0], odd])
    vocabulary = np.union1d(known, before[odd])
    word = np.searchsorted(vocabulary, known).astype(np.int32)[word]
    context = np.roll(word, 1)
    context[odd] = np.searchsorted(vocabulary, before[odd])
    pairs, which = np.unique(context.astype(np.int64) << 32 | word, return_inverse=True)
    count = np.bincount(which[train], minlength=len(pairs))
    empty = dict.fromkeys(_CHUNK)
    counts = empty | {
        "kind": "counts", "chunk": number, "tokens": len(tokens), "trained": int(train.sum()), "begun": int((train & (before == BEGIN)).sum()),
        "vocabulary": squeeze(vocabulary, "<u8"),
        "word_counts": squeeze(np.bincount(word[train], minlength=len(vocabulary)), "<u4"),
        "successors": squeeze(np.bincount(pairs >> 32, minlength=len(vocabulary)), "<u4"),
        "next_words": squeeze(pairs & 0xFFFFFFFF, "<u4"), "pair_counts": squeeze(count, "<u4"),
    }
    row, ids, folds, lengths = zip(*rows)
    tokens_out = empty | {
        "kind": "tokens", "chunk": number, "pairs": squeeze(which, "<u4"), "rows": squeeze(np.array(row), "<i8"),
        "ids": squeeze(np.array(ids), "<i8"), "folds": squeeze(np.array(folds), "<i1"), "lengths": squeeze(np.array(lengths), "<i8"),
    }
    return [counts, tokens_out]


def _chunks(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """docs: _id long, _text string, _train boolean (null: neither fold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, row = part << 32, part << 40
        held: list[tuple] = []  # tokens, contexts, row, id, fold
        size = 0

        def emit() -> pa.RecordBatch:
            nonlocal number, held, size
            tokens, before = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            train = np.repeat(np.array([h[4] in (1, 1 - _NO_ID) for h in held]), [len(h[0]) for h in held])
            made = _chunk(number, tokens, before, train, [(h[2], h[3], h[4], len(h[0])) for h in held])
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_pylist(made, pa.schema(list(_CHUNK.items())))

        for batch in batches:
            tokens, counts = _word_hashes(batch.column(1))
            before = np.roll(tokens, 1)
            starts = np.cumsum(counts) - counts
            before[starts] = BEGIN
            ids = batch.column(0).to_pylist()
            folds = [-1 if x is None else int(x) for x in batch.column(2).to_pylist()]
            for i, fold, start, count in zip(ids, folds, starts.tolist(), counts.tolist()):
                at = start
                while at < start + count:
                    stop = min(start + count, at + chunk_tokens - size)
                    held.append((tokens[at:stop], before[at:stop], row, i or 0, fold if i is not None else fold - _NO_ID))
                    size, at = size + stop - at, stop
                    if size >= chunk_tokens:
                        yield emit()
                row += 1
        if held:
            yield emit()

    return docs.mapInArrow(run, _CHUNK_SCHEMA)


def _shards(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shard by range of a 63-bit hash: sorted hashes fall into slices."""
    return ((hashes >> np.uint64(31)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _answers(rows: list[dict], types: dict[str, pa.DataType]) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema(list(types.items())))


# --- words: counts of every word, sent back to the chunks that have it ------------------------------------------------

_WORD = {"shard": pa.int64(), "chunk": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}
_REPLY = {"shard": pa.int64(), "chunk": pa.int64(), "n": pa.int64(), "keys": pa.binary(), "values": pa.binary()}
_REPLY_SCHEMA = "shard long, chunk long, n long, keys binary, values binary"


def _count_words(counts: DataFrame, shards: int, hot_count: float) -> DataFrame:
    """For each chunk and shard the training counts of the chunk's words; as chunk -1 each shard's number of distinct
    training words, and its words that make hot contexts."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, count = expand(r["vocabulary"], "<u8"), expand(r["word_counts"], "<u4")
                edges = np.searchsorted(_shards(keys, shards), np.arange(shards + 1))
                out = [
                    {"shard": s, "chunk": r["chunk"], "keys": squeeze(keys[a:b], "<u8"), "counts": squeeze(count[a:b], "<u4")}
                    for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a
                ]
                yield pa.RecordBatch.from_pylist(out, pa.schema(list(_WORD.items())))

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [expand(r["keys"], "<u8") for r in rows]
        known, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, np.concatenate([expand(r["counts"], "<u4") for r in rows]), len(known)).astype("<i8")
        hot = total >= hot_count
        out = [{"shard": rows[0]["shard"], "chunk": -1, "n": int((total > 0).sum()), "keys": squeeze(known[hot], "<u8"), "values": squeeze(total[hot], "<i8")}]
        at = 0
        for r, k in zip(rows, keys):
            out.append({"shard": r["shard"], "chunk": r["chunk"], "n": 0, "keys": None, "values": squeeze(total[which[at : at + len(k)]], "<i8")})
            at += len(k)
        return _answers(out, _REPLY)

    dealt = counts.select("chunk", "vocabulary", "word_counts").mapInArrow(deal, "shard long, chunk long, keys binary, counts binary")
    return dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(merge, _REPLY_SCHEMA)


# --- pairs: a trie in each shard ---------------------------------------------------------------------------------------

_PAIRS = {"shard": pa.int64(), "chunk": pa.int64(), "contexts": pa.binary(), "successors": pa.binary(), "words": pa.binary(), "counts": pa.binary()}
_FOUND = {"shard": pa.int64(), "chunk": pa.int64(), "codes": pa.binary(), "weights": pa.binary(), "hot_types": pa.binary()}
_FOUND_SCHEMA = "shard long, chunk long, codes binary, weights binary, hot_types binary"


def split_pairs(contexts: np.ndarray, words: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each pair: by context, for hot contexts by the word."""
    at = np.minimum(np.searchsorted(hot, contexts), max(len(hot) - 1, 0))
    is_hot = hot[at] == contexts if len(hot) else np.zeros(len(contexts), bool)
    return np.where(is_hot, _shards(words, shards), _shards(contexts, shards))


def _pack40(words: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray((words & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes())


def _unpack40(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view("<u8").ravel()


def _chunk_pairs(r: dict, hot: np.ndarray, shards: int) -> tuple[np.ndarray, ...]:
    """A chunk's pairs in the order of shards: contexts, words, training counts (if given), shards, and the order itself."""
    vocabulary = expand(r["vocabulary"], "<u8")
    contexts = np.repeat(vocabulary, expand(r["successors"], "<u4"))
    words = vocabulary[expand(r["next_words"], "<u4")]
    shard = split_pairs(contexts, words, hot, shards)
    order = np.lexsort((words & _LOW, contexts, shard))
    count = expand(r["pair_counts"], "<u4")[order] if r.get("pair_counts") else None
    return contexts[order], words[order], count, shard[order], order


def _look_up_pairs(counts: DataFrame, shards: int, hot: np.ndarray, hot_counts: np.ndarray, discount: float) -> DataFrame:
    """For each chunk and shard the quantised probabilities of the chunk's pairs and the back-off weights of their
    contexts; as chunk -1 each shard's distinct successors of the hot contexts."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                contexts, words, count, shard, _ = _chunk_pairs(r, hot, shards)
                edges = np.searchsorted(shard, np.arange(shards + 1))
                out = []
                for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    if b > a:
                        own, n = np.unique(contexts[a:b], return_counts=True)
                        out.append({"shard": s, "chunk": r["chunk"], "contexts": squeeze(own, "<u8"), "successors": squeeze(n, "<u4"), "words": _pack40(words[a:b]), "counts": squeeze(count[a:b], "<u4")})
                yield pa.RecordBatch.from_pylist(out, pa.schema(list(_PAIRS.items())))

    def answer(table: pa.Table) -> pa.Table:
        rows = [
            (r["chunk"], expand(r["contexts"], "<u8"), expand(r["successors"], "<u4").astype(np.int64), _unpack40(r["words"]), expand(r["counts"], "<u4"))
            for r in table.to_pylist()
        ]
        shard = table.column("shard")[0].as_py()
        trie, hot_types = _build([x[1:] for x in rows], hot, hot_counts, discount)
        out = [{"shard": shard, "chunk": -1, "codes": None, "weights": None, "hot_types": squeeze(hot_types, "<i8")}]
        for chunk, contexts, successors, words, _ in rows:
            ranks, there = trie.find(contexts)
            codes = trie.query(ranks, there, successors, words)
            weights = np.where(there, trie.weights[np.where(there, ranks, 0)], 0) if len(trie.weights) else np.zeros(len(ranks))
            out.append({"shard": shard, "chunk": chunk, "codes": squeeze(codes, "<u2"), "weights": squeeze(weights, "<u2"), "hot_types": None})
        return _answers(out, _FOUND)

    names = ("chunk", "vocabulary", "successors", "next_words", "pair_counts")
    dealt = counts.select(*names).mapInArrow(deal, "shard long, chunk long, contexts binary, successors binary, words binary, counts binary")
    return dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(answer, _FOUND_SCHEMA)


def _build(slices: list[tuple], hot: np.ndarray, hot_counts: np.ndarray, discount: float) -> tuple[Trie, np.ndarray]:
    """The trie of a shard's training pairs, and how many distinct successors of each hot context it has.

    The counts of a hot context are spread over shards, so its total is given; its back-off weight is left at 0 here and
    made from the sum over shards.
    """
    contexts = np.concatenate([np.repeat(c, n)[k > 0] for c, n, _, k in slices])
    words = np.concatenate([w[k > 0] for _, _, w, k in slices])
    count = np.concatenate([k[k > 0] for *_, k in slices]).astype(np.int64)
    order = np.lexsort((words, contexts))
    contexts, words, count = contexts[order], words[order], count[order]
    new = np.ones(len(words), bool)
    new[1:] = (contexts[1:] != contexts[:-1]) | (words[1:] != words[:-1])
    starts = np.flatnonzero(new)
    count = np.add.reduceat(count, starts) if len(starts) else count
    contexts, words = contexts[new], words[new]
    own, first, types = np.unique(contexts, return_index=True, return_counts=True)
    total = np.add.reduceat(count, first) if len(first) else count
    hot_types = np.zeros(len(hot), np.int64)
    weights = discount * types / total if len(own) else np.zeros(0)
    if len(hot) and len(own):
        at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
        here = hot[at] == own
        hot_types[at[here]] = types[here]
        total = np.where(here, hot_counts[at], total)
        weights = np.where(here, 0.0, weights)
    return Trie(own, types, words, (count - discount) / np.repeat(total, types), weights), hot_types


# --- scores -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Totals:
    """What of the model is small: sums, and the hot contexts (at most 4 x shards) with counts and successor types."""

    tokens: int
    types: int
    hot: np.ndarray
    hot_counts: np.ndarray
    hot_types: np.ndarray
    discount: float

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.1) / (self.tokens + 0.1 * (self.types + 1))


_SCORE = {"row": pa.int64(), "doc_id": pa.int64(), "fold": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
_SCORE_SCHEMA = "row long, doc_id long, fold long, n_tokens long, n_known long, base_score double, score double"


def _score_chunk(counts: dict, tokens: dict, words: list[dict], found: list[dict], totals: Totals, shards: int) -> pa.Table:
    vocabulary = expand(counts["vocabulary"], "<u8")
    known = np.concatenate([expand(r["values"], "<i8") for r in sorted(words, key=lambda r: r["shard"])])
    unigram = totals.unigram(known)
    contexts, following, _, shard, order = _chunk_pairs(counts, totals.hot, shards)
    replies = sorted(found, key=lambda r: r["shard"])
    ratio = restore(np.concatenate([expand(r["codes"], "<u2") for r in replies]))
    firsts = np.ones(len(contexts), bool)  # replies give one weight for each run of a context within a shard
    firsts[1:] = (contexts[1:] != contexts[:-1]) | (shard[1:] != shard[:-1])
    codes = np.concatenate([expand(r["weights"], "<u2") for r in replies])
    weight = np.where(codes > 0, restore(codes), 1.0)[np.cumsum(firsts) - 1]
    if len(totals.hot):
        at = np.minimum(np.searchsorted(totals.hot, contexts), len(totals.hot) - 1)
        here = totals.hot[at] == contexts
        weight[here] = (totals.discount * totals.hot_types / totals.hot_counts)[at[here]]
    place = np.searchsorted(vocabulary, following)
    log = np.empty(len(contexts))
    log[order] = np.log10(ratio + weight * unigram[place])
    word_of = np.empty(len(contexts), np.int64)
    word_of[order] = place
    pairs = expand(tokens["pairs"], "<u4")
    lengths = expand(tokens["lengths"], "<i8")
    starts = np.cumsum(lengths) - lengths
    word = word_of[pairs]
    sums = [np.add.reduceat(x, starts) for x in ((known[word] > 0).astype(np.int64), np.log10(unigram)[word], log[pairs])]
    columns = [expand(tokens["rows"], "<i8"), expand(tokens["ids"], "<i8"), expand(tokens["folds"], "<i1"), lengths, *sums]
    return pa.table([pa.array(c, t) for c, t in zip(columns, _SCORE.values())], names=list(_SCORE))


def score(docs: DataFrame, train: Column, text_col: str = "text", id_col: str = "doc_id", chunk_tokens: int = 3 << 19, shard_tokens: int = 1 << 21, discount: float = 0.75) -> DataFrame:
    """Scores every row of docs with the model of the rows where ``train`` holds.

    Returns doc_id, train (as given), n_tokens, n_known, train_tokens, base_score (the unigram's log10 probability) and
    score (the bigram model's).
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"), train.alias("_train"))
    chunks = written(_chunks(rows, chunk_tokens), "kind")
    counts, tokens = (chunks.where(F.col("kind") == k) for k in ("counts", "tokens"))
    sums = counts.agg(F.sum("trained").alias("n"), F.sum("begun").alias("begun"), F.sum("tokens").alias("tokens")).first()
    n, begun = sums["n"] or 0, sums["begun"] or 0
    shards = max(partitions(spark), -(-(sums["tokens"] or 0) // shard_tokens))
    hot_count = max(1000.0, n / (4 * shards))

    words = written(_count_words(counts, shards, hot_count))
    heads = words.where("chunk = -1").select("n", "keys", "values").collect()  # one row for each shard
    found = {int(k): int(v) for r in heads for k, v in zip(expand(r["keys"], "<u8"), expand(r["values"], "<i8")) if k != END}
    if begun >= hot_count:
        found[BEGIN] = begun
    hot = np.array(sorted(found), np.uint64)
    hot_counts = np.array([found[int(k)] for k in hot], np.int64)

    pairs = written(_look_up_pairs(counts, shards, hot, hot_counts, discount))
    types = [expand(r["hot_types"], "<i8") for r in pairs.where("chunk = -1").select("hot_types").collect()]
    totals = Totals(n, sum(r["n"] for r in heads), hot, hot_counts, np.sum(types, axis=0) if types else np.zeros(len(hot), np.int64), discount)

    nothing = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    count_names = ("vocabulary", "successors", "next_words")
    token_names = ("pairs", "rows", "ids", "folds", "lengths")
    parts = [
        counts.select("chunk", F.lit(-1).cast("long").alias("shard"), F.lit("c").alias("kind"), *count_names, *nothing(*token_names, "values", "codes", "weights")),
        tokens.select("chunk", F.lit(-1).cast("long").alias("shard"), F.lit("t").alias("kind"), *nothing(*count_names), *token_names, *nothing("values", "codes", "weights")),
        words.where("chunk >= 0").select("chunk", "shard", F.lit("w").alias("kind"), *nothing(*count_names, *token_names), "values", *nothing("codes", "weights")),
        pairs.where("chunk >= 0").select("chunk", "shard", F.lit("p").alias("kind"), *nothing(*count_names, *token_names, "values"), "codes", "weights"),
    ]

    def finish(table: pa.Table) -> pa.Table:
        by: dict[str, list[dict]] = {"c": [], "t": [], "w": [], "p": []}
        for r in table.to_pylist():
            by[r["kind"]].append(r)
        return _score_chunk(by["c"][0], by["t"][0], by["w"], by["p"], totals, shards)

    together = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    chunks_here = max(partitions(spark), (sums["tokens"] or 0) // chunk_tokens)
    scored = together.repartition(chunks_here, "chunk").groupBy("chunk").applyInArrow(finish, _SCORE_SCHEMA)
    summed = scored.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("fold").alias("fold"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    )  # a long text may lie in several chunks
    return summed.select(
        F.when(F.col("fold") >= -1, F.col("doc_id")).alias("doc_id"),
        F.when(F.col("fold").isin(0, 1, -_NO_ID, 1 - _NO_ID), F.col("fold").isin(1, 1 - _NO_ID)).alias("train"),
        "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
    )
