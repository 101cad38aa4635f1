"""Cross-entropy difference of two n-gram models, for choosing documents like a target.

Words (lower-cased in A-Z, cut at ASCII white space) are counted as unigrams and bigrams, once over the target
documents and once over all. Every distinct word and bigram has its own count, under a key of 63 bits and one that tells
words from bigrams: among n of them n^2 / 2^64 pairs are expected to share one (0.05 among a thousand million). Nothing is
capped; the tables grow with the corpus.
Both models share vocabulary, order and smoothing: a pair's probability is its relative frequency after its first word, smoothed
with the unigram probability of its second word by a prior of `PRIOR` occurrences. A word's count has one added, over a
vocabulary of all distinct words of the corpus.

A token's loss is its negative log probability in nats; the score of a document is its mean loss under the target less
that under the background, so lower is closer to the target. A document is scored without the counts that it added to
a model itself, else those in the target would come out too close to it.

Documents are dealt into blocks of `BLOCK_BYTES` of text where they are read, and written once as one compressed row for
each block; labels meet only ids. A block sends its n-grams by ranges of their keys: a row holds the sorted keys of one range, packed by their
differences, and their counts. A common n-gram so has as many entries as there are blocks and not as documents. The number of ranges
grows with that of blocks, so that a range holds about `RANGE_BLOCKS` times what a block does; on very large tables a row holds fewer n-grams,
and one at the least. Sums go back to the blocks in the order of their keys, without these, and each block is scored with the
counts of its own n-grams. How often a word comes before another is its count less how often it ends a document. The driver
sees the number of blocks and five totals.

Defined cases: a null, empty or blank text has no tokens and a null score; without target documents the target model is
uniform; null or repeated labels: a document is a target if any label says so; repeated rows count and are scored each
(without one copy of its counts); extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgrid.session import stage

PRIOR = 20.0
MEMO_WORDS = 400_000
BATCH_BYTES = 2_000_000  # of text tokenised together
BLOCK_BYTES = 8_000_000  # of text that asks for counts together
ROW_BYTES = 64  # that a document adds beside its text, so that blocks of empty texts end too
RANGE_BLOCKS = 2  # as many blocks' n-grams, about, are summed together


class Cells(dict):
    """Word -> its key of 64 bits; a bounded memo for each task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        cell = xxhash.xxh64_intdigest(word, 3) - (1 << 63)
        if len(word) <= 64:
            self[word] = cell
        return cell


def tokens(cells: Cells, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the words and of those before them of the tokens of all texts, and the number of tokens of each. A text's
    first token comes after a start mark."""
    words, sizes = [], []
    for text in texts:
        own = text.encode("utf-8", "replace").lower().split() if text else []
        words += own
        sizes.append(len(own))
    sizes = np.array(sizes, np.int64)
    word = np.fromiter(map(cells.__getitem__, words), np.int64, len(words))
    return word, previous(word, sizes), sizes


def previous(word: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The key before each token; texts start after key 0."""
    before = np.empty_like(word)
    before[1:] = word[:-1]
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    before[starts] = 0
    return before


def pairs(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    mixed = before.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.int64).view(np.uint64)
    return ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def ngram_keys(x: np.ndarray, kind: int) -> np.ndarray:
    """Keys of words (kind 0) or pairs (kind 1) as they are counted: 63 bits and the kind."""
    return (x.view(np.uint64) & ~np.uint64(1)) | np.uint64(kind)


def batched(sizes: list[int | None]) -> Iterator[slice]:
    """Slices of the texts with these sizes that are tokenised together."""
    at = 0
    while at < len(sizes):
        end, held = at, 0
        while end < len(sizes) and (end == at or held < BATCH_BYTES):
            held += sizes[end] or 0
            end += 1
        yield slice(at, end)
        at = end


def read_block(block: pa.RecordBatch | pa.Table, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the words, and of those before them, of all tokens of a block, the number of tokens of each text, and which
    texts (those at `places`) are in the target."""
    texts = pa.ipc.open_stream(block.column("texts")[0].as_buffer()).read_all().column(0)
    cells, parts = Cells(), []
    for part in batched(pc.binary_length(texts).to_pylist()):
        parts.append(tokens(cells, texts[part].to_pylist()))
    word, before, sizes = (np.concatenate(x) for x in zip(*parts))
    chosen = np.zeros(len(sizes), bool)
    chosen[places] = True
    return word, before, sizes, chosen


def distinct(word: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys of the n-grams of a block, and at which of them each token's word and then each token's pair is."""
    both = np.concatenate([ngram_keys(word, 0), ngram_keys(pairs(before, word), 1)])
    return np.unique(both, return_inverse=True)


def pack_keys(keys: np.ndarray) -> tuple[int, bytes]:
    """Bytes of a difference, and the differences of sorted keys in as few bytes each as the largest needs."""
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[0] = 0
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return width, np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_keys(first: int, width: int, data: bytes) -> np.ndarray:
    packed = np.frombuffer(data, np.uint8).reshape(-1, width)
    steps = np.zeros((len(packed), 8), np.uint8)
    steps[:, :width] = packed
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64) + np.uint64(first)


def pack_counts(counts: np.ndarray) -> bytes:
    """Four counts of each key (4 x keys)."""
    return pa.compress(np.ascontiguousarray(counts, "<i8").tobytes(), codec="zstd", asbytes=True)


def unpack_counts(n: int, data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 32 * n, codec="zstd", asbytes=True), "<i8").reshape(4, n)


def block_counts(word: np.ndarray, before: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, and for each its occurrences in the target and in all documents and, for words, how many of each end with it."""
    keys, index = distinct(word, before)
    n, inside = len(keys), np.repeat(chosen, sizes)
    last = (np.cumsum(sizes) - 1)[sizes > 0]
    ends, wanted = index[: len(word)][last], inside[last]
    both = np.concatenate([inside, inside])
    return keys, np.stack([np.bincount(x, minlength=n) for x in (index[both], index, ends[wanted], ends)])


def count_ngrams(blocks: DataFrame, targets: DataFrame, bits: int) -> DataFrame:
    """range, block, n, and first, width, keys and counts as packed above: the n-grams of each block by the first `bits` of their keys."""
    names = ["range", "block", "n", "first", "width", "keys", "counts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(block: pa.Table, places: pa.Table) -> pa.Table:
        keys, counts = block_counts(*read_block(block, places.column("place").to_numpy()))
        ranges = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        starts = np.flatnonzero(np.diff(ranges, prepend=-1))
        number = block.column("block")[0].as_py()
        rows = []
        for a, z in zip(starts, [*starts[1:], len(keys)]):
            rows.append((int(ranges[a]), number, int(z - a), int(keys[a].view(np.int64)), *pack_keys(keys[a:z]), pack_counts(counts[:, a:z])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], names=names)

    return blocks.groupBy("block").cogroup(targets.groupBy("block")).applyInArrow(run, "range long, block long, n long, first long, width int, keys binary, counts binary")


def sum_range(rows: pa.Table) -> pa.Table:
    """The rows of a range with their counts summed over all blocks; and, on the first, the range's totals."""
    n, first, width, keys, counts = (rows.column(c).to_pylist() for c in ("n", "first", "width", "keys", "counts"))
    every = np.concatenate([unpack_keys(f % (1 << 64), w, k) for f, w, k in zip(first, width, keys)])
    one, index = np.unique(every, return_inverse=True)
    own = np.concatenate([unpack_counts(m, c) for m, c in zip(n, counts)], axis=1)
    sums = np.stack([np.bincount(index, x, len(one)).astype(np.int64) for x in own])
    ends = np.cumsum(n)
    words = one % np.uint64(2) == 0
    totals = [*sums[:, words].sum(axis=1).tolist(), int(words.sum())]
    back = [pack_counts(sums[:, index[e - m : e]]) for e, m in zip(ends, n)]
    return pa.table([rows.column("block"), rows.column("range"), rows.column("n"), pa.array(back, pa.binary()), pa.array([totals, *[None] * (len(n) - 1)], pa.list_(pa.int64()))],
                    names=["block", "range", "n", "counts", "totals"])


def fit(blocks: DataFrame, targets: DataFrame) -> tuple[DataFrame, tuple[int, ...]]:
    """block, range, n, counts: corpus counts of the n-grams of each block in the order of their keys; and the number of
    tokens in the target and in all documents, of documents with tokens in the target and in all, and of words in the vocabulary."""
    bits = max(0, (blocks.select("block").count() // RANGE_BLOCKS - 1).bit_length())
    sums = count_ngrams(blocks, targets, bits).groupBy("range").applyInArrow(sum_range, "block long, range long, n long, counts binary, totals array<long>")
    sums = stage(sums, "ngrams")
    totals = sums.where("totals is not null").agg(*(F.sum(F.col("totals")[i]) for i in range(5))).first()
    return sums.select("block", "range", "n", "counts"), tuple(x or 0 for x in totals)


def own_counts(document: np.ndarray, x: np.ndarray, cells: int) -> np.ndarray:
    """How often the document of each token has the token's n-gram, given as a number below `cells`."""
    _, index, count = np.unique(document * cells + x, return_inverse=True, return_counts=True)
    return count[index].astype(np.float64)


def losses(counts: list[np.ndarray], own: list[np.ndarray], total: int, vocabulary: int) -> np.ndarray:
    """Loss of each token from the counts of its word, the word before, its pair, without the `own` ones (and all own tokens)."""
    word, before, pair = (c - o for c, o in zip(counts, own))
    single = (word + 1.0) / (total - own[3] + vocabulary)
    return -np.log((pair + PRIOR * single) / (before + PRIOR))


def score_block(word: np.ndarray, before: np.ndarray, sizes: np.ndarray, chosen: np.ndarray, sums: np.ndarray, totals: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Mean losses under the target and the background of each document of a block. `sums`: the four corpus counts of each of its sorted n-grams."""
    keys, index = distinct(word, before)
    one, pair = index[: len(word)], index[len(word) :]
    start = before == 0
    at = np.searchsorted(keys, ngram_keys(before, 0))
    at[start] = 0
    document = np.repeat(np.arange(len(sizes)), sizes)
    _, place = np.unique(before, return_inverse=True)
    own = [own_counts(document, x, len(keys)) for x in (one, place, pair)] + [sizes[document].astype(np.float64)]
    many = np.maximum(sizes, 1)
    means = []
    for i, taken in enumerate(([o * chosen[document] for o in own], own)):
        precedes = np.where(start, totals[2 + i], sums[i][at] - sums[2 + i][at])
        counts = [x.astype(np.float64) for x in (sums[i][one], precedes, sums[i][pair])]
        means.append(np.bincount(document, losses(counts, taken, totals[i], totals[4]), len(sizes)) / many)
    return means[0], means[1]


def score(blocks: DataFrame, targets: DataFrame, sums: DataFrame, totals: tuple[int, ...]) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of the documents of all blocks."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    known = sums.withColumn("place", F.lit(None).cast("long")).unionByName(targets.selectExpr("block", "-1L as range", "0L as n", "cast(null as binary) as counts", "place"))

    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        places = known.column("place").drop_null().to_numpy()
        word, before, sizes, chosen = read_block(block, places)
        rows = known.filter(pc.greater_equal(known.column("range"), 0)).sort_by("range")
        parts = [unpack_counts(n, c) for n, c in zip(rows.column("n").to_pylist(), rows.column("counts").to_pylist())]
        found = np.concatenate([np.zeros((4, 0), np.int64), *parts], axis=1)
        target, background = score_block(word, before, sizes, chosen, found, totals) if len(word) else np.zeros((2, len(sizes)))
        columns = [pa.array(x, mask=sizes == 0) for x in (target, background, target - background)]
        ids = pc.list_flatten(block.column("ids")).combine_chunks()
        return pa.table([ids, pa.array(sizes), *columns], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")


def blocked(docs: DataFrame) -> DataFrame:
    """block, ids and texts (compressed), one row for each block of documents, written where they are read."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, parts = TaskContext.get().partitionId() << 32, 0, []

        def full() -> pa.RecordBatch:
            held = pa.Table.from_batches(parts)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("text", pa.large_string())]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.table([held.column(1).cast(pa.large_string()).combine_chunks()], names=["text"]))
            ids = held.column(0).to_pylist()
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([ids], pa.list_(held.schema.field(0).type)), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "ids", "texts"])

        for batch in batches:
            at = 0
            for place, size in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
                size = (size or 0) + ROW_BYTES
                if held and held + size > BLOCK_BYTES:
                    parts.append(batch.slice(at, place - at))
                    yield full()
                    block, held, parts, at = block + 1, 0, [], place
                held += size
            parts.append(batch.slice(at))
        if any(len(p) for p in parts):
            yield full()

    return stage(docs.select("doc_id", "text").mapInArrow(run, f"block long, ids array<{kind}>, texts binary"), "blocks")


def target_places(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """block and place of the documents whose id is in `targets` (doc_id). Targets grow with the corpus, so they are never
    broadcast; ids meet them without texts."""
    ids = targets.where("doc_id is not null").select("doc_id").distinct()
    rows = blocks.select("block", F.posexplode("ids").alias("place", "doc_id"))
    return stage(rows.join(ids.hint("merge"), "doc_id").select("block", F.col("place").cast("long").alias("place")), "targets")


def score_corpus(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents table; the target is the documents labelled good and not toxic."""
    blocks = blocked(docs)
    targets = target_places(blocks, labels.where("quality = 1 and toxic = 0"))
    return score(blocks, targets, *fit(blocks, targets))
