"""Language-model scores of documents: stupid backoff over n-grams, computed relationally.

Each document is scored by the counts of all others: c is the count over all documents less the document's own. With the
longest n-gram that ends at a word and has c > 0, S is c(n-gram) / c(its first words), times ``ALPHA`` for each word that
the n-gram is shorter than ``ORDER`` or than the text so far. A word that no other document has counts as one with another
``ALPHA``. A document's score is the sum of log S over its words. All n-grams of all documents count; a single word is
1-gram of the empty 0-gram, whose count is that of all words.

Documents are dealt into blocks by a hash. Each block explodes its n-grams of all orders, counts them, and sends every one
once, packed by hash bucket; no word is so common that it weighs more than once a block. Each bucket holds a part of the
count tables: it sums the counts of the blocks and tells each what the others have, so that its documents can be scored. Blocks and buckets
have a bounded size, and their numbers grow with the input. N-grams are known by 64-bit hashes. Texts, hashes and counts are moved compressed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import WordHashes, mixed

ALPHA, ORDER = 0.4, 3
BLOCK_BYTES, BUCKET_BYTES = 5_000_000, 4_000_000
"""UTF-8 bytes of text of which a block or a bucket has the n-grams."""
HASH_BITS = 64
"""Bits of an n-gram's hash, at every size."""
STEP = np.uint64(0x9E3779B97F4A7C15)


def _zipped(data: bytes) -> bytes:
    """The length in eight bytes, then the data as Zstandard: the shuffle's own codec codes no bytes in fewer than eight bits."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unzipped(data: bytes) -> bytes:
    return pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _packed(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on: alike bytes lie together and compress."""
    return _zipped(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_unzipped(data), np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _texts_zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text, block) with their texts as ``_zipped`` UTF-8, as they are moved."""
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        # One text at a time, so that a batch is never held as Python objects.
        small = pa.array((None if t is None else _zipped(t) for t in (x.as_py() for x in texts)), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), small, batch.column(2)], names=batch.schema.names)


def _texts(column: pa.ChunkedArray) -> list[str | None]:
    return [None if t is None else _unzipped(t).decode() for t in column.to_pylist()]


class _Block:
    """The n-grams of some texts: for each order and word the hash of the n-gram that ends there."""

    def __init__(self, texts: list[str | None], order: int, bits: int) -> None:
        hashes = WordHashes()
        parts = [hashes.of(t) for t in texts]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.text = np.repeat(np.arange(len(parts)), self.sizes)
        starts = np.cumsum(self.sizes) - self.sizes
        self.depth = np.arange(len(self.words)) - starts[self.text] + 1
        """How many words of its text end at each word."""
        self.order = order
        grams = [self.words]
        with np.errstate(over="ignore"):
            for _ in range(order - 1):
                before = np.concatenate([grams[-1][:1], grams[-1][:-1]])
                grams.append(mixed(before * STEP + self.words))
        self.grams = np.concatenate([g[self.depth >= n] for n, g in enumerate(grams, 1)]) >> np.uint64(64 - bits)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams in order of their hashes, and their counts; first the empty one."""
        found, counts = np.unique(self.grams, return_counts=True)
        return np.concatenate([np.zeros(1, np.uint64), found]), np.concatenate([[len(self.words)], counts])

    def scores(self, beyond: np.ndarray) -> np.ndarray:
        """Sum of log S of each text; ``beyond`` has the counts in other blocks of what ``counted`` has."""
        _, gram, counts = np.unique(self.grams, return_inverse=True, return_counts=True)
        totals = beyond + np.concatenate([[len(self.words)], counts])
        text = np.concatenate([self.text[self.depth >= n] for n in range(1, self.order + 1)])
        _, own, repeats = np.unique(gram * len(self.sizes) + text, return_inverse=True, return_counts=True)
        others = totals[1:][gram] - repeats[own]
        rest = (totals[0] - self.sizes)[self.text]
        most = np.minimum(self.depth, self.order)
        out = math.log(ALPHA) * most - np.log(np.maximum(rest, 1))
        low, at = rest, 0
        for n in range(1, self.order + 1):  # longer n-grams overwrite what shorter ones give
            here = np.flatnonzero(self.depth >= n)
            count = np.zeros(len(self.words), np.int64)
            count[here] = others[at : at + len(here)]
            at += len(here)
            # A count without one of its context would be that of another n-gram with the same hash.
            context = low if n == 1 else np.concatenate([low[:1], low[:-1]])
            count = np.where(context > 0, count, 0)
            seen = np.flatnonzero(count)
            out[seen] = np.log(count[seen]) - np.log(context[seen]) + math.log(ALPHA) * (most[seen] - n)
            low = count
        return np.bincount(self.text, out, len(self.sizes)).astype(float)  # of no words, whole numbers


def _asks(buckets: int, order: int, bits: int, text: str):
    """(bucket, block, grams, counts): the counted n-grams of a block, by bucket of their hashes."""
    edges = np.arange(buckets, dtype=np.uint64) * np.uint64(min(-(-(1 << bits) // buckets), (1 << 64) - 1))

    def run(block: pa.Table) -> pa.Table:
        grams, counts = _Block(_texts(block.column(text)), order, bits).counted()
        cuts = [*np.searchsorted(grams, edges).tolist(), len(grams)]
        full = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
        return pa.table({
            "bucket": pa.array([k for k, _, _ in full], pa.int32()),
            "block": pa.array([block.column("__block")[0].as_py()] * len(full), pa.int64()),
            "grams": pa.array([_packed(np.diff(grams[a:b], prepend=np.uint64(0))) for _, a, b in full], pa.binary()),
            "counts": pa.array([_packed(counts[a:b].astype(np.int32)) for _, a, b in full], pa.binary()),
        })

    return run


def _answers(bucket: pa.Table) -> pa.Table:
    """(block, bucket, beyond): the counts in other blocks of what each block asked of the bucket, in the order of the asking."""
    grams = [np.cumsum(_unpacked(x, np.uint64)) for x in bucket.column("grams").to_pylist()]
    counts = np.concatenate([_unpacked(x, np.int32) for x in bucket.column("counts").to_pylist()])
    _, gram = np.unique(np.concatenate(grams), return_inverse=True)
    beyond = np.bincount(gram, counts).astype(np.int64)[gram] - counts  # exact up to 2**53
    parts = np.split(beyond, np.cumsum([len(g) for g in grams])[:-1])
    return pa.table({"block": bucket.column("block"), "bucket": bucket.column("bucket"), "beyond": pa.array([_packed(p) for p in parts], pa.binary())})


def _scored(order: int, bits: int, key: str, text: str):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Block(_texts(block.column(text)), order, bits)
        beyond = [_unpacked(x, np.int64) for x in answers.sort_by("bucket").column("beyond").to_pylist()]
        score = np.round(own.scores(np.concatenate(beyond)), 6)
        mean = np.round(score / np.maximum(own.sizes, 1), 6)
        return pa.table({
            key: block.column(key), "n_words": pa.array(own.sizes), "score": pa.array(score),
            "mean_score": pa.array(mean, mask=own.sizes == 0),
        })

    return run


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", order: int = ORDER) -> DataFrame:
    """(key, n_words, score, mean_score) of every row of ``docs``: the sum of log S over its words and their mean.

    Null, empty and wordless texts have score 0 and a null mean. Repeated rows are documents of their own, each scored by
    all others. Texts are read whole; one in a script without spaces is few long words. Other columns are not carried.
    Scores are rounded to six digits. Rows equal in key and text share a block.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks, buckets, bits = size // BLOCK_BYTES + 1, size // BUCKET_BYTES + 1, HASH_BITS
    dealt = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.pmod(F.xxhash64(key, text), F.lit(blocks)).alias("__block"))
    kind = docs.schema[key].dataType.simpleString()
    dealt = dealt.mapInArrow(_texts_zipped, f"__key {kind}, __text binary, __block long")
    asks = dealt.groupBy("__block").applyInArrow(_asks(buckets, order, bits, "__text"), "bucket int, block long, grams binary, counts binary")
    answers = asks.groupBy("bucket").applyInArrow(_answers, "block long, bucket int, beyond binary")
    found = dealt.groupBy("__block").cogroup(answers.groupBy("block")).applyInArrow(
        _scored(order, bits, "__key", "__text"), f"__key {kind}, n_words long, score double, mean_score double"
    )
    return found.withColumnRenamed("__key", key)
