"""Importance resampling of documents towards a target distribution of hashed n-grams.

The features of a text are all runs of one word and of two words in a row; each falls into a bucket by its CRC-32. The
log ratio of a bucket's smoothed share in the target to that in the corpus is the bucket's gain. A document's weight is
the mean gain of its features, and Gumbel noise from a hash of its key makes the highest scores a sample without
replacement.

Texts are read in batches. A batch's texts are joined with a sentinel between them, all bytes that are in no word become
spaces, one split finds the words of all, and word positions searched in the texts' offsets tell which pairs of words cross a
border; those count nowhere. Bucket counts are summed within a task before they are passed on.

Counts cover all rows. Null and wordless texts have no features and weight 0; repeated rows are documents of their own.
The driver gets two numbers a bucket and broadcasts one, so their size is bounded by ``buckets``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut
from tidemark.llm.tables import expanded, slices

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 7, 20, 25
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SENTINEL = b"\x00"
BATCH_BYTES, MEMO = 4_000_000, 300_000
LONGEST = 64
"""Words of up to so many bytes have tables by which the hash of a pair follows from the hashes of its words."""
FINE = 8
"""Bits of a score below those by which scores are first counted."""


def _crc_table() -> np.ndarray:
    """CRC-32 of a byte, reflected, for each byte."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


def _shift_tables() -> np.ndarray:
    """[n, place, byte]: what a byte at a place of a CRC becomes after n zero bytes; a CRC is the sum of its four bytes' values."""
    byte = _crc_table()
    tables = [np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])]
    for _ in range(LONGEST):
        tables.append(byte[tables[-1] & 0xFF] ^ (tables[-1] >> 8))
    return np.stack(tables)


class _Words(dict):
    """word -> its CRC-32 and, above 32 bits, its length, or LONGEST + 1 for longer ones; emptied when it has ``MEMO`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = zlib.crc32(word) | min(len(word), LONGEST + 1) << 32
        return found


class Hasher:
    """Buckets of the features of batches of texts."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.words = buckets, _Words()
        self.byte, self.shift = _crc_table(), _shift_tables().ravel()
        self.letter = np.zeros(256, bool)
        self.letter[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True
        self.spaces = bytes(c if own else 32 for c, own in enumerate(self.letter))

    def _pairs(self, first: np.ndarray, second: np.ndarray, size: np.ndarray, data: bytes, starts: np.ndarray) -> np.ndarray:
        """CRC-32 of the first word, a space and the second word, from the CRC-32 of both; ``starts`` are those of the second."""
        spaced = ~first
        spaced = ~(self.byte[(spaced ^ np.uint32(32)) & 0xFF] ^ (spaced >> 8))
        size = size.astype(np.int64)
        table = np.minimum(size, LONGEST) << 10
        out = second.copy()
        for place in range(4):
            out ^= self.shift[table + (place << 8) + ((spaced >> np.uint32(8 * place)) & 0xFF)]
        for i in np.flatnonzero(size > LONGEST):
            out[i] = zlib.crc32(WORD.match(data, int(starts[i]))[0], int(spaced[i]))
        return out

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bucket and the text's place of each feature of the texts, and the number of words of each text."""
        parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        data = SENTINEL.join(parts)
        offsets = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
        found = np.fromiter(map(self.words.__getitem__, data.translate(self.spaces).split()), np.uint64)
        inside = self.letter[np.frombuffer(data, np.uint8)]
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])) if len(inside) else np.zeros(0, np.int64)
        text = np.searchsorted(offsets, starts, "right") - 1
        crc, size = (found & np.uint64(0xFFFFFFFF)).astype(np.uint32), found >> np.uint64(32)
        whole = np.flatnonzero(text[1:] == text[:-1])  # the first words of pairs that cross no border
        pieces = [crc]
        for part in np.array_split(whole, len(whole) // 65536 + 1):  # few shift tables at a time
            pieces.append(self._pairs(crc[part], crc[part + 1], size[part + 1], data, starts[part + 1]))
        bucket = np.concatenate(pieces) % np.uint32(self.buckets)
        return bucket.astype(np.int64), np.concatenate([text, text[whole]]), np.bincount(text, minlength=len(texts))


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, 0, BATCH_BYTES):
                total += np.bincount(hasher.features(part.column(0).to_pylist())[0], minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full])], ["bucket", "n"])

    return docs.select(F.col(text)).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket in thousandths, rounded down; one is added to each count of both sides."""
    counts = []
    for table in (corpus, target):
        counts.append(np.zeros(buckets, np.int64))
        for row in bucket_counts(table, text, buckets).collect():  # at most one row a bucket
            counts[-1][row["bucket"]] = row["n"]
    (s, t), (all_s, all_t) = counts, (float(c.sum() + buckets) for c in counts)
    return np.array([math.floor(1000 * math.log(((b + 1.0) * all_s) / ((a + 1.0) * all_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_features, weight) of every row; the weight is the mean gain of its features, rounded down, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(len(gain))
        for batch in batches:
            for part in slices(batch, 1, BATCH_BYTES):
                bucket, place, n_words = hasher.features(part.column(1).to_pylist())
                n = np.bincount(place, minlength=part.num_rows)
                total = np.bincount(place, gain[bucket], part.num_rows).astype(np.int64)  # exact up to 2**53
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))], ["key", "n_words", "n_features", "weight"]
                )

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return found.mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long").withColumnRenamed("key", key)


def ranked(scored: DataFrame, drawn: int, key: str) -> DataFrame:
    """Adds ``rank`` to rows (key, n_features, weight, score): 1, 2, 3... by falling score and then key, null beyond ``drawn``.

    Rows alike in all are counted before the shuffle and expanded at the end. Scores are whole numbers of a range that
    double logarithms bound, so the number of rows above each is a small table, summed in two steps.
    """
    columns = [key, "n_features", "weight", "score"]
    counted = cut(scored.groupBy(*columns).agg(F.count("*").alias("__n")))
    level = F.shiftright("score", FINE).alias("__level")
    by_score = counted.groupBy(level, "score").agg(F.sum("__n").alias("__total"))
    up = Window.orderBy(F.desc("__level")).rowsBetween(Window.unboundedPreceding, -1)
    levels = by_score.groupBy("__level").agg(F.sum("__total").alias("__sum")).select("__level", F.coalesce(F.sum("__sum").over(up), F.lit(0)).alias("__over"))
    inside = Window.partitionBy("__level").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    above = by_score.withColumn("__in", F.coalesce(F.sum("__total").over(inside), F.lit(0))).join(F.broadcast(levels), "__level")
    above = above.select("score", (F.col("__over") + F.col("__in")).alias("__above")).where(F.col("__above") < drawn)
    order = Window.partitionBy("score").orderBy(F.col(key).asc_nulls_first(), "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("__before", F.coalesce(F.sum("__n").over(order), F.lit(0))).join(F.broadcast(above), "score", "left")
    first = F.col("__above") + F.col("__before") + 1
    rows = expanded(placed.select(*columns, "__n", first.alias("__first")), "__n", "__place")
    rank = F.col("__first") + F.col("__place")
    return rows.select(*columns, F.when(rank <= drawn, rank).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row of ``docs``, all long but the key.

    Drawn are, of the N rows with ``least_words`` words or more, the floor(percent * N / 100) highest scores, ties to the
    smaller key; the rank of all others is null. A null key draws its noise as an empty one and comes before other keys.
    An empty target has no features, its shares are the smoothing's. Texts are read whole; other columns are not carried.
    """
    weights = weigh(docs, gains(docs, target, text, buckets), text, key)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut(weights.withColumn("score", F.col("weight") + noise))
    drawn = percent * scored.where(F.col("n_words") >= least_words).count() // 100
    rest = scored.where(F.col("n_words") < least_words).select(key, "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked(scored.where(F.col("n_words") >= least_words), drawn, key).unionByName(rest)
