"""Benchmark decontamination by spaced seeds, joined on Spark.

A seed is a mask over a window of words whose open positions are hashed and whose closed ones are ignored, so a
substituted word at a closed position does not hide the match. The masks together hit every stretch of at least
``LEAST_WORDS`` words in which ``LEAST_SHARE`` of the words agree; shorter items are cut into pieces of which one must agree.

The seeds of all items and of all documents are joined on their hash. Around each hit the two texts are laid side by side to
find the longest stretch with that share. A bitmap of the items' seeds, of at most ``2**MOST_BITS`` bits, goes to the
tasks first, so that only documents with a possible hit take part in the join; a larger benchmark fills the bitmap and makes it
pass more, with the same result. Work is done once for each distinct text, whatever its number of copies.

Words are runs of letters, digits and underscores in lower case; a text in a script without spaces is few long words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut
from tidemark.llm.tables import free_name, slices
from tidemark.llm.tokens import TEXT_AT_ONCE, WordHashes

MASKS = ((0, 3, 4, 6, 7), (0, 3, 5, 6, 7), (0, 4, 5, 6, 7), (0, 1, 2, 3, 4))
"""Open positions of each mask."""
LEAST_WORDS, LEAST_SHARE = 13, 0.8
LEAST_BITS, MOST_BITS = 16, 27
SPARSE = 512
"""Bits of the bitmap for each seed, as far as ``MOST_BITS`` allows."""
SLICES = 64
"""Diagonals of one text go to the second pass in so many lists."""
MOST_BROADCAST = 1_000_000
WORDS_AT_ONCE = 200_000
STEP = np.uint64(0x9E3779B97F4A7C15)
DOC, ITEM = ("d1", "d2"), ("i1", "i2")

Mask = tuple[int, ...]


def seed_hashes(words: np.ndarray, mask: Mask) -> np.ndarray:
    """Hash of the open positions of every window. The words' hashes are uniform, and so are their sums."""
    n = max(len(words) - mask[-1], 0)
    out = words[:n].copy()
    with np.errstate(over="ignore"):
        for o in mask[1:]:
            out *= STEP
            out += words[o : o + n]
        out *= STEP
    return out ^ np.uint64(xxhash.xxh3_64_intdigest(repr(mask)))


def item_seeds(words: np.ndarray) -> Iterator[tuple[Mask, np.ndarray, np.ndarray]]:
    """(mask, hashes, places) of an item: all windows of all masks, or n // 5 + 1 pieces of an item below ``LEAST_WORDS``."""
    n = len(words)
    if n >= LEAST_WORDS:
        for mask in MASKS:
            found = seed_hashes(words, mask)
            yield mask, found, np.arange(len(found))
    elif n:
        cuts = [n * k // (n // 5 + 1) for k in range(n // 5 + 2)]
        for p, q in zip(cuts, cuts[1:], strict=False):
            mask = tuple(range(q - p))
            yield mask, seed_hashes(words[p:q], mask), np.array([p])


def longest(same: np.ndarray, least: int) -> tuple[int, int, float] | None:
    """(start, length, share) of the longest stretch of at least ``least`` with a share of ``LEAST_SHARE``, ending in agreements.

    With +1 for an agreement and -4 for the rest, a stretch has that share when its sum is not negative.
    """
    n = len(same)
    if n < least:
        return None
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])
    top = np.maximum.accumulate(sums[::-1])[::-1]  # the highest sum from each place on
    best = None
    end = 0
    for start in range(n):
        if not same[start]:
            continue
        end = max(end, start)
        while end < n and top[end + 1] >= sums[start]:
            end += 1
        size = end - start
        if size >= least and (best is None or size > best[1]):
            best = (start, size, float(round(same[start:end].mean(), 6)))
    return best


def overlap(words: np.ndarray, at: int, item: np.ndarray, shifts: list[int]) -> tuple[int, float, int, int] | None:
    """(words, share, doc_start, item_start) of the best overlap on the given diagonals, if there is one.

    ``words`` are those of the text from ``at`` on; a shift is the text's position less the item's. Best is the most words,
    then the highest share, then the first place.
    """
    best = None
    for shift in shifts:
        first, last = max(at, shift), min(at + len(words), shift + len(item))
        same = words[first - at : last - at] == item[first - shift : last - shift]
        if (found := longest(same, min(LEAST_WORDS, len(item)))) is not None:
            start, size, share = found
            best = max(best or (0,), (size, share, -(first + start), -(first + start - shift)))
    return best and (best[0], best[1], -best[2], -best[3])


def _identity(text: Column, names: tuple[str, str]) -> list[Column]:
    """A text as 128 bits of hashes."""
    return [F.xxhash64(text).alias(names[0]), F.xxhash64(F.lit(1), text).alias(names[1])]


def _seed_table(items: DataFrame) -> DataFrame:
    """(hash, mask, at, n, i1, i2): the seeds of every item, with their place in it and its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = hashes.of(text)
                for mask, found, places in item_seeds(words):
                    n = len(found)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(found.view(np.int64)), pa.array([",".join(map(str, mask))] * n, pa.string()), pa.array(places, pa.int32()),
                            pa.array([len(words)] * n, pa.int32()), *[pa.array([batch.column(k)[i].as_py()] * n, pa.int64()) for k in (0, 1)],
                        ],
                        ["hash", "mask", "at", "n", *ITEM],
                    )

    return items.mapInArrow(run, "hash long, mask string, at int, n int, i1 long, i2 long")


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash in a bitmap of ``2**bits``."""
    return hashes >> np.uint64(64 - bits), hashes & np.uint64((1 << bits) - 1)


def _bitmap(seeds: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """(bits, bytes) of the bitmap with both slots of every seed set, put together by Spark as 64-bit words."""
    bits = min(MOST_BITS, max(LEAST_BITS, (n * SPARSE).bit_length()))
    slot = F.explode(F.array(F.shiftrightunsigned("hash", 64 - bits), F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))))
    words = (
        seeds.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("place"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("word"))
    )
    found = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found.column("place").to_numpy()] = found.column("word").to_numpy()
    return bits, out.view(np.uint8)


def _possible(texts: list[np.ndarray], masks: list[Mask], bits: int, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, place) of every window of the texts that the bitmap lets pass.

    The texts are hashed as one array; windows that reach from one text into the next are left out.
    """
    starts = np.cumsum([0, *map(len, texts)])
    words = np.concatenate(texts)
    out = [(np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int))]
    for mask in masks:
        own = seed_hashes(words, mask)
        at = np.arange(len(own))
        for slot in _slots(own, bits):
            slot = slot[at]
            at = at[(bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        text = np.searchsorted(starts, at, "right") - 1
        inside = at + mask[-1] < starts[text + 1]
        out.append((text[inside], own[at[inside]], at[inside] - starts[text[inside]]))
    text, found, place = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(text, kind="stable")
    return text[order], found[order], place[order]


def _hits(texts: DataFrame, masks: list[Mask], bits: int, bitmap: np.ndarray) -> DataFrame:
    """(d1, d2, text, hashes, places) of the texts with a window that may be a seed."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def grouped(values: list[str | None], hashes: WordHashes) -> Iterator[tuple[int, list[np.ndarray]]]:
        at, group, size = 0, [], 0
        for i, value in enumerate(values):
            group.append(hashes.of(value))
            size += len(group[-1])
            if size >= WORDS_AT_ONCE or i == len(values) - 1:
                yield at, group
                at, group, size = i + 1, [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in (part for whole in batches for part in slices(whole, 2, TEXT_AT_ONCE)):
            for at, group in grouped(batch.column(2).to_pylist(), hashes):
                text, found, place = _possible(group, masks, bits, shared.value)
                if not len(text):
                    continue
                rows, first = np.unique(text, return_index=True)
                ends = pa.array(np.append(first, len(text)), pa.int32())
                picked = batch.take(pa.array(rows + at))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (found.view(np.int64), place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*picked.columns, *lists], [*DOC, "text", "hashes", "places"])

    return texts.mapInArrow(run, "d1 long, d2 long, text string, hashes array<long>, places array<int>")


def _clips(met: DataFrame) -> DataFrame:
    """(d1, d2, i1, i2, shifts, at, clip): the words of a text, from ``at`` on, that an item covers on its diagonals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in (part for whole in batches for part in slices(whole, 2, TEXT_AT_ONCE)):
            out = []
            for d1, d2, text, diagonals in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, items = hashes.of(text), {}
                for d in diagonals:
                    items.setdefault((d["i1"], d["i2"], d["n"]), []).append(d["shift"])
                for (i1, i2, n), shifts in items.items():
                    at = max(0, min(shifts))
                    out.append((d1, d2, i1, i2, sorted(shifts), at, words[at : max(shifts) + n].tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [*[pa.int64()] * 4, pa.list_(pa.int32()), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*DOC, *ITEM, "shifts", "at", "clip"])

    return met.select(*DOC, "text", "diagonals").mapInArrow(run, "d1 long, d2 long, i1 long, i2 long, shifts array<int>, at int, clip binary")


FOUND = "words int, share double, doc_start int, item_start int"


def _verified(met: DataFrame) -> DataFrame:
    """The best overlap of each text with each item that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in (part for whole in batches for part in slices(whole, 6, TEXT_AT_ONCE)):
            out = []
            for *ids, shifts, at, clip, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (best := overlap(np.frombuffer(clip, np.uint64), at, hashes.of(item), shifts)) is not None:
                    out.append((*ids, *best))
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = [*[pa.int64()] * 4, pa.int32(), pa.float64(), pa.int32(), pa.int32()]
            names = [*DOC, *ITEM, *[f.split()[0] for f in FOUND.split(", ")]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return met.select(*DOC, *ITEM, "shifts", "at", "clip", "item").mapInArrow(run, f"d1 long, d2 long, i1 long, i2 long, {FOUND}")


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", bench_text: str = "text") -> DataFrame:
    """(d1, d2, i1, i2, words, share, doc_start, item_start): the best overlap of each distinct text with each distinct item.

    d1 and d2 identify a text, i1 and i2 an item, by its hashes. Null, empty and wordless texts and items have no overlap. An
    item shorter than ``LEAST_WORDS`` must be matched whole, with the same share of equal words. Texts are read whole.
    """
    own = benchmark.where(F.col(bench_text).isNotNull()).select(*_identity(F.col(bench_text), ITEM), F.col(bench_text).alias("item"))
    items = own.groupBy(*ITEM).agg(F.any_value("item").alias("item"))
    seeds = cut(_seed_table(items))
    masks = sorted(tuple(map(int, r["mask"].split(","))) for r in seeds.select("mask").distinct().collect())
    bits, bitmap = _bitmap(seeds, seeds.count())
    texts = docs.where(F.col(text).isNotNull()).select(*_identity(F.col(text), DOC), F.col(text).alias("text"))
    found = _hits(texts, masks, bits, bitmap).groupBy(*DOC).agg(F.any_value(F.struct("text", "hashes", "places")).alias("hit"))
    found = cut(found.select(*DOC, "hit.*"))
    asked = found.select(*DOC, F.explode(F.arrays_zip("hashes", "places")).alias("s")).select(*DOC, F.col("s.hashes").alias("hash"), "s.places")
    met = asked.join(seeds, "hash").select(*DOC, F.struct(*ITEM, "n", (F.col("places") - F.col("at")).alias("shift")).alias("diagonal"))
    part = F.pmod(F.xxhash64("diagonal.i1", "diagonal.i2"), F.lit(SLICES)).alias("part")
    diagonals = met.groupBy(*DOC, part).agg(F.collect_set("diagonal").alias("diagonals"))
    # Written and read again: next to the check of the overlaps they would take a second Python worker a task, which executors keep.
    clips = cut(_clips(diagonals.join(found.select(*DOC, "text"), list(DOC))))
    return _verified(clips.join(items, list(ITEM)))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(key, item, words, share, doc_start, item_start): one row for each document and benchmark item that overlap.

    Repeated rows of either side each have their own. Other columns are not carried.
    """
    own = docs.select(F.col(key), *_identity(F.col(text), DOC))
    items = benchmark.select(F.col(item), *_identity(F.col("text"), ITEM))
    found = leaks(docs, benchmark, text)
    return own.join(found.join(items, list(ITEM)), list(DOC)).select(key, item, "words", "share", "doc_start", "item_start")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that overlap no benchmark item, with all their columns; those with a null or empty text stay.

    The texts found are broadcast where there are at most ``MOST_BROADCAST``, and joined otherwise.
    """
    a, b = free_name(docs, "__d1"), free_name(docs, "__d2")
    found = cut(leaks(docs, benchmark, text).select(F.col("d1").alias(a), F.col("d2").alias(b)).distinct())
    if found.count() <= MOST_BROADCAST:
        found = F.broadcast(found)
    first, second = (F.expr(f"xxhash64({x}`{text}`)") for x in ("", "1, "))
    return docs.join(found, (first == F.col(a)) & (second == F.col(b)), "left_anti")
