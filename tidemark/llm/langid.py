"""Language identification by words first, then by backing off to ever shorter character n-grams.

A word that some language knows is scored by its log relative frequency in each language. A word that none knows is
scored at each position by the longest character n-gram known there, each step down costing ``BACKOFF``.

The model is fitted on a bounded sample of labelled rows, about ``max_docs`` in all and an equal share of them for each
label (``max_docs`` rows and ``max_bytes`` of text), chosen by hash. All words and n-grams of the sample are in the model, by
64-bit hashes, and all labels. Predictions read the text alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
BACKOFF = math.log(0.4)
MAX_DOCS, MAX_BYTES = 12_000, 200_000_000
MOST_BROADCAST = 100_000
MEMO_CELLS, MEMO_WORDS, WORDS_AT_ONCE, ROWS_AT_ONCE, GRAMS_AT_ONCE = 400_000, 150_000, 50_000, 1000, 10_000


def words(text: str | None) -> list[str]:
    """The runs of letters of a text, in lower case. Numerals such as "½" or "Ⅷ", which ``re`` takes for parts of words, end them."""
    found = WORD.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for word in found for part in "".join(c if c.isalpha() else " " for c in word).split()]


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def entry_hash(entry: str) -> int:
    """What Spark's ``xxhash64`` gives for the text, as an unsigned number."""
    return xxhash.xxh64_intdigest(entry.encode("utf-8", "surrogatepass"), 42)


@dataclass
class Entries:
    """Words, or n-grams of any length: for each one the languages that have it and by how much each beats a language that does not.

    ``hashes`` is sorted; entry i has ``langs[starts[i]:starts[i + 1]]`` with the gains ``gains`` beside them. Only pairs that occur are
    held, 12 bytes each, so the size follows the sample and not the number of labels.
    """

    hashes: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    gains: np.ndarray
    size: np.ndarray
    """The length of each entry's n-grams, 0 for words."""

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def add_to(self, total: np.ndarray, row: np.ndarray, place: np.ndarray, weight: np.ndarray | None = None) -> None:
        """Adds the gains of entries to rows of ``total``."""
        n = self.starts[place + 1] - self.starts[place]
        first = np.cumsum(n) - n
        at = np.repeat(self.starts[place] - first, n) + np.arange(n.sum())
        cell = np.repeat(row, n) * total.shape[1] + self.langs[at]
        gain = self.gains[at] if weight is None else self.gains[at] * np.repeat(weight, n)
        total += np.bincount(cell, gain, total.size).reshape(total.shape)


@dataclass
class Model:
    """Entries, and for each length of n-grams and language the log share of half a count, which an entry that the language lacks has."""

    langs: list[str]
    words: Entries
    grams: Entries
    base: np.ndarray
    """[length, language]; length 0 is that of words."""


class Scorer:
    """Scores of whole texts by one model, each distinct word looked up once.

    ``place`` gives a word its place in the model, or below -1 a row of ``table``, where words that the model does not know are
    scored when they first come. Both are emptied when they are full.
    """

    def __init__(self, model: Model) -> None:
        self.model, self.langs = model, model.langs
        self.place: dict[str, int] = {}
        self.table = np.zeros((max(1, MEMO_CELLS // max(len(model.langs), 1)), len(model.langs)))
        self.unknown = 0
        # A step down from the longest n-gram costs the same in every language.
        self.steps = model.base + ((LONGEST - np.arange(LONGEST + 1)) * BACKOFF)[:, None]

    def _longest(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The row in ``new`` and the n-gram of each place of the words where any is known: the longest one."""
        padded = [f"<{w}>" for w in new]
        sizes = np.array([len(p) for p in padded])
        row = np.repeat(np.arange(len(new)), sizes)
        found = np.full(len(row), -1)
        start = np.cumsum(sizes) - sizes
        for n in range(LONGEST, 0, -1):  # what a longer one settled is left out
            here = np.concatenate([np.arange(a, a + max(0, s - n + 1)) for a, s in zip(start, sizes, strict=True)])
            here = here[found[here] < 0]
            grams = (padded[r][i - start[r] : i - start[r] + n] for r, i in zip(row[here], here, strict=True))
            found[here] = self.model.grams.places(np.fromiter(map(entry_hash, grams), np.uint64, len(here)))
        return row[found >= 0], found[found >= 0]

    def learn(self, new: list[str]) -> None:
        """Gives places to words: those in the model, and rows to others, the mean over their places, so that each counts as one word."""
        place = self.model.words.places(np.fromiter(map(entry_hash, new), np.uint64, len(new)))
        others = [w for w, p in zip(new, place, strict=True) if p < 0]
        if self.unknown + len(others) > len(self.table):  # one very long text
            self.table = np.concatenate([self.table, np.zeros((self.unknown + len(others) - len(self.table), len(self.langs)))])
        for at in range(0, len(others), GRAMS_AT_ONCE):
            part = others[at : at + GRAMS_AT_ONCE]
            row, gram = self._longest(part)
            n = np.bincount(row, minlength=len(part))
            values = np.zeros((len(part), len(self.langs)))
            np.add.at(values, row, self.steps[self.model.grams.size[gram]])
            self.model.grams.add_to(values, row, gram)
            self.table[self.unknown + at : self.unknown + at + len(part)] = values / np.maximum(n, 1)[:, None]
        place[place < 0] = -2 - np.arange(self.unknown, self.unknown + len(others))
        self.unknown += len(others)
        self.place.update(zip(new, place.tolist(), strict=True))

    def forget(self) -> None:
        self.place.clear()
        self.unknown = 0

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, posterior share) of each whole text; ('und', 0) without a letter, a null text or a model.

        Of equal languages the first in alphabetical order is taken.
        """
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.langs:
            return out
        group: list[list[str]] = []
        places: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            found = words(text)
            if found:
                group.append(found)
                places.append(i)
                size += len(found)
            if group and (size >= WORDS_AT_ONCE or i == len(texts) - 1):
                for at, result in zip(places, self._group(group), strict=True):
                    out[at] = result
                group, places, size = [], [], 0
        return out

    def _group(self, group: list[list[str]]) -> list[tuple[str, float]]:
        flat = [w for found in group for w in found]
        new = list(dict.fromkeys(w for w in flat if w not in self.place))
        if len(self.place) + len(new) > MEMO_WORDS or self.unknown + len(new) > len(self.table):
            self.forget()
            new = list(dict.fromkeys(flat))
        self.learn(new)
        place = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        text = np.repeat(np.arange(len(group)), [len(f) for f in group])
        known = place >= 0
        total = np.bincount(text[known], minlength=len(group))[:, None] * self.model.base[0]
        self.model.words.add_to(total, text[known], place[known])
        others = np.flatnonzero(~known)
        if len(others):
            own, first = np.unique(text[others], return_index=True)
            total[own] += np.add.reduceat(self.table[-2 - place[others]], first)
        best = total.argmax(1)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [(self.langs[b], round(float(s), 6)) for b, s in zip(best, share, strict=True)]


def _entries(counts: pa.Table, langs: list[str]) -> tuple[Entries, np.ndarray]:
    """Entries of (lang, size, hash, n) rows, and the rows of ``base`` of their lengths; half a count where a language lacks one."""
    own = pc.index_in(counts.column("lang").combine_chunks(), pa.array(langs, pa.string())).to_numpy(zero_copy_only=False)
    size, n = (counts.column(c).to_numpy() for c in ("size", "n"))
    hashes = counts.column("hash").to_numpy().view(np.uint64)
    total = np.zeros((LONGEST + 1, len(langs)))
    np.add.at(total, (size, own), n)
    order = np.lexsort((own, hashes))
    distinct, starts = np.unique(hashes[order], return_index=True)
    entries = Entries(distinct, np.append(starts, len(order)), own[order].astype(np.int32), np.log(2.0 * n[order]), size[order][starts].astype(np.int8))
    return entries, np.log(0.5 / np.maximum(total, 1))


def _sample(docs: DataFrame, text: str, lang: str, key: str, max_docs: int, max_bytes: int) -> DataFrame:
    """(lang, text) of about ``max_docs`` rows, of each language an equal share, at least one: those with the smallest hash of key and text length.

    A first pass over the labels counts each language, so that the second passes on about twice the rows wanted. The shares, a
    row a label, are broadcast up to ``MOST_BROADCAST`` labels and joined beyond.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = cut(labelled.groupBy(lang).agg(F.count("*").alias("__n")))
    labels = counts.count()
    most = max(1, max_docs // max(1, labels))
    share = counts.select(F.col(lang).alias("__lang"), F.least(F.lit(1.0), (20.0 + 2.0 * most) / F.col("__n")).alias("__share"))
    draw = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.length(text)), 11) * F.lit(2.0**-53)
    rows = labelled.select(F.col(lang).alias("__lang"), F.col(text).alias("__text"), draw.alias("__draw"))
    some = rows.join(F.broadcast(share) if labels <= MOST_BROADCAST else share, "__lang").where(F.col("__draw") <= F.col("__share"))
    order = Window.partitionBy("__lang").orderBy("__draw", F.xxhash64("__text"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = some.withColumn("__rank", F.row_number().over(order)).withColumn("__before", F.coalesce(F.sum(F.octet_length("__text")).over(before), F.lit(0)))
    return ranked.where((F.col("__rank") <= most) & (F.col("__before") < max_bytes // max(1, labels))).select("__lang", "__text")


def _counted(found: Counter, kinds: tuple[tuple[str, pa.DataType], ...]) -> pa.RecordBatch:
    """The entries of a counter as columns, with their counts as the last one."""
    columns = [*zip(*found, strict=True), found.values()] if found else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A thousand rows at a time, as a worker keeps the memory that its largest part took."""
    return (whole.slice(start, ROWS_AT_ONCE) for whole in batches for start in range(0, whole.num_rows, ROWS_AT_ONCE))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        found: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.update((lang, w) for w in words(text))
        yield _counted(found, (("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        found: Counter = Counter()
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for size in range(1, LONGEST + 1):
                for gram in grams(word, size):
                    found[lang, size, gram] += n
        yield _counted(found, (("lang", pa.string()), ("size", pa.int32()), ("gram", pa.string()), ("n", pa.int64())))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Model:
    """Fits the model on the labelled rows of ``docs``; without any, the model knows no language.

    Rows with a null text or label do not take part; repeated rows do. The driver gets hashes and counts of the words and n-grams of the
    sample, which ``max_bytes`` bounds.
    """
    sample = _sample(docs, text, lang, key, max_docs, max_bytes)
    counted = sample.mapInArrow(_count_words, "lang string, word string, n long")
    by_word = cut(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    by_gram = by_word.mapInArrow(_count_grams, "lang string, size int, gram string, n long")
    by_gram = by_gram.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    found = by_gram.select("lang", "size", F.xxhash64("gram").alias("hash"), "n").toArrow()
    langs = sorted(pc.unique(found.column("lang")).to_pylist())
    words, base = _entries(by_word.select("lang", F.lit(0).alias("size"), F.xxhash64("word").alias("hash"), "n").toArrow(), langs)
    grams, gram_base = _entries(found, langs)
    return Model(langs, words, grams, np.concatenate([base[:1], gram_base[1:]]))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``lang_score`` to all columns of ``docs``, in place of such columns; every text is read whole."""
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in _parts(batches):
            found = scorer.predict(batch.column(at).to_pylist())
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "lang_pred", "lang_score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, lang_score double")


def held_out(key: str = "doc_id") -> Column:
    """Rows that the model must not learn from; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """(key, held_out, lang_pred, score) of every row, by a model of the rows that are not held out.

    A text that is null or has no letter is ``und`` with score 0. Texts are read whole. Repeated rows have a row each; other
    columns are not carried.
    """
    model = fit(docs.where(~held_out(key)), text, lang, key)
    found = predict(docs.select(key, text), model, text)
    return found.select(key, held_out(key).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
