"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At each position of a text the automaton gives every piece that ends there, following its output links from the
longest to the shortest, and each relaxes the best score of that position. A character that no piece covers falls back
to its UTF-8 bytes. The ids are those of the segmentation with the highest sum of piece scores.

A text starts with one added space, as the model asks. No piece reaches across certain borders (before a space, between
letters and other characters); a text is cut there first and equal parts share one result, which changes no id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MEMO, MEMO_LENGTH = 300_000, 24


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: pieces by id with a space for the mark of one, their scores, and the ids of the 256 bytes."""

    text: list[str]
    score: list[float]
    byte_ids: list[int]
    special: frozenset[int]

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in ids]
        of_byte = {pieces[i]: i for i in ids if model.is_byte(i)}
        special = frozenset(i for i in ids if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        return cls(
            [p if i in special else p.replace(SPACE, " ") for i, p in enumerate(pieces)],
            [model.get_score(i) for i in ids],
            [of_byte[f"<0x{b:02X}>"] for b in range(256)],
            special,
        )


def cutter(pieces: list[str]) -> re.Pattern:
    """A pattern whose matches cut every text at borders that no piece crosses.

    Spaces go with what follows; runs of letters and digits are cut from runs of other characters. Letters of pieces
    that mix the two count as other characters. With many such letters, only spaces and line ends are borders.
    """
    other = {"_"}
    while len(other) < 20:
        mark = re.escape("".join(sorted(other)))
        cut = re.compile(rf" *[^\W{mark}]+| *(?:[^\w \n]|[{mark}])+| +|\n")
        mixed = [p for p in pieces if not cut.fullmatch(p)]
        if not mixed:
            return cut
        other |= {c for p in mixed for c in p if re.match(r"\w", c)}
    return re.compile(r" *[^ \n]+| +|\n")


class Codec:
    """Encoder and decoder over one vocabulary, with a bounded memory of parts already encoded."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        normal = [(i, p) for i, p in enumerate(pieces.text) if i not in pieces.special]
        self.automaton = ahocorasick.Automaton()
        for i, p in normal:
            self.automaton.add_word(p, (i, len(p), pieces.score[i]))
        self.automaton.make_automaton()
        self.single = {p for _, p in normal if len(p) == 1}
        self.unknown = min((pieces.score[i] for i, _ in normal), default=0.0) - 10
        self.cut = cutter([p for _, p in normal])
        self.byte_of = {i: b for b, i in enumerate(pieces.byte_ids)}
        self.memo: dict[str, list[int]] = {}

    def viterbi(self, part: str) -> list[int]:
        """Ids of the best segmentation; of equal ones, that whose last differing piece is the longer."""
        n = len(part)
        best, back = [0.0] + [-math.inf] * n, [(-1, 1)] * (n + 1)
        bare = [at for at, c in enumerate(part) if c not in self.single]
        found = self.automaton.iter(part)
        if bare:
            found = _with_bytes(found, bare, self.unknown)
        for end, (piece, size, score) in found:
            total = best[end + 1 - size] + score
            if total > best[end + 1]:
                best[end + 1], back[end + 1] = total, (piece, size)
        out, at = [], n
        while at:
            piece, size = back[at]
            if piece < 0:
                out += [self.pieces.byte_ids[b] for b in reversed(part[at - 1].encode())]
            else:
                out.append(piece)
            at -= size
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; none for a null or empty one. The mark of a space, as a character, becomes bytes."""
        if not text:
            return []
        ids: list[int] = []
        memo = self.memo
        for part in self.cut.findall(" " + text):
            found = memo.get(part)
            if found is None:
                found = self.viterbi(part)
                if len(part) <= MEMO_LENGTH:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[part] = found
            ids += found
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids; runs of byte pieces are read as UTF-8."""
        pieces = self.pieces.text
        if self.byte_of.keys().isdisjoint(ids):
            return "".join(map(pieces.__getitem__, ids))[1:]
        out = bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is None:
                out += pieces[i].encode()
            else:
                out.append(byte)
        return out.decode("utf-8", "replace")[1:]


def _with_bytes(found: Iterator, bare: list[int], score: float) -> Iterator:
    """The matches in order of their ends, with a step of one character wherever no piece is that character."""
    steps = iter([*bare, math.inf])
    at = next(steps)
    for end, match in found:
        while at < end:
            yield at, (-1, 1, score)
            at = next(steps)
        yield end, match
    while at < math.inf:
        yield at, (-1, 1, score)
        at = next(steps)


def encode(docs: DataFrame, text: str = "text", path: str = MODEL) -> DataFrame:
    """Adds ``ids`` (array<int>), ``n_tokens`` (long) and ``round_trip`` (whether the ids decode to the text) to all columns.

    The driver reads the model and broadcasts its table, whose size is that of the vocabulary. A null text has no ids
    and counts as an empty one. Texts are read whole; repeated rows have a row each. Columns that have these names already are
    replaced.
    """
    docs = docs.drop("ids", "n_tokens", "round_trip")
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(path))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            ids, sizes, same = [], [], []
            for value in batch.column(at).to_pylist():
                own = codec.encode(value)
                same.append(codec.decode(own) == (value or ""))
                sizes.append(len(own))
                ids.append(np.array(own, np.int32))
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists, pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())],
                [*batch.schema.names, "ids", "n_tokens", "round_trip"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, ids array<int>, n_tokens long, round_trip boolean")


def decode(rows: DataFrame, ids: str = "ids", path: str = MODEL) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``, to all columns, in place of such a column.

    A null list stays null, an empty one is an empty text. Ids that are null or of no piece of the vocabulary are left out.
    """
    rows = rows.drop("decoded")
    pieces = Pieces.load(path)
    shared, known = rows.sparkSession.sparkContext.broadcast(pieces), range(len(pieces.text))
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            texts = [None if x is None else codec.decode([i for i in x if i is not None and i in known]) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, decoded string")
