"""Secrets in texts: fixed patterns, and a guess-cost dynamic program over values in a credential context.

The guess cost of a value is the least total, in bits, over all ways to cut it into dictionary words, dates, repeats,
keyboard or alphabet walks and brute-force runs. A value after a credential word that costs at least
``MIN_BITS`` is a secret, whatever its alphabet; ``password: changeme`` is not. The dictionary holds common passwords and the
words of two public vocabulary files, one of English and one of many languages, so that a word of prose costs its rank and not
its letters. It is the same for all inputs: no document decides over another's spans. A word in none of these costs its letters.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_BITS = math.log2(10**10)
"""Ten thousand million guesses: what a slow hash is commonly taken to withstand."""
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
PIECES = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
LONGEST = 20
"""Letters of the longest word that is looked up."""

# Common passwords and words in them, the commonest first.
WORDS = """password 123456 qwerty admin welcome letmein monkey dragon master login abc123 football baseball sunshine
princess iloveyou shadow superman michael trustno1 hello freedom whatever starwars computer secret summer winter spring
autumn changeme default guest root test user demo example sample temp service server database system internet access
private public token key pass word love money hunter ninja batman soccer hockey flower cookie orange banana chocolate
none null true false your here placeholder undefined todo required string value redacted""".split()
# Rows of keys and of the alphabet along which walks go.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "0123456789", "abcdefghijklmnopqrstuvwxyz", "qwertzuiop", "azertyuiop",
        "1qaz", "2wsx", "3edc", "4rfv", "5tgb", "6yhn", "7ujm", "8ik", "9ol", "0p")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code|wort)|pwd|contraseña|mot\x20de\x20passe|secret|token|api[_-]?key|credential|"""
    r"""(?:access|private|client|auth|encryption|signing)[_-]?(?:key|secret|token)|bearer)["']?"""
    r"""\x20{0,8}(?:[:=]|\x20is\x20)\x20{0,8}(["']?)([!-~]{6,})""",
    re.I | re.A,
)
# The Java form of all that the patterns need, to leave texts without it out of Python.
ANY = "(?i)pass|pwd|contrase|secret|token|api[_-]?key|credential|key|bearer|AKIA|[0-9a-f]{32}"
DATE = re.compile(r"(?:19|20)\d\d(?:[-./]?\d\d(?:[-./]?\d\d)?)?|\d{1,2}[-./]\d{1,2}[-./](?:\d\d){1,2}")
LEET = str.maketrans("@4301!$57", "aaeoiisst")

_BITS = {w: math.log2(rank + 1) for rank, w in enumerate(dict.fromkeys(WORDS), 1)}
_NEXT = {(a, b) for row in ROWS for a, b in [*zip(row, row[1:]), *zip(row[::-1], row[::-1][1:])]}
SEGMENT_BITS = 1.0
WALK_BITS, DATE_BITS, YEAR_BITS = 5.0, 15.0, math.log2(200)


def _alphabet(value: str) -> float:
    """Bits of one brute-force character, from the kinds of character that the value has."""
    size = 10 * any("0" <= c <= "9" for c in value) + 26 * any("a" <= c <= "z" for c in value)
    size += 26 * any("A" <= c <= "Z" for c in value) + 33 * any(not c.isalnum() for c in value)
    return math.log2(max(size, 10))


class _Starts:
    """The least of best[start] + log2(end - start) over the starts added so far, for ends up to ``last``.

    Of two such curves the later one is below at first and the other from some end on, so a Li Chao tree holds them.
    """

    def __init__(self, last: int) -> None:
        self.last = last
        self.held: dict[int, tuple[int, float]] = {}

    @staticmethod
    def _value(curve: tuple[int, float], end: int) -> float:
        return curve[1] + math.log2(end - curve[0]) if end > curve[0] else -math.inf

    def add(self, start: int, bits: float) -> None:
        new, node, low, high = (start, bits), 1, 0, self.last
        while (held := self.held.get(node)) is not None:
            mid = (low + high) // 2
            if self._value(new, mid) < self._value(held, mid):
                self.held[node], new, held = new, held, new
            if low == high:
                return
            if held[0] < new[0] < mid:
                node, high = 2 * node, mid
            else:
                node, low = 2 * node + 1, mid + 1
        self.held[node] = new

    def least(self, end: int) -> float:
        found, node, low, high = math.inf, 1, 0, self.last
        while (held := self.held.get(node)) is not None:
            found = min(found, self._value(held, end))
            if low == high:
                break
            mid = (low + high) // 2
            node, low, high = (2 * node, low, mid) if end <= mid else (2 * node + 1, mid + 1, high)
        return found


def guess_bits(value: str, words: dict[str, float] = _BITS) -> float:
    """The least cost of the value in bits; 0 for an empty one. ``words`` has the bits of each word of the dictionary.

    ``best[i]`` is the least cost of the first i characters. A brute-force run pays for its start once and then for
    each character, so it needs no inner loop. Words and dates may start and end anywhere, walks and repeats anywhere in
    their longest run. Time is the length times the longest word, and the logarithm of the length within runs.
    """
    n, per_char = len(value), _alphabet(value)
    best, brute = [math.inf] * (n + 1), math.inf
    best[0] = 0.0
    lower = value.lower()
    plain = lower.translate(LEET)
    walk_from, same_from = [0] * n, [0] * n
    for i in range(1, n):
        walk_from[i] = walk_from[i - 1] if (lower[i - 1], lower[i]) in _NEXT else i
        same_from[i] = same_from[i - 1] if value[i - 1] == value[i] else i
    dates: dict[int, list[int]] = {}
    for start in range(n):
        if value[start].isdigit():
            for end in range(start + 4, min(start + 10, n) + 1):
                if DATE.fullmatch(value, start, end):
                    dates.setdefault(end, []).append(start)
    runs = [[walk_from, -1, None, WALK_BITS], [same_from, -1, None, per_char]]
    for end in range(1, n + 1):
        brute = min(brute, best[end - 1] + SEGMENT_BITS) + per_char
        cost = brute
        for start in range(max(0, end - LONGEST), end):
            for form, extra in ((lower, 0.0), (plain, 1.0)):
                if (bits := words.get(form[start:end])) is not None:
                    upper = value[start:end]
                    cost = min(cost, best[start] + SEGMENT_BITS + bits + extra + (upper != upper.lower()))
        for start in dates.get(end, ()):
            cost = min(cost, best[start] + SEGMENT_BITS + (YEAR_BITS if end - start == 4 else DATE_BITS))
        for run in runs:
            first, held, starts, bits = run
            if end - first[end - 1] >= 3:
                if first[end - 1] != held:
                    run[1:3] = first[end - 1], (starts := _Starts(n))
                starts.add(end - 3, best[end - 3])
                cost = min(cost, starts.least(end) + SEGMENT_BITS + bits)
        for width in (2, 3, 4):  # a block said again
            if end >= 2 * width and value[end - width : end] == value[end - 2 * width : end - width]:
                cost = min(cost, best[end - width] + SEGMENT_BITS + 1)
        best[end] = cost
    return best[n]


def vocabulary(words: str | None = VOCABULARY, pieces: str | None = PIECES) -> dict[str, float]:
    """Bits of the fixed words and of two public vocabulary files, each word by its rank in the file that ranks it higher.

    ``words`` is a file of English pieces, of which whole words of letters count; ``pieces`` one of many languages, of which words of three letters or
    more count and parts of words of four or more, as long words are put together of them. Only ASCII letters can be in a value.
    """
    ranked: list[Iterator[str]] = []
    if words is not None:
        with open(words, encoding="utf-8") as file:
            known = json.load(file)["model"]["vocab"]
        whole = (p.removesuffix("</w>") for p in sorted(known, key=known.get) if p.endswith("</w>"))
        ranked.append(iter([w for w in whole if re.fullmatch("[a-z]+", w)]))
    if pieces is not None:
        with open(pieces, "rb") as file:
            known = (base64.b64decode(line.split()[0]).decode("utf-8", "replace").lower() for line in file if line.strip())
            ranked.append(iter([p.strip(" ") for p in known if re.fullmatch("(?: [a-z]{3,}|[a-z]{4,})", p)]))
    bits = dict(_BITS)
    for file in ranked:
        for rank, w in enumerate(dict.fromkeys(file), 1):
            bits[w] = min(bits.get(w, math.inf), math.log2(rank + 1))
    return bits


def spans(text: str, words: dict[str, float] = _BITS) -> tuple[list[tuple[int, int, str, float]], list[tuple[int, int, str, float]]]:
    """Base spans and added ones as (start, end, kind, bits), each in order of start, then kind."""
    base = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 8:
            base.append((m.start(), 0, m.end(), "assign", guess_bits(m[2], words)))
    for order, kind, pattern in ((1, "access", ACCESS), (2, "hex", HEX)):
        base += [(m.start(), order, m.end(), kind, guess_bits(m[0], words)) for m in pattern.finditer(text)]
    base = [(s, e, kind, bits) for s, _, e, kind, bits in sorted(base)]
    starts = [s for s, *_ in base]
    reached = list(accumulate((e for _, e, *_ in base), max))  # the furthest end of each base span and those before it
    added = []
    for m in CONTEXT.finditer(text):
        value = m[2].split(m[1])[0] if m[1] else m[2].rstrip("""."',;:!?)]}|""")
        start, end = m.start(2), m.start(2) + len(value)
        before = bisect_right(starts, end - 1)
        free = not before or reached[before - 1] <= start
        if free and len(value) >= 6 and (bits := guess_bits(value, words)) >= MIN_BITS:
            added.append((start, end, "guess", bits))
    return base, added


def _listed(found: list[tuple[int, int, str, float]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, _ in found)


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, min_bits double"


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", words: str | None = VOCABULARY, pieces: str | None = PIECES) -> DataFrame:
    """Counts of the base kinds, the digest of their spans and all spans of every document, and the lowest guess cost.

    A null or empty text has no span, and ``min_bits`` is null where there is none. Texts are scanned whole; only those
    that lack every trigger of the patterns skip the scan. Repeated rows are scanned each for itself; columns besides key and
    text are not carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(words, pieces))
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), F.when(whole.rlike(ANY), whole).otherwise("").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for value in batch.column(1).to_pylist():
                base, added = spans(value, known)
                kinds = [s[2] for s in base]
                row = [kinds.count(k) for k in ("assign", "access", "hex")]
                every = sorted(base + added, key=lambda s: s[0])  # stable: base kinds come first
                row += [hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every), min((s[3] for s in every), default=None)]
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds_of = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(out, kinds_of, strict=True)]],
                [key, *[f.split()[0] for f in SCHEMA.split(", ")]],
            )

    return rows.mapInArrow(scan, f"`{key}` {docs.schema[key].dataType.simpleString()}, {SCHEMA}")
