"""Personal data, in built-in functions only.

Regular expressions propose spans, checksum validators (Luhn, mod 97, octet ranges, digit counts) confirm them, and
context words shortly before a span raise its score. Spans are in code points, the end exclusive.

The patterns start only where a maximal run starts or a match has just ended (``\\G``) and repeat possessively. They
match what the plain forms match from left to right, in time linear in the text and without deep recursion.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import free_name

CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.3
THRESHOLD = 0.6
CHUNK_BITS = 8

OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where a string of digits passes the Luhn check."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """True where an account number passes the mod-97 check of ISO 7064."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


@dataclass(frozen=True)
class Kind:
    """One kind of span: a cheap guard, the pattern, what confirms a match, and words that make it likelier."""

    name: str
    guard: str
    pattern: str
    confirm: object
    score: float
    context: str
    always: bool = True


KINDS = (
    Kind(
        "email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        None, 0.9, "mail|contact|courriel|correo|kontakt",
    ),
    Kind(
        "ip", "[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
        lambda v: v.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), 0.6, r"\bip\b|address|host|server|adresse",
    ),
    Kind(
        "card", "[0-9]", r"[0-9](?:[\x20-]?[0-9]){11,}+",
        lambda v: _between(F.length(_digits(v)), 12, 19) & luhn(_digits(v)), 0.7, "card|visa|credit|karte|carte|tarjeta",
    ),
    Kind(
        "phone", r"\+", r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda v: _between(F.length(_digits(v)), 9, 15), 0.7, r"\btel|phone|call|mobil|fax|appel",
    ),
    Kind(
        "iban", "[A-Z]{2}[0-9]{2}",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
        mod97, 0.9, "iban|account|konto|compte|cuenta", False,
    ),
    Kind(
        "ssn", "[0-9]-[0-9]", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        None, 0.4, r"\bssn\b|social security|sozialversicherung", False,
    ),
)
"""The first four always stay and are the base kinds; the others stay from ``THRESHOLD`` on."""

BASE_KINDS = tuple(k.name for k in KINDS if k.always)


def _computed(df: DataFrame, name: str, **values: Column) -> DataFrame:
    """Adds the struct ``name`` of ``values``, computed once a row.

    Optimisation would merge a plain projection into the lambdas that read it, which would compute it for every element.
    """
    return df.select("*", F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias(name))


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Each value of an array joined with all before it, by doubling: in time n log n."""
    reach = F.filter(F.array(*[F.lit(1 << b) for b in range(31)]), lambda p: p < F.size(values))

    def double(so_far: Column, step: Column) -> Column:
        return F.transform(so_far, lambda x, i: F.coalesce(join(x, F.get(so_far, i - step)), x))

    return F.aggregate(reach, values, double)


def _chunks(text: Column) -> Column:
    """The text in pieces of ``2**CHUNK_BITS`` code points, so that a part of it is found without reading what is before."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << CHUNK_BITS}}}"), F.lit(0))


def _part(chunks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` (exclusive) of a text in chunks."""
    first = F.shiftright(start, CHUNK_BITS)
    near = F.array_join(F.slice(chunks, first + 1, F.shiftright(end, CHUNK_BITS) - first + 1), "")
    return F.substr(near, start - F.shiftleft(first, CHUNK_BITS) + 1, end - start)


def _pairs(text: Column, kind: Kind) -> Column:
    """array<struct<gap, hit>>: the pattern's matches from left to right, each with the text before it; the last gap has no hit."""
    between = F.split(text, kind.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pairs = F.arrays_zip(between.alias("gap"), found.alias("hit"))
    return F.when(text.rlike(kind.guard), pairs).otherwise(F.array().cast("array<struct<gap:string,hit:string>>"))


def _ends(pairs: Column) -> Column:
    """Where each pair ends in the text: running sums of the lengths."""
    return _running(F.transform(pairs, lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0))), lambda a, b: a + b)


def _spans(pairs: Column, ends: Column, kind: Kind, order: int) -> Column:
    """The spans of one kind that its validator lets pass."""

    def span(p: Column, i: Column) -> Column:
        end = F.get(ends, i)
        return F.struct(
            (end - F.length(p["hit"])).alias("start"), F.lit(order).alias("ord"), end.alias("end"),
            F.lit(kind.name).alias("kind"), p["hit"].alias("value"),
        )

    hits = F.filter(F.transform(pairs, span), lambda s: s["value"].isNotNull())
    return hits if kind.confirm is None else F.filter(hits, lambda s: kind.confirm(s["value"]))


def _scored(chunks: Column, spans: Column) -> Column:
    """Spans with scores, those that do not always stay only from ``THRESHOLD`` on."""

    def score(s: Column) -> Column:
        before = F.lower(_part(chunks, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)), s["start"]))
        out = F.lit(0.0)
        for order, kind in enumerate(KINDS):
            bonus = F.when(before.rlike(kind.context), CONTEXT_BONUS).otherwise(0.0)
            out = F.when(s["ord"] == order, F.round(F.least(F.lit(kind.score) + bonus, F.lit(1.0)), 2)).otherwise(out)
        return F.struct(*[s[c].alias(c) for c in ("start", "ord", "end", "kind")], out.alias("score"))

    always = [order for order, kind in enumerate(KINDS) if kind.always]
    return F.filter(F.transform(spans, score), lambda s: s["ord"].isin(always) | (s["score"] >= THRESHOLD))


def with_spans(df: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """Adds ``name``: array<struct<start, ord, end, kind, score>> in order of start, then kind.

    A null or empty text has none. Texts are scanned whole, in time in proportion to their length and, but for a logarithm, to
    their spans. Repeated rows are scanned each for itself. All other columns stay as they are; a column that has the name
    already is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    columns = [F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()]
    at, more = free_name(df, "__found"), free_name(df, "__places")
    found = _computed(df, at, **{k.name: _pairs(whole, k) for k in KINDS})
    pairs = {k.name: F.col(at)[k.name] for k in KINDS}
    any_hit = F.greatest(*[F.size(p) for p in pairs.values()]) > 1
    chunks = F.when(any_hit, _chunks(whole)).otherwise(F.array().cast("array<string>"))
    found = _computed(found, more, chunks=chunks, **{k: _ends(p) for k, p in pairs.items()})
    spans = F.concat(*[_spans(pairs[k.name], F.col(more)[k.name], k, order) for order, k in enumerate(KINDS)])
    return found.select(*columns, F.array_sort(_scored(F.col(more)["chunks"], spans)).alias(name))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces each span by its kind in angle brackets, keeping all columns; overlapping spans become one, of the first's kind.

    A null text stays null, a text without spans as it is. Repeated rows are redacted each for itself.
    """
    columns, name, more = df.columns, free_name(df, "__pii"), free_name(df, "__places")
    spans = F.col(name)
    reached = _running(F.transform(spans, lambda s: s["end"]), F.greatest)  # the furthest end of each span and those before it
    chunks = F.when(F.size(spans) > 0, _chunks(F.col(text))).otherwise(F.array().cast("array<string>"))
    found = _computed(with_spans(df, text, name), more, chunks=chunks, reached=reached)
    chunks, reached = F.col(more)["chunks"], F.col(more)["reached"]

    def piece(s: Column, i: Column) -> Column:
        at = F.coalesce(F.get(reached, i - 1), F.lit(0))
        return F.when(s["start"] >= at, F.concat(_part(chunks, at, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")

    tail = _part(chunks, F.element_at(reached, -1), F.length(text))
    rebuilt = F.concat(F.array_join(F.transform(spans, piece), ""), tail)
    changed = F.when(F.size(spans) > 0, rebuilt).otherwise(F.col(text))
    return found.select(*[changed.alias(c) if c == text else F.col(f"`{c}`") for c in columns])


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find_pii(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans of every document.

    One row for each row, repeated ones included; a null or empty text has no span. Columns besides key and text are not carried.
    """
    found = with_spans(docs.select(key, text), text, "spans_scored")
    base = F.filter("spans_scored", lambda s: s["ord"] < len(BASE_KINDS))
    kinds = F.transform("spans_scored", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in BASE_KINDS]
    counts = [(F.size("spans_scored") - n).cast("long").alias(f"n_{k}") for n, k in zip(counts, BASE_KINDS, strict=True)]
    return found.select(
        key, *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans_scored")).alias("spans"), "spans_scored"
    )
