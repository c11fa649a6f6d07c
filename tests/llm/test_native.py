from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import time
import zlib

import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import pii, sharding, tables


def test_shards_follow_the_key_and_growth_moves_rows_only_to_the_new_shard(spark):
    table = spark.range(5000).selectExpr("id as doc_id", "cast(id as string) as text")
    found = sharding.shard_documents(table, 24).collect()
    assert len(found) == 5000 and {r["shard"] for r in found} == set(range(24))
    moved = [r for r in found if r["shard"] != r["grown_shard"]]
    assert {r["grown_shard"] for r in moved} == {24} and 100 < len(moved) < 320
    for shard in range(24):
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in found)))
    again = sharding.with_shard(table, F.col("doc_id"), sharding.topology(25), "s").collect()
    assert {(r["doc_id"], r["s"]) for r in again} == {(r["doc_id"], r["grown_shard"]) for r in found}


def drawn(key, tree):
    """The descent by plain code: XXH64 chained over the path, the child's place and the key, from seed 42."""

    def bits(*values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v, seed=seed)
        return seed >> 11

    def whole(node):
        return sum(map(whole, node.values())) if isinstance(node, dict) else node

    def small(i):
        return struct.pack("<i", i)

    path, node = [], tree
    for level in ("region", "rack", "shard"):
        children = list(node.items())
        draws = [(-math.log((bits(level, *path, small(i), struct.pack("<q", key)) + 0.5) * 2.0**-53) / whole(c), i) for i, (_, c) in enumerate(children)]
        place = min(draws)[1] if len(draws) > 1 else 0
        shard, node = children[place]
        path.append(small(place))
    return shard


def test_shards_equal_the_draw_by_plain_code(spark):
    uneven = {0: {0: {0: 1.0, 1: 2.5}, 1: {2: 0.5}}, 1: {0: {3: 1.0, 4: 1.0, 5: 4.0}}}
    for tree in (sharding.topology(24), sharding.topology(27), uneven):
        found = sharding.with_shard(spark.range(-100, 400), F.col("id"), tree, "shard").collect()
        assert all(r["shard"] == drawn(r["id"], tree) for r in found)


def test_a_heavier_shard_moves_rows_only_within_and_into_its_own_subtrees(spark):
    table = spark.range(4000)
    before, heavy = sharding.topology(24), sharding.topology(24)
    heavy[1][0][8] = 3.0
    a = sharding.with_shard(sharding.with_shard(table, F.col("id"), before, "a"), F.col("id"), heavy, "b").where("a <> b").collect()
    assert a and all(r["b"] // 8 == 1 for r in a)  # into the region that grew
    assert all(r["b"] // 4 == 2 for r in a if r["a"] // 8 == 1)  # within it, into the rack that grew
    assert all(r["b"] == 8 for r in a if r["a"] // 4 == 2)  # within that, into the shard itself


def test_many_equal_rows_are_placed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(tables, "PIECE", 7)
    frame = spark.range(100).selectExpr("if(id < 60, null, id) as doc_id", "if(id < 60, null, 'text') as text")
    found = sharding.shard_documents(frame).collect()
    for shard in {r["shard"] for r in found}:
        own = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert len(found) == 100 and len({r["shard"] for r in found if r["doc_id"] is None}) == 1


def test_sharding_of_odd_rows(docs, empty):
    found = sharding.shard_documents(docs).collect()
    assert len(found) == docs.count()
    assert {(r["size"], r["text_crc32"]) for r in found if r["doc_id"] == 4} == {(8, 0)}
    twice = [r for r in found if r["doc_id"] == 1]
    assert len({r["shard"] for r in twice}) == 1 and len({r["slot"] for r in twice}) == 2
    text = "naïve café 🙂 𝄞 中文 \x00 ▁ tail ".encode()
    assert {(r["size"], r["text_crc32"]) for r in found if r["doc_id"] == 9} == {(len(text) + 8, zlib.crc32(text))}
    assert sharding.shard_documents(empty).collect() == []


def luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """The base kinds by the plain patterns."""
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) < 256 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def check_pii(frame, texts):
    found = {r["doc_id"]: r for r in pii.find_pii(frame).collect() if r["doc_id"] is not None}
    for i, text in texts.items():
        spans = base_spans(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert found[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), (text, listed, found[i]["spans"])
        assert [found[i][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[3] == k for s in spans) for k in pii.BASE_KINDS]


def test_pii_of_odd_rows(docs, empty, texts):
    check_pii(docs, texts)
    ten = next(r for r in pii.find_pii(docs).collect() if r["doc_id"] == 10)
    assert [s.split(":")[0] for s in ten["spans"].split(",")] == ["email", "card", "ip", "phone", "iban"]
    assert pii.find_pii(empty).collect() == []


PIECE = st.sampled_from(["a@b.c", "_d@e.f", "x@", "@y.z.", "1.2.3.4", "999.1.1.1", ".5", "4111 1111 1111 1111", "-4111111111111111", "0" * 30, "+1 (415) 555-0100", "+12", " ", "é", "🙂", "7", "-", "."])


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECE, max_size=12).map("".join), min_size=25, max_size=40))
def test_pii_of_made_up_texts(spark, made):
    check_pii(spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string"), dict(enumerate(made)))


def test_long_runs_do_not_hang_or_overflow(spark):
    def made(n):
        return {0: "1" * n, 1: "a" * n, 2: "1 " * (n // 2), 3: "a@" + "b." * (n // 4), 4: "+1" + "(" * (n // 2)}

    check_pii(spark.createDataFrame(list(made(10_000).items()), "doc_id bigint, text string"), made(10_000))  # the plain patterns are quadratic
    assert pii.find_pii(spark.createDataFrame(list(made(200_000).items()), "doc_id bigint, text string")).count() == 5


def test_context_raises_a_score_and_checksums_decide(spark):
    def kinds(text):
        row = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
        return {s["kind"]: s["score"] for s in row["spans_scored"]}

    assert kinds("ssn 536-90-4399") == {"ssn": 0.7} and kinds("code 536-90-4399") == {}
    assert kinds("x 4111111111111111")["card"] < kinds("my card 4111111111111111")["card"]
    assert kinds("iban DE89370400440532013000")["iban"] == 1.0 and kinds("iban DE88370400440532013000") == {}


def test_redaction_keeps_all_else(docs):
    after = {r["doc_id"]: r for r in pii.redact(docs).collect() if r["doc_id"]}
    assert after[10]["text"] == "mail <EMAIL>, card <CARD>, <IP>, <PHONE>. iban <IBAN> ok"
    assert after[4]["text"] is None and after[9]["text"].startswith("naïve") and after[8]["__pii"] == "x"
    assert pii.redact(docs).columns == docs.columns


def timed(frame):
    began = time.perf_counter()
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def test_time_is_in_proportion_to_the_spans_of_a_text(spark):
    took = {}
    for n in (1000, 16_000, 64_000):
        text = " ".join(f"name{i}@mail.org" if i % 3 else f"ssn 536-90-{1000 + i % 8000}" for i in range(n))
        table = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        took[n] = timed(pii.find_pii(table)), timed(pii.redact(table))
    for few, many in zip(took[16_000], took[64_000], strict=True):
        assert many < 8 * few + 1, took  # four times the spans


def test_redaction_equals_a_plain_version(spark):
    pick = random.Random(5)
    parts = ["a@b.cd", "4111 1111 1111 1111", "+1 415 555 0100", "10.0.0.1", " ", "é🙂", "x" * 300, "word ", "DE89370400440532013000"]
    made = dict(enumerate("".join(pick.choices(parts, k=pick.randrange(40))) for _ in range(60)))
    frame = spark.createDataFrame(list(made.items()), "doc_id bigint, text string")
    spans = {r["doc_id"]: r["pii"] for r in pii.with_spans(frame).collect()}
    after = {r["doc_id"]: r["text"] for r in pii.redact(frame).collect()}
    for i, text in made.items():
        out, at = "", 0
        for s in spans[i]:
            if s["start"] >= at:
                out += text[at : s["start"]] + f"<{s['kind'].upper()}>"
            at = max(at, s["end"])
        assert after[i] == out + text[at:]
