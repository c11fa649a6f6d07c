"""Operators that compare documents or count over all of them, and the pipeline."""

from __future__ import annotations

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.conftest import WORD
from tidemark.llm import jaccard, lm


def brute_join(data):
    sets = {}
    for i, (_, text) in enumerate(data):
        w = WORD.findall((text or "").lower())
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    near = defaultdict(set)
    for a in sets:
        for b in sets:
            if a != b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                near[a].add(b)
    out = []
    for a in sets:
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        keys = [data[x][0] for x in seen if data[x][0] is not None]
        out.append((data[a][0], min(keys) if len(seen) > 1 and keys else data[a][0], len(near[a])))
    return sorted(out, key=str)


def corpus(seed=1):
    """Groups of near copies of all degrees, exact copies, a passage that many share, short texts."""
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    data, shared = [], " ".join(pick.choices(words, k=30))
    for group in range(12):
        base = pick.choices(words, k=120)
        for copy in range(pick.choice((1, 2, 5, 9))):
            text = list(base)
            for _ in range(pick.choice((0, 0, 1, 2, 4))):
                text[pick.randrange(120)] = f"edit{group}_{copy}"
            data.append((len(data), " ".join(text)))
    for _ in range(15):
        data.append((len(data), shared + " " + " ".join(pick.choices(words, k=90))))
    data += [(len(data) + i, t) for i, t in enumerate(["one two", "One, two!", "one", "", None, "...", "a b c d e", "a b c d e f"])]
    return data


def test_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 4)
    monkeypatch.setattr(jaccard, "CHUNK", 3)  # several chunks a group
    data = corpus()
    found = jaccard.join(spark.createDataFrame(data, "doc_id bigint, text string"))
    assert sorted(map(tuple, found.collect()), key=str) == brute_join(data)


def test_recall_of_pairs_near_the_threshold(spark):
    """At least 0.99 of 1200 pairs between 0.8 and 0.9, and nothing else."""
    pick = random.Random(12)
    data, linked = [], set()
    for pair in range(1200):
        base = [f"p{pair}w{k}" if k % 2 else f"w{pick.randrange(2000)}" for k in range(200)]
        other = list(base)
        for k in pick.sample(range(10, 190, 12), pick.choice((3, 4))):
            other[k] = "edited"
        sets = [{tuple(t[k : k + 5]) for k in range(196)} for t in (base, other)]
        assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.9
        linked |= {2 * pair, 2 * pair + 1}
        data += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join(other))]
    data += [(5000 + i, " ".join(f"w{pick.randrange(2000)}" for _ in range(200))) for i in range(300)]
    found = jaccard.join(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    have = {r["doc_id"] for r in found if r["links"]}
    assert have <= linked and len(have) >= 0.99 * len(linked)
    assert all(r["links"] <= 1 and r["class_id"] == r["doc_id"] // 2 * 2 for r in found if r["doc_id"] in have)


def test_join_of_odd_rows(docs, empty):
    found = [tuple(r) for r in jaccard.join(docs).collect()]
    assert len(found) == docs.count()
    assert sorted(r for r in found if r[0] in (1, 2)) == [(1, 1, 2), (1, 1, 2), (2, 1, 2)]
    assert {r for r in found if r[0] in (4, 5, 6, 3)} == {(i, i, 0) for i in (3, 4, 5, 6)}
    assert jaccard.join(empty).collect() == []


def test_one_of_each_group_stays(spark, docs, empty):
    data = corpus(2)
    frame = spark.createDataFrame(data, "doc_id bigint, text string")
    kept = sorted(r["doc_id"] for r in jaccard.keep_first(frame).collect())
    assert kept == sorted({c for _, c, _ in brute_join(data)})
    odd = jaccard.keep_first(docs)
    assert odd.columns == docs.columns and [r["doc_id"] for r in odd.collect()].count(1) == 1
    assert {r["doc_id"] for r in odd.collect()} >= {1, 3, 4, 5, 6, 7, 8, 9} and 2 not in {r["doc_id"] for r in odd.collect()}
    assert jaccard.keep_first(empty).collect() == []


def test_runs_reach_the_recall():
    assert 1 - (1 - 0.8**jaccard.DEPTH) ** jaccard.runs_for() >= jaccard.RECALL


def brute_scores(data, order):
    texts = [WORD.findall((t or "").lower()) for _, t in data]
    everywhere = [Counter(g for t in texts for g in grams(t, n)) for n in range(order + 1)]
    out = []
    for (key, _), t in zip(data, texts, strict=True):
        others = [c - Counter(grams(t, n)) for n, c in enumerate(everywhere)]
        total = 0.0
        for i in range(len(t)):
            most = min(order, i + 1)
            n = next((n for n in range(most, 0, -1) if others[n][tuple(t[i + 1 - n : i + 1])]), 0)
            gram = tuple(t[i + 1 - n : i + 1])
            total += (most - n) * math.log(lm.ALPHA) + (math.log(others[n][gram] / others[n - 1][gram[:-1]]) if n else -math.log(max(others[0][()], 1)))
        out.append((str(key), len(t), total))
    return sorted(out)


def grams(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if n else [()] * len(words)


@pytest.mark.parametrize(("order", "block", "bucket"), [(3, 10**6, 10**6), (3, 300, 500), (3, 1, 4000), (2, 300, 100), (1, 300, 500), (4, 300, 500)])
def test_scores_equal_brute_force_however_rows_are_dealt(spark, monkeypatch, order, block, bucket):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm, "BUCKET_BYTES", bucket)
    pick = random.Random(4)
    data = [(i, " ".join(pick.choices([f"w{k}" for k in range(40)], [1 / (k + 1) for k in range(40)], k=pick.randrange(60)))) for i in range(60)]
    data += [(0, data[1][1]), (0, data[1][1]), (None, "w1 w2 w1 w2"), (70, None), (71, ""), (72, "!!!"), (73, "solo")]
    found = lm.score(spark.createDataFrame(data, "doc_id bigint, text string"), order=order).collect()
    own = sorted((str(r["doc_id"]), r["n_words"], r["score"]) for r in found)
    expected = brute_scores(data, order)
    assert [r[:2] for r in own] == [r[:2] for r in expected]
    assert [r[2] for r in own] == pytest.approx([r[2] for r in expected], abs=1e-5)
    assert all((r["mean_score"] is None) == (r["n_words"] == 0) for r in found)


def test_a_single_document_has_no_others(spark):
    found = lm.score(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")).first()
    assert found["score"] == pytest.approx(3 * math.log(lm.ALPHA), abs=1e-5)


def test_scores_of_odd_rows(docs, empty):
    assert lm.score(docs).count() == docs.count()
    assert lm.score(empty).collect() == []


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_decisions(spark):
    """Each stage on what the one before kept, against plain versions of the decisions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = docs
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
        after = {r["doc_id"]: r["text"] for r in kept.collect()}
        gone = before.keys() - after.keys()
        if name == "language_id":
            assert all(WORD.search(before[i]) is None or not any(c.isalpha() for c in before[i]) for i in gone)
        elif name == "ngram_jaccard":
            assert after.keys() == {c for _, c, _ in brute_join(sorted(before.items()))}
        elif name == "decontamination":
            plain = {i: " ".join(WORD.findall(t.lower())) for i, t in before.items()}
            leaks = {i for i, t in plain.items() if any(" ".join(WORD.findall(b.lower())) in t for b in bench)}
            assert gone >= leaks and len(gone) <= len(leaks) + 1
        else:
            assert not gone
            if name == "pii":
                assert not any("@mail" in t for t in after.values())
        if name != "sentencepiece":
            assert kept.columns == docs.columns
        before = after
    assert all(r["round_trip"] for r in kept.collect())
    assert kept.count() == corpus_pipeline.run(spark, SF).count()


def test_components_of_chains_stars_and_cycles(spark):
    pick = random.Random(9)
    chain = [(i, i + 1) for i in range(12)]
    star = [(100, i) for i in range(101, 130)]
    loose = [(pick.randrange(200, 300), pick.randrange(200, 300)) for _ in range(60)]
    edges = [(f"{a:04d}".encode(), f"{b:04d}".encode()) for a, b in chain + star + loose + [(7, 7), (500, 500)]]
    least = {n: n for e in edges for n in e}
    for _ in range(60):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    found = {(bytes(r["node"]), bytes(r["label"])) for r in jaccard.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert found == {(n, m) for n, m in least.items() if any(a != b and n in (a, b) for a, b in edges)}
    assert jaccard.components(spark.createDataFrame([], "a binary, b binary")).collect() == []


@pytest.mark.parametrize("bits", (6, 64))
def test_scores_are_finite_even_where_hashes_collide(spark, monkeypatch, bits):
    monkeypatch.setattr(lm, "HASH_BITS", bits)
    pick = random.Random(8)
    data = [(i, " ".join(pick.choices([f"w{j}" for j in range(300)], k=40))) for i in range(60)]
    found = lm.score(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert all(math.isfinite(r["score"]) and (bits < 64 or r["score"] < 0) for r in found)


def test_stages_take_odd_rows_and_empty_tables(spark, docs, empty, tmp_path):
    items = [(1, "a passage that nobody here has in any of their texts at all today"), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path))
        assert set(corpus_pipeline.COLUMNS) <= set(found.columns), name
        kept = found.collect()
        assert 0 < len(kept) <= n, name
        if name == "language_id":
            assert all(r["text"] and any(c.isalpha() for c in r["text"]) for r in kept)
        elif name == "ngram_jaccard":
            assert sum(r["doc_id"] in (1, 2) for r in kept) == 1 and sum(r["text"] is None for r in kept) == 2
        elif name in ("decontamination", "pii", "sentencepiece"):
            assert len(kept) == n, name
        assert stage(spark, empty, str(tmp_path)).collect() == [], name


def test_lm_moves_hashes_and_counts_in_few_bits():
    rng = np.random.default_rng(7)
    hashes = np.sort(rng.integers(0, 1 << 63, 1 << 17, np.uint64) * np.uint64(2))
    steps, counts = np.diff(hashes, prepend=np.uint64(0)), rng.geometric(0.9, len(hashes)).astype(np.int32)
    # The least for steps of 2**47 on average is 48.4 bits, a Huffman code of these counts takes a bit.
    assert len(lm._packed(steps)) * 8 < 51 * len(steps)
    assert len(lm._packed(counts)) * 8 < 1.2 * len(counts)
    assert (lm._unpacked(lm._packed(steps), np.uint64) == steps).all()


def test_lm_texts_come_through_as_they_were():
    texts = ["", None, "a b c", "żółć 你好 \0 \n", "x" * 100_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts), pa.array([0] * 5)], ["__key", "__text", "__block"])
    moved = next(lm._texts_zipped(iter([batch]))).column(1)
    assert lm._texts(pa.chunked_array([moved])) == texts
    assert moved.nbytes < 1000
