"""Importance resampling, clustering and archives against plain code."""

from __future__ import annotations

import gzip
import hashlib
import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import cluster, resample, tables, warc


def plain_features(text, buckets):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(w), [zlib.crc32(x.encode()) % buckets for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def test_hashing_pairs_copies_no_table_for_each():
    text = " ".join(f"wort{i % 977} Ünd {'x' * (i % 90)}" for i in range(30_000))
    hasher = resample.Hasher(10_000)
    tracemalloc.start()
    bucket, place, n_words = hasher.features([text, None, "a b"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    words = re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())
    pairs = [b"%b %b" % p for p in zip(words, words[1:])]
    assert bucket.tolist() == [zlib.crc32(f) % 10_000 for f in (*words, b"a", b"b", *pairs, b"a b")]
    assert n_words.tolist() == [len(words), 0, 2] and len(place) == len(bucket)
    assert peak < 100_000_000  # a copy of four tables for each pair took 4 KB a pair


def plain_resample(docs, target, buckets=10_000):
    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            counts.update(plain_features(text, buckets)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1.0) * (all_s + buckets)) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    out, eligible = [], []
    for i, (key, text) in enumerate(docs):
        n_words, found = plain_features(text, buckets)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n_words >= 20:
            eligible.append(i)
    eligible.sort(key=lambda i: (-out[i][3], out[i][0] is not None, out[i][0] or 0))
    for rank, i in enumerate(eligible[: 25 * len(eligible) // 100], 1):
        out[i][4] = rank
    return sorted(map(tuple, out), key=str)


COLUMNS = ("doc_id", "n_features", "weight", "score", "rank")


def test_resampling_equals_plain_code(spark, texts, monkeypatch):
    monkeypatch.setattr(resample, "BATCH_BYTES", 300)  # several texts a batch, several batches
    pick = random.Random(3)
    letters = ["a", "Ab", "ZEBRA", "x9", "naïve", "中文字", "é" * 40, "w" * 90, "don't", "tail\x00end", "ſ", "İ"]
    docs = [(i, " ".join(pick.choices(letters, k=pick.choice((0, 1, 5, 19, 20, 21, 60))))) for i in range(150)]
    docs += [(1000 + i, t) for i, t in texts.items()] + [(None, "one two " * 15), (7, docs[7][1])]
    target = ["zebra x9 naïve", None, "", "中文字 a ab " * 5]
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, score string, __n string")
    found = resample.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=str) == plain_resample(docs, target)


def test_resampling_of_empty_tables(spark, docs, empty):
    assert resample.resample(empty, docs).collect() == []
    found = resample.resample(docs, empty).collect()
    assert len(found) == docs.count() and {r["weight"] for r in found if r["n_features"] == 0} == {0}


def test_many_equal_rows_rank_one_after_the_other(spark, monkeypatch):
    monkeypatch.setattr(tables, "PIECE", 50)
    frame = spark.range(400).select(F.lit(5).cast("long").alias("doc_id"), F.lit("some words " * 12).alias("text"))
    found = resample.resample(frame, frame)
    assert sorted(r["rank"] for r in found.collect() if r["rank"]) == list(range(1, 101)) and found.count() == 400


def plain_clusters(vectors, k=16, rounds=3, width=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in first[:k]]
    for step in range(rounds + 1):
        found = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            found.append((i, d.index(min(d)), min(d), v))
        if step < rounds:
            groups = defaultdict(list)
            for _, c, _, v in found:
                groups[c].append(v)
            for c, g in groups.items():
                centroids[c] = [sum(x) // len(g) for x in zip(*g)]
    own = Counter()
    for _, c, d, _ in found:
        own[c] += d
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, own[c], sum(own.values()), digests[c]) for i, c, d, _ in found), key=str)


@pytest.mark.parametrize("bits", (1, 4, 8))
def test_clusters_equal_plain_code(spark, bits):
    pick = random.Random(bits)
    middle = [[pick.gauss(0, 0.3) for _ in range(64)] for _ in range(5)]
    vectors = [(i, [x + pick.gauss(0, 0.05 + i % 3 / 20) for x in pick.choice(middle)]) for i in range(150)]
    vectors += [(i, middle[0]) for i in range(200, 240)]  # copies, so ties
    vectors += [(300, None), (301, []), (302, [0.5] * 63), (303, [None] + [0.1] * 63), (304, [float("nan")] + [0.1] * 63), (305, [float("inf")] + [0.1] * 63)]
    vectors += [(None, [0.25] * 64), (3, vectors[3][1]), (306, [900.0] * 64)]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in vectors], "vec_id long, embedding array<double>, row string, cluster string")
    found = [tuple(r) for r in cluster.cluster(frame, bits=bits).collect()]
    assert sorted(found, key=str) == plain_clusters(vectors)


def test_clusters_of_few_and_of_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert sorted(map(tuple, cluster.cluster(spark.createDataFrame(few, schema)).collect()), key=str) == plain_clusters(few)
    assert cluster.cluster(spark.createDataFrame([(1, None), (2, [1.0])], schema)).collect() == []
    huge = cluster.cluster(spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)], schema), rounds=1).collect()
    assert {r["vec_id"]: r["distance"] for r in huge} == {1: 0, 2: 0, 3: 0}


def test_settled_vectors_are_not_fetched(spark):
    """Of well parted groups, cells alone settle all vectors."""
    pick = random.Random(1)
    middle = [[pick.gauss(0, 1) for _ in range(64)] for _ in range(4)]
    frame = spark.createDataFrame([(i, [x + pick.gauss(0, 0.02) for x in middle[i % 4]]) for i in range(200)], "vec_id long, embedding array<double>")
    vectors = cluster.whole_vectors(frame, "embedding", "vec_id").withColumn("row", F.col("key"))
    cells = cluster.fit_cells(vectors)
    centroids = cluster.np.array([[math.floor(64 * x) for x in m] for m in middle])
    near = cluster.narrow(cluster.approximate(vectors, cells), cells, centroids).collect()
    assert all(r["near"] == r["row"] % 4 for r in near)


def plain_archive(pages):
    best = {}
    for key, _, html in pages:
        body = (html or "").encode()
        if len(body) >= 1000 and key is not None:
            best[body] = max(key, best.get(body, key))
    out = []
    for key, _, html in pages:
        body = (html or "").encode()
        again = body in best and best[body] != key
        out.append((key, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", best[body] if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages():
    pick = random.Random(4)
    common = "é<p>\r\n\r\nWARC/1.1\r\n" + "x" * 1200
    rows = [(i, f"http://a.b/{i}", "".join(pick.choices("ab<>\r\n é𝄞", k=pick.choice((0, 5, 999, 1000, 1001, 5000))))) for i in range(60)]
    rows += [(i, "u\r\nContent-Length: 5", common) for i in range(100, 130)] + [(i, None, "short") for i in range(130, 135)]
    return rows + [(200, "n", None), (201, "e", ""), (None, "k", common), (None, "k", "only one" * 200), (100, "again", common), (129, "again", common)]


def test_archives_give_pages_back(spark, tmp_path, pages, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT", 2000)
    frame = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, record_id string, last string")
    found = warc.archived(frame.repartition(3), str(tmp_path / "w"))
    assert sorted(map(tuple, found.collect()), key=str) == plain_archive(pages)
    assert warc.archived(frame.limit(0), str(tmp_path / "none")).collect() == []


def test_long_payloads_travel_in_chunks_with_running_digests(spark, tmp_path, monkeypatch):
    for name, size in (("CHUNK", 1000), ("BLOCK", 700), ("BATCH", 2500)):
        monkeypatch.setattr(warc, name, size)
    bodies = {1: "é" * 2500, 2: "a" * 3000, 3: "", 4: "b" * 1000}
    path = str(tmp_path / "w")
    frame = spark.createDataFrame([(k, f"http://x/{k}", b) for k, b in bodies.items()], "page_id long, url string, html string")
    # Workers have their own copies of the module, so the pieces of a task are run here.
    chunks = warc._chunked(warc.to_records(frame.coalesce(1))).toArrow().to_batches()
    assert max(len(x) for b in chunks for x in b.column("data").to_pylist()) == 1000
    segments = list(warc._writer(path, warc.DATE)(iter(chunks)))
    rows = [r for b in warc._reader(path)(iter(segments)) for r in b.to_pylist()]
    for key, text in bodies.items():
        body = text.encode()
        own = [r for r in rows if r["record_id"] == f"{warc.PREFIX}{key}"]
        assert [r["chunk_no"] for r in own] == list(range(max(1, -(-len(body) // 1000)))) and [r["last"] for r in own] == [False] * (len(own) - 1) + [True]
        assert b"".join(r["data"] for r in own) == body
        assert all(r["sha1"] == hashlib.sha1(body[: r["position"] + len(r["data"])]).hexdigest() for r in own)


def test_archives_are_plain_gzip_and_broken_ones_raise(spark, tmp_path, pages):
    path = str(tmp_path / "w")
    frame = spark.createDataFrame(pages[:40], "page_id long, url string, html string").coalesce(1)
    warc.write(warc.to_records(frame), path)
    (name,) = (n for n in os.listdir(f"{path}/archives") if n.endswith(".gz"))
    whole = gzip.open(f"{path}/archives/{name}").read()
    assert whole.count(b"WARC-Record-ID: ") == 40 and whole.startswith(b"WARC/1.1\r\n") and whole.endswith(b"\r\n\r\n")
    with open(f"{path}/archives/{name}", "wb") as out:
        out.write(gzip.compress(whole.replace(b"sha1:", b"sha1:0", 1)))
    with pytest.raises(Exception, match="segment|payload"):
        warc.records(warc.read(spark, path)).collect()


def test_archives_that_no_segment_names_are_not_read(spark, tmp_path, pages):
    path = str(tmp_path / "w")
    warc.write(warc.to_records(spark.createDataFrame(pages[:5], "page_id long, url string, html string")), path)
    with open(f"{path}/archives/left_by_a_lost_task.warc.gz", "wb") as out:
        out.write(b"half an arch")
    assert warc.records(warc.read(spark, path)).count() == 5
