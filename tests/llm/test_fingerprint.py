import hashlib

import numpy as np
from llm.conftest import edge_rows, prose
from pyspark.sql import functions as F

from concordia.llm import fingerprint as fp


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_fingerprint_is_the_densified_minhash(spark):
    """Bins, minima and borrowing against a plain rebuild from the same shingle hashes."""
    texts = ["one two", prose(1, 30), prose(2, 700), prose(3, 120)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select("text", fp.fingerprint(F.col("text")).alias("f"), fp.shingle_hashes(F.col("text")).alias("h")).collect()
    pairs = spark.range(128).select(F.col("id").alias("b")).crossJoin(spark.range(128).select(F.col("id").alias("j")))
    order = {(r["b"], r["j"]): r["x"] for r in pairs.select("b", "j", F.xxhash64("b", "j").alias("x")).collect()}
    for row in rows:
        least = {}
        for h in row["h"]:
            b = (h % (1 << 64)) >> 57
            least[b] = min(h, least.get(b, h))
        codes = []
        for b in range(128):
            if b in least:
                codes.append(least[b] & 255)
            else:
                codes.append(min((order[b, j] & ~255) | (least[j] & 255) for j in least) & 255)
        assert row["f"] == bytes(codes).hex()


def test_likeness_estimates_jaccard(spark):
    rows = []
    for seed in range(120):
        a = prose(seed, 300)
        words = a.split()
        rows.append((a, " ".join(words[: seed * 2 + 10] + prose(seed + 1000, 290 - seed * 2).split())))
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b")))).collect()]
    true = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in rows]
    error = np.array(got) - np.array(true)
    assert abs(error.mean()) < 0.02
    assert error.std() < 0.06


def test_neighbours_and_edges(spark, edges, none, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 4)
    docs = edges.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = fp.with_next(docs, ["text"]).collect()
    rows = sorted(((r[0], r[1] or "") for r in edge_rows()), key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1]))
    expected = sorted((str(a[0]), a[1], b[1]) for a, b in zip(rows, rows[1:] + rows[:1], strict=True))
    assert sorted((str(r["doc_id"]), r["text"], r["next_text"]) for r in found) == expected
    assert fp.with_next(none.select("doc_id", "text"), ["text"]).collect() == []
    one = spark.createDataFrame([(5, "alone")], "doc_id long, text string")
    assert [r["next_text"] for r in fp.with_next(one, ["text"]).collect()] == ["alone"]
    empty = edges.select(F.coalesce("text", F.lit("")).alias("text"), fp.fingerprint(F.col("text")).alias("f")).collect()
    assert all((r["f"] == "") == (not r["text"].split()) for r in empty)
    assert len({r["text"] for r in empty}) >= len({r["f"] for r in empty})


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    rows = fp.query(spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        text, following = texts[r["doc_id"]], texts[after[r["doc_id"]]]
        cut = len(text) // 3
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()
        assert 0 <= r["near_next"] <= 1


def test_clashing_names_and_repeated_rows(spark, clashing):
    rows = clashing.withColumns({"next_text": F.lit(1), "next_fingerprint": F.lit(2)}).drop("fingerprint")
    rows = rows.union(rows).withColumn("fingerprint", fp.fingerprint(F.col("text")))
    found = fp.with_next(rows, ["text", "fingerprint"]).collect()
    assert len(found) == 60 and all(r["next_text"] is None or isinstance(r["next_text"], str) for r in found)
    by_text = {}
    for r in found:
        assert by_text.setdefault(r["text"], r["fingerprint"]) == r["fingerprint"]


def test_query_stays_in_the_engine(spark):
    plan = fp.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
