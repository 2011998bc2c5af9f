import zlib
from collections import Counter

import duckdb
from llm.conftest import edge_rows

from concordia.llm import sharding


def check(rows, total):
    assert len(rows) == total
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values(), default=0) - (min(sizes.values()) if len(sizes) == sharding.SHARDS else 0) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))


def test_edges(spark, edges, none, clashing):
    rows = sharding.shard(edges).collect()
    check(rows, len(edge_rows()))
    expected = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in edge_rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    assert sharding.shard(none).collect() == []
    check(sharding.shard(clashing).collect(), 30)


def test_mixture_follows_the_whole(spark):
    docs = spark.range(0, 24_000).selectExpr("id as doc_id", "'x' as text", "case when id % 3 = 0 then 'hot' when id % 2 = 0 then 'b' else 'c' end as source")
    rows = sharding.shard(docs).groupBy("shard", "source").count().collect()
    assert all(abs(r["count"] - 1000 / 3) <= 2 for r in rows)


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    mine = sharding.query(spark, folder).toPandas()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        theirs = db.execute(sharding.ORACLE_SQL).df()[list(mine.columns)]
    assert mine.drop(columns="grown_shard").sort_values("doc_id").values.tolist() == theirs.drop(columns="grown_shard").sort_values("doc_id").values.tolist()
