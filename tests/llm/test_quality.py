import numpy as np
from llm.conftest import edge_rows, prose

from concordia.llm import quality as m


def test_margin_is_the_sum_over_pairs():
    machine = m.FactorisationMachine(width=40, rank=5, seed=1)
    machine.w = np.random.default_rng(2).normal(size=40)
    machine.bias = 0.3
    index, value = np.array([1, 5, 9, 30]), np.array([0.5, 1.0, -2.0, 0.25])
    slow = machine.bias + sum(machine.w[i] * x for i, x in zip(index, value, strict=True))
    for a in range(4):
        for b in range(a):
            slow += machine.v[index[a]] @ machine.v[index[b]] * value[a] * value[b]
    assert np.isclose(machine.margin(index, value), slow)


def test_pairs_are_learned():
    """A label that only the product of two features tells."""
    chance = np.random.default_rng(3)
    signs = chance.integers(0, 2, (1500, 2))
    rows = [(np.array([a, 2 + b]), np.ones(2)) for a, b in signs]
    labels = (signs[:, 0] ^ signs[:, 1]).astype(float)
    machine = m.FactorisationMachine(width=4, rank=4, seed=4).fit(rows, labels)
    right = [(machine.margin(*r) > 0) == bool(y) for r, y in zip(rows, labels, strict=True)]
    assert np.mean(right) > 0.95


def test_edges(spark, edges, none, clashing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (40, None, 0), (41, 7, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    machine = m.learn(edges, labels)
    rows = m.score(edges, machine).collect()
    assert len(rows) == len(edge_rows())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["text"] or "", r["score"]) == r["score"]
    assert m.score(none, machine).collect() == []
    unlearned = m.learn(edges, labels.limit(0))
    unlearned.v[:] = 0
    assert {r["score"] for r in m.score(edges, unlearned).collect()} == {0.5}
    assert dict(m.score(clashing, machine).dtypes)["score"] == "double"


def test_held_out(spark):
    folder = "/root/testdata/sf0.01"
    rows = m.query(spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("score", "quality").collect()
    good, bad = [r[0] for r in rows if r[1] == 1], [r[0] for r in rows if r[1] == 0]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.9


def test_repeated_ids_give_the_same_fit(spark):
    """Labelled ids that several texts share: the same rows are learned from whatever the partitions."""
    rows = [(i % 9, prose(i, 40), "en", "a", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i % 9, i % 2) for i in range(18)], "doc_id long, quality int")
    fits = [m.learn(docs.repartition(k), labels.repartition(5 - k), sample=25) for k in (1, 4)]
    assert fits[0].bias == fits[1].bias and (fits[0].w == fits[1].w).all() and (fits[0].v == fits[1].v).all()


def test_features_read_whole_texts():
    words = m._Words()
    a, b = prose(1, 5000), prose(1, 5000) + " zebra" * 50
    assert m.features(a, words)[0].tolist() != m.features(b, words)[0].tolist()
