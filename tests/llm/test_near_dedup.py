import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.conftest import edge_rows, prose

from concordia.llm import _common
from concordia.llm import near_dedup as m


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Component of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    ids = [min((r[0] for r, x in zip(rows, label, strict=True) if x == own and r[0] is not None), default=None) for own in label]
    return sorted((str(r[0]), len(s), str(i)) for r, s, i in zip(rows, sets, ids, strict=True))


def found(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def chain(seed, n, step):
    """Texts of which each is near to the next, but the ends aren't."""
    words = prose(seed, 200).split()
    chance = random.Random(seed)
    for _ in range(n):
        yield " ".join(words)
        for _ in range(step):
            words[chance.randrange(len(words))] = f"w{chance.random():.9f}"


def test_estimates_and_merging():
    chance = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        errors = []
        for _ in range(60):
            pool = chance.integers(0, 1 << 64, 2000, dtype=np.uint64)
            n = int(1000 * 2 * share / (1 + share))
            a, b = pool[:1000], np.concatenate([pool[:n], pool[1000 : 2000 - n]])
            ra, rb = m.registers(a), m.registers(b)
            assert (m.registers(np.union1d(a, b)) == np.maximum(ra, rb)).all()
            estimated = m.estimate(ra[None], rb[None], np.array([1000]), np.array([1000]))[0]
            errors.append(estimated - share)
            assert abs(estimated - m.ESTIMATE_FLOOR) < 0.01 or m.plausible_pairs(ra[None], rb[None], np.array([1000]), np.array([1000]))[0] == (estimated >= m.ESTIMATE_FLOOR)
        assert abs(np.mean(errors)) < 0.02
        assert np.std(errors) < 0.06


@pytest.mark.parametrize("shuffled", [False, True])
def test_groups_equal_brute_force(spark, edges, monkeypatch, shuffled):
    if shuffled:  # no table is broadcast for being small, and every node with two rows is hot
        monkeypatch.setattr(m, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(m, "PARTNERS", 2)
        monkeypatch.setattr(m, "HOT_DEGREE", 2)
    rows = [(r[0], r[1]) for r in edge_rows()]
    next_id = 1000
    for seed in range(6):
        for text in chain(seed + 70, 8, 3 + seed):
            rows.append((next_id, text))
            next_id += 1
    shared = prose(999, 60)
    rows += [(2000 + k, shared + " " + prose(3000 + k, 40)) for k in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(m.near_groups(df)) == brute(rows)


def links(texts):
    """All pairs of rows whose sets reach the threshold, through the rows of each shingle."""
    sets = [shingles(t) for t in texts]
    rows = defaultdict(list)
    for k, own in enumerate(sets):
        for x in own:
            rows[x].append(k)
    out = set()
    for k, own in enumerate(sets):
        common = Counter(j for x in own for j in rows[x] if j < k)
        out |= {(j, k) for j, n in common.items() if 100 * n >= 75 * (len(own) + len(sets[j]) - n)}
    return out


def test_no_link_of_a_table_is_missed(spark):
    """Recall over all pairs of the documents at hand, and no link more."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    component = {r["doc_id"]: r["component_id"] for r in m.query(spark, folder).collect()}
    found = links([r["text"] for r in docs])
    assert len(found) > 50
    label = list(range(len(docs)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in found:
        label[root(a)] = root(b)
    least = {}
    for k, r in enumerate(docs):
        least[root(k)] = min(least.get(root(k), r["doc_id"]), r["doc_id"])
    assert component == {r["doc_id"]: least[root(k)] for k, r in enumerate(docs)}


@pytest.mark.parametrize("few", [100_000, -1])
def test_blocks_of_a_hot_bucket(spark, monkeypatch, few):
    """The full search of mixed buckets, with more than one block of stragglers and of the top component."""
    monkeypatch.setattr(m, "BROADCAST_ROWS", few)
    monkeypatch.setattr(m, "BLOCK", 3)
    monkeypatch.setattr(m, "TEXT_BLOCK", 2)
    monkeypatch.setattr(m, "ESTIMATE_FLOOR", 0.3)
    rows = []
    for seed in range(3):
        rows += [(100 * seed + k, t) for k, t in enumerate(chain(5, 12, 7 + seed))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(m.near_groups(df)) == brute(rows)


def test_work_tables_go(edges, tmp_path, monkeypatch):
    monkeypatch.setattr(_common, "shared_dir", lambda spark: f"file://{tmp_path}")
    rows = m.near_groups(edges)
    assert sorted(p.name.split("-")[1] for p in tmp_path.iterdir()) == ["class", "sketches"]
    assert rows.count() == edges.count()


def test_empty_and_clashing(none, clashing):
    assert m.near_groups(none).collect() == []
    assert m.near_groups(clashing).count() == 30
