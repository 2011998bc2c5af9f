import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import edge_rows

from concordia.llm import exact_dedup as m


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 60) - 1), min_size=1, max_size=60), st.integers(0, 15))
def test_filters_round_trip(values, block):
    fingerprints, counts = np.unique(np.array([(block << 60) | v for v in values], np.uint64), return_counts=True)
    got, times = m.decode_filter(m.encode_filter(fingerprints, counts, 4), block)
    assert got.tolist() == fingerprints.tolist()
    assert times.tolist() == counts.tolist()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=30), min_size=1, max_size=5))
def test_merging_loses_nothing(parts):
    filters = []
    for part in parts:
        values, counts = np.unique(np.array([(3 << 60) | (v * 0x9E3779B97F4A7C1 & ((1 << 60) - 1)) for v in part], np.uint64), return_counts=True)
        filters.append(m.encode_filter(values, counts, 4))
    got, counts = m.merge_filters(filters, 3)
    expected = Counter((3 << 60) | (v * 0x9E3779B97F4A7C1 & ((1 << 60) - 1)) for part in parts for v in part)
    assert dict(zip(got.tolist(), counts.tolist(), strict=True)) == expected


def test_edges(edges, none, clashing):
    groups = {}
    for doc_id, text, *_ in edge_rows():
        groups.setdefault(text or "", []).append(doc_id)
    found = m.deduplicate(edges).collect()
    assert len(found) == len(edge_rows())
    for row in found:
        ids = groups[row["text"] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        assert (row["keep_id"], row["group_size"], row["kept"]) == (keep, len(ids), row["doc_id"] == keep)
        assert row["text_sha256"] == hashlib.sha256((row["text"] or "").encode()).hexdigest()
    assert m.deduplicate(none).collect() == []
    assert dict(m.deduplicate(clashing).dtypes)["kept"] == "boolean"


def test_without_broadcast(edges, monkeypatch):
    before = sorted(map(str, m.deduplicate(edges).collect()))
    monkeypatch.setattr(m, "BROADCAST_ROWS", 0)
    assert sorted(map(str, m.deduplicate(edges).collect())) == before
