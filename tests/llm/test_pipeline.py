import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from llm.test_near_dedup import brute
from llm.test_secret_scan import base
from tokenizers import Tokenizer

import corpus_pipeline as p


def check_packing(rows, before):
    """Every document's ids are there once, in pieces that fill sequences without a gap."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["piece"]].append((r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    expected = defaultdict(list)
    for r in before:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[r["doc_id"], k].append((a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in expected.items()}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_keep_other_columns(spark, clashing):
    """Columns named like results are carried through the stages as they are."""
    docs = clashing
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, docs, "")
        assert after.columns == docs.columns and after.schema["spans"].dataType.elementType == docs.schema["spans"].dataType.elementType, name
        assert {tuple(r["kept"]) for r in after.select("kept").collect()} == {("kept",)}
        docs = after.cache()
    assert p.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_stages_one_by_one(spark, edges):
    names = edges.columns
    assert [n for n, _ in p.STAGES] == ["language_id", "exact_dedup", "near_dedup", "secret_scan", "packing"]
    docs = edges
    for name, stage in p.STAGES:
        before = docs.collect()
        after = stage(spark, docs, "")
        docs = after.cache()
        rows = docs.collect()
        if name == "language_id":
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in rows} == {40, 41, 42, 43}
            assert all(r["lang"] for r in rows)
        elif name == "exact_dedup":
            texts = {}
            for r in before:
                texts[r["text"]] = max(texts.get(r["text"], -1), -1 if r["doc_id"] is None else r["doc_id"])
            assert Counter((r["text"], -1 if r["doc_id"] is None else r["doc_id"]) for r in rows) == Counter(texts.items())
        elif name == "near_dedup":
            groups = brute([(r["doc_id"], r["text"]) for r in before])
            assert len(rows) == sum(own == least for own, _, least in groups)
        elif name == "secret_scan":
            assert len(rows) == len(before)
            was = {(r["doc_id"], r["lang"], r["source"]): r for r in before}
            for r in rows:
                text = was[r["doc_id"], r["lang"], r["source"]]["text"]
                assert ("[SECRET]" in r["text"]) == bool(base(text))
                assert not base(text) or r["n_chars"] == len(r["text"])
        else:
            check_packing(rows, before)
        if name != "packing":
            assert docs.columns == names


def test_run(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).collect() == []
