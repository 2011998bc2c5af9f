import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from llm.conftest import edge_rows
from tokenizers import Tokenizer

from concordia.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def optimum(lengths, capacity):
    """Fewest bins by exhaustive search."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for free in {b for b in bins if b >= lengths[k]}:
            place(k + 1, sorted([*bins[: bins.index(free)], *bins[bins.index(free) + 1 :], free - lengths[k]]))
        place(k + 1, [*bins, capacity - lengths[k]])

    place(0, [])
    return best[0]


def uses(pattern_counts):
    out = Counter()
    for pattern, n in pattern_counts.items():
        for k in pattern:
            out[k] += n
    return out


def test_evolution_reaches_the_optimum():
    for seed in range(12):
        chance = random.Random(seed)
        lengths = [chance.randint(8, 60) for _ in range(10)]
        counts = dict(Counter(lengths))
        pool = packing.evolve(counts, 100, [], 60, 12, seed)
        assert uses(pool[0]) == Counter(lengths)
        assert all(sum(p) <= 100 for p in pool[0])
        assert packing.size_of(pool[0]) == optimum(lengths, 100)


def test_crossover_and_mutation_keep_every_piece():
    chance = random.Random(1)
    counts = {k: chance.randint(1, 400) for k in range(5, 1000, 7)}
    a = packing.best_fit(counts, 1000)
    b = packing.mutate(a, 1000, chance)
    for child in (b, packing.cross(a, b, counts, 1000, chance), packing.cross(b, a, counts, 1000, chance)):
        assert uses(child) == Counter(counts)
        assert all(sum(p) <= 1000 for p in child)
        assert packing.size_of(child) >= packing.lower_bound(counts, 1000)


def check(rows, docs):
    tokenizer = Tokenizer.from_file(PATH)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    expected = Counter()
    for doc_id, text, *_ in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        head = len(ids) % 2048 or 2048
        cuts = [0, *range(head, len(ids), 2048), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    return len(places), sum(r["length"] for r in rows)


def test_edges(edges, none, clashing):
    sequences, total = check(packing.pack_documents(edges, PATH).collect(), edge_rows())
    assert sequences == -(-total // 2048)
    assert packing.pack_documents(none, PATH).collect() == []
    check(packing.pack_documents(clashing, PATH).collect(), edge_rows()[:30])


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, None)], "doc_id long, text string")
    pieces = packing.tokenize(docs, PATH)
    whole = packing.sequences(pieces, packing.pack(pieces.drop("ids"))).collect()
    tokenizer = Tokenizer.from_file(PATH)
    ids = [*tokenizer.encode("one two three").ids, 0], [*tokenizer.encode("four").ids, 0], [0]
    assert len(whole) == 1
    assert sorted(np.frombuffer(whole[0]["ids"], "<u4").tolist()) == sorted(sum(ids, []))


def test_encoder_equals_the_library():
    tokenizer, encode = Tokenizer.from_file(PATH), packing.encoder(PATH)
    chance = random.Random(2)
    alphabet = "ab \n\t'é日  s1<|endoftext|>!"
    texts = ["".join(chance.choice(alphabet) for _ in range(chance.randint(0, 40))) for _ in range(500)]
    for text in [*texts, " " * 5000 + "x", "a" * 3000, "x<|endoftext|>y"]:
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def fewest(pieces, capacity):
    """The fewest bins, by trying every bin for every piece."""
    best = [len(pieces)]

    def put(at, bins):
        if len(bins) >= best[0]:
            return
        if at == len(pieces):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + pieces[at] <= capacity and bins[k] not in bins[:k]:
                put(at + 1, [*bins[:k], bins[k] + pieces[at], *bins[k + 1 :]])
        put(at + 1, [*bins, pieces[at]])

    put(0, [])
    return best[0]


def test_bound_and_search_against_all_packings():
    chance = random.Random(8)
    reached = 0
    for _ in range(40):
        pieces = sorted((chance.randint(8, 60) for _ in range(chance.randint(1, 9))), reverse=True)
        counts, exact = dict(Counter(pieces)), fewest(pieces, 100)
        assert packing.lower_bound(counts, 100) <= exact
        found = packing.evolve(counts, 100, [], packing.GENERATIONS, packing.POPULATION, 3)[0]
        assert packing.size_of(found) == exact
        reached += packing.lower_bound(counts, 100) == exact
    assert reached > 25
    assert packing.lower_bound({}, 100) == 0
    assert packing.lower_bound({60: 4, 40: 1, 41: 3}, 100) == 6


def test_search_beats_best_fit_on_a_hard_instance(spark):
    chance = random.Random(1)
    counts = dict(Counter(chance.randint(300, 1100) for _ in range(4000)))
    found = packing.islands(spark, counts, epochs=3)
    used = Counter()
    for pattern, n in found.items():
        assert sum(pattern) <= packing.CAPACITY
        for k in pattern:
            used[k] += n
    assert used == counts
    bound, plain = packing.lower_bound(counts, packing.CAPACITY), packing.size_of(packing.best_fit(counts, packing.CAPACITY))
    assert packing.size_of(found) <= bound * 1.005 < plain * 0.99
