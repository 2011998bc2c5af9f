import random

import numpy as np
import public_tokenizers
from llm.conftest import edge_rows
from tokenizers import Tokenizer

from concordia.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_texts_equal_the_library():
    tokenizer, machine = Tokenizer.from_file(PATH), bpe.Automaton(PATH)
    chance = random.Random(1)
    alphabet = "aaabbcdeehillnorstttuw'  ΣİßẞéÉ0123٣你好́가\x1c\x85\xa0\n\t!?.,<|>"
    texts = ["".join(chance.choice(alphabet) for _ in range(chance.randint(0, 40))) for _ in range(3000)]
    texts += [f"a{chr(c)}b" for c in range(0x80, 0x3000)] + [f"a{chr(c)}b" for c in range(0x10900, 0x11000)]
    texts += ["a" * k for k in range(1, 70)] + ["ha" * k for k in range(1, 50)] + ["", " ", "x<|startoftext|>y<|endoftext|>", "<|endoftext|>" * 3, "é" * 50]
    texts += ["".join(chance.choice("abcdefghinorstu") for _ in range(chance.randint(1, 25))) for _ in range(5000)]
    for text in texts:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(machine.encode(text), "<u4").tolist() == ids, text
        assert machine.decode(machine.encode(text)) == tokenizer.decode(ids, skip_special_tokens=False)


def merged(word, ranks):
    """BPE by its definition: the earliest merge first, from the left."""
    while len(word) > 1:
        rank, at = min((ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(word, word[1:], strict=False)))
        if rank == 1 << 60:
            break
        word = [*word[:at], word[at] + word[at + 1], *word[at + 2 :]]
    return word


def test_words_equal_successive_merges():
    import json

    machine = bpe.Automaton(PATH)
    model = json.load(open(PATH, encoding="utf-8"))["model"]
    ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
    chance = random.Random(4)
    for _ in range(800):
        word = "".join(chance.choice("abehilnorst") for _ in range(chance.randint(1, 14)))
        assert [machine.labels[i] for i in machine.encode_word(word)] == merged([*word[:-1], word[-1] + "</w>"], ranks)


def test_table_equals_pairs_of_tokens():
    """The compiled rows alone say which tokens may follow each other: those that BPE doesn't merge or cut otherwise."""
    machine = bpe.Automaton(PATH)
    model = Tokenizer.from_file(PATH).model
    vocab = {label: i for i, label in machine.labels.items()}
    plain = sorted(label for label in vocab if not label.endswith("</w>") and label not in machine.special)
    ends = sorted(label for label in vocab if label.endswith("</w>"))
    chance = random.Random(6)
    seen = [0, 0]
    for k in range(30_000):
        u, t = chance.choice(plain), chance.choice(ends)
        if k % 2:  # a token's own cuts, which mostly are none of BPE's
            whole = chance.choice(ends)[:-4]
            at = chance.randrange(len(whole) or 1)
            u, t = whole[:at], whole[at:] + "</w>"
            if u not in vocab or t not in vocab:
                continue
        fits = [x.id for x in model.tokenize(u + t[:-4])] == [vocab[u], vocab[t]]
        assert machine.arc(vocab[u], vocab[t]) == fits, (u, t)
        seen[fits] += 1
    assert min(seen) > 2000
    assert len(machine.cut_from) < 1_000_000


def test_small_tables_by_hand():
    """a a a is (a a) a, whose state has no arc for a; a token whose pair is cut before is never made."""
    a, b, aa, ab, aab = range(5)
    merges = np.array([(a, a, aa), (a, b, ab), (aa, b, aab)])
    place, begin, end, live, cuts = bpe.compile_gadgets(merges, 5)

    def arc(u, t):
        return not any(x <= place[t] < y for x, y in cuts[:, begin[u] : end[u]].T)

    assert live.tolist() == [True] * 5
    open_ = {(u, t) for u in range(5) for t in range(5) if arc(u, t)}
    assert (aa, a) in open_ and (a, aa) not in open_ and (a, a) not in open_ and (a, b) not in open_
    assert (aa, b) not in open_ and (aa, ab) in open_ and (ab, a) in open_ and (a, ab) not in open_ and (b, aab) in open_
    # (a, b) is merged before b can meet c behind an a: a (b c) has no way to be made
    live = bpe.compile_gadgets(np.array([(0, 1, 3), (1, 2, 4), (0, 4, 5)]), 6)[3]
    assert live.tolist() == [True, True, True, True, True, False]


def test_edges(edges, none, clashing):
    tokenizer = Tokenizer.from_file(PATH)
    rows = bpe.encode(edges, PATH).collect()
    assert len(rows) == len(edge_rows())
    for row in rows:
        ids = tokenizer.encode(row["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids
        assert row["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.encode(none, PATH).collect() == []
    assert dict(bpe.encode(clashing, PATH).dtypes)["ids"] == "binary"


def test_query(spark):
    rows = bpe.query(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert rows.count() == 200
