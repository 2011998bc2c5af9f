from collections import Counter

import numpy as np
from llm.conftest import GERMAN, edge_rows, prose

from concordia.llm import langid


def brute_phrases(parser, lang, sample, text):
    """Greedy longest matches by substring search, block by block."""
    def normal(t):
        return "".join(chr(0x10000 + c) for c in parser.normal(t.lower())[0])

    pool = "".join(normal(t) for t in sample)
    codes, n = normal(text), 0
    for at in range(0, len(codes), langid.BLOCK):
        block, i = codes[at : at + langid.BLOCK], 0
        while i < len(block):
            j = i
            while j < len(block) and block[i : j + 1] in pool:
                j += 1
            i, n = max(j, i + 1), n + 1
    return n


def test_phrases_equal_substring_search():
    samples = {"en": [prose(1, 60), prose(2, 60)], "de": [prose(1, 90, GERMAN)]}
    parser = langid.CrossParser(samples)
    texts = [prose(9, 200), prose(9, 30, GERMAN), "Straße, ëxtra 日本 text", "x", "a  b"]
    for text, (_, _, counts) in zip(texts, parser.predict(texts), strict=True):
        assert counts == [brute_phrases(parser, k, samples[k], text) for k in sorted(samples)]


def test_thousands_of_letters():
    """No letter is merged with another, and languages that share none are told apart."""
    chance = np.random.default_rng(4)
    words = lambda low, n: "".join(chr(c) for c in chance.integers(low, low + 5000, n))
    samples = {"a": [words(0x4E00, 4000)], "b": [words(0x6400, 4000)], "en": [prose(1, 200)]}
    parser = langid.CrossParser(samples)
    assert parser.pad > 5000
    texts = [samples["a"][0][500:900], samples["b"][0][100:700] + " x", prose(5, 50), samples["a"][0][7:90] + samples["b"][0][70:90]]
    found = list(parser.predict(texts))
    assert [f[0] for f in found] == ["a", "b", "en", "a"]
    for text, (_, _, counts) in zip(texts, found, strict=True):
        assert counts == [brute_phrases(parser, k, samples[k], text) for k in sorted(samples)]


def test_hundreds_of_languages(spark):
    """Each of 250 languages is learned and found; a language of long texts alone gives its shortest one whole."""
    chance = np.random.default_rng(5)
    stems = {f"l{k:03d}": ["".join(chr(97 + c) for c in chance.integers(0, 26, 4)) for _ in range(12)] for k in range(250)}
    text = lambda k, n: " ".join(stems[k][i] for i in chance.integers(0, 12, n))
    rows = [(i, text(k, 40), k) for i, k in enumerate([*stems, *stems])]
    long = [(9001, "wörter " * 9000, "long"), (9000, "wörter " * 8000, "long")]
    samples = langid.learn(spark.createDataFrame(rows + long, "doc_id long, text string, lang string").repartition(5))
    assert set(samples) == {*stems, "long"}
    assert samples["long"] == [long[1][1]]
    parser = langid.CrossParser(samples)
    assert [f[0] for f in parser.predict([text(k, 15) for k in stems])] == list(stems)


def test_automaton_knows_all_substrings():
    automaton = langid.SuffixAutomaton()
    text = [1, 2, 1, 1, 2, 2, 1, 2, 1, 1]
    for c in text:
        automaton.extend(c)
    inside = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}

    def walk(state, path):
        for c, to in automaton.next[state].items():
            yield (*path, c)
            yield from walk(to, (*path, c))

    assert Counter(walk(0, ())) == Counter(inside)


def test_edges(spark, edges, none, clashing):
    samples = langid.learn(edges)
    assert set(samples) == {"de", "en"}
    assert all(len(t) <= langid.ROWS_PER_LANG and sum(map(len, t)) <= langid.CHARS_PER_LANG for t in samples.values())
    texts = {r[1] for r in edge_rows()}
    assert all(t in texts for v in samples.values() for t in v)
    found = langid.identify(edges, samples).collect()
    assert len(found) == len(edge_rows())
    for row in found:
        letters = any(c.isalpha() for c in row["text"] or "")
        assert (row["lang_pred"] == "und") == (not letters)
        assert 0 <= row["score"] <= 1
    right = [r["lang_pred"] == r["lang"] for r in found if r["doc_id"] is not None and (r["doc_id"] < 12 or 100 <= r["doc_id"])]
    assert np.mean(right) == 1
    assert langid.identify(none, samples).collect() == []
    assert langid.learn(none) == {}
    assert {r["lang_pred"] for r in langid.identify(edges, {}).collect()} == {"und"}
    assert dict(langid.identify(clashing, samples).dtypes)["lang_pred"] == "string"


def test_held_out_accuracy(spark):
    rows = langid.query(spark, "/root/testdata/sf0.01").filter("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    pairs = rows.join(truth, "doc_id").select("lang_pred", "lang").collect()
    assert len(pairs) > 100
    assert np.mean([a == b for a, b in pairs]) > 0.98
