"""BPE encoding and decoding with a tokenization automaton.

The automaton accepts exactly the token sequences that BPE produces.  It starts with one
state in which every base symbol is an arc, and each merge (a, b), in order, adds its
gadget: wherever a is followed by b, an arc for the merged token is added, and the state
behind a loses its b arc.  All arcs of a token lead to one state, and the state behind a
merged token starts as a copy of the state behind its right part.

So a gadget takes its arc from all states that are copies of a's by then still or became so
later, and from all tokens that begin with b likewise: if the tokens stand in the order of
the tree of right parts, and of the tree of left parts, with children by falling age,
these are two intervals.  Compiling the gadgets gives each state a row of a few disjoint
intervals of tokens for which it has no arc: the table of transitions.

A word is encoded from left to right.  A second table, the trie of all tokens with links
to the longest ending that is in the trie too, gives the tokens that end at each place,
longest first; the first one for which the state before it has an arc is taken.  Words
are those of the file's own splitting pattern; results equal those of the tokenizers library.  Decoding emits the arcs' labels.

Defined results: null counts as empty and gives no ids and an empty text; texts are
encoded whole whatever their length; special tokens written in a text are their ids, as
the library does; equal texts, and rows that repeat, give equal rows; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from concordia.llm._common import hold, map_arrow, table, texts_of
from concordia.llm.packing import byte_symbols

#: Words that a worker remembers, and their greatest length.
CACHED_WORDS, CACHED_CHARS = 200_000, 40
#: Steps along links to shorter endings that a worker remembers.
MORE_STEPS = 300_000


def _tree(parent: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Place of each token in the order of a tree (a token, then its children, youngest first), tokens at and below it, children."""
    children: list[list[int]] = [[] for _ in parent]
    size = np.ones(len(parent), dtype=np.int64)
    young = np.argsort(-made, kind="stable").tolist()
    for t in young:
        if parent[t] >= 0:
            children[parent[t]].append(t)
            size[parent[t]] += size[t]
    place, at = np.zeros(len(parent), dtype=np.int64), 0
    for t in reversed(young):
        if parent[t] < 0:
            place[t], at = at, at + size[t]
        below = place[t] + 1
        for child in children[t]:
            place[child], below = below, below + size[child]
    return place, size, children


def compile_gadgets(merges: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The table of transitions from merges (rows of left, right, token, in order).

    Returns for each token its place among those that follow, where the row of its state
    begins, and whether BPE ever makes it; and of all rows the intervals (from, to) of
    places that have no arc.  A row ends where the next token's in order of ``row`` begins.
    """
    made, left, right = np.full(tokens, -1), np.full(tokens, -1), np.full(tokens, -1)
    made[merges[:, 2]], left[merges[:, 2]], right[merges[:, 2]] = np.arange(len(merges)), merges[:, 0], merges[:, 1]
    row, row_size, row_children = _tree(right, made)
    place, place_size, place_children = _tree(left, made)
    rows_to = [row[a] + 1 + sum(row_size[c] for c in row_children[a] if made[c] > time) for time, a in enumerate(merges[:, 0].tolist())]
    # the merge itself comes first where its token is on the right: a a a is (a a) a
    to = np.array([place[b] + 1 + sum(place_size[c] for c in place_children[b] if made[c] >= time) for time, b in enumerate(merges[:, 1].tolist())], dtype=np.int64)
    first, many = row[merges[:, 0]], np.array(rows_to, dtype=np.int64) - row[merges[:, 0]]
    gadget = np.repeat(np.arange(len(merges)), many)
    of_row = np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(gadget))
    start = place[merges[:, 1]][gadget]
    order = np.lexsort((start, of_row))
    gadget, of_row, start = gadget[order], of_row[order], start[order]
    row_at = np.searchsorted(of_row, np.arange(tokens + 1))
    # a merge whose pair an earlier gadget keeps apart makes no token, nor do merges of such tokens
    own = np.repeat(np.arange(len(merges)), row_at[first + 1] - row_at[first])
    at = np.repeat(row_at[first] - np.cumsum(row_at[first + 1] - row_at[first]) + (row_at[first + 1] - row_at[first]), row_at[first + 1] - row_at[first]) + np.arange(len(own))
    wanted = place[merges[:, 1]][own]
    barred = np.zeros(len(merges), dtype=bool)
    barred[own[(gadget[at] < own) & (start[at] <= wanted) & (wanted < to[gadget[at]])]] = True
    live = np.ones(tokens, dtype=bool)
    for (a, b, token), none in zip(merges.tolist(), barred.tolist(), strict=True):
        live[token] = live[a] and live[b] and not none
    # overlapping intervals of a row become one
    key = of_row * (tokens + 1)
    furthest = np.maximum.accumulate(key + to[gadget])
    new = np.append(True, (key + start)[1:] > furthest[:-1]) if len(key) else np.zeros(0, dtype=bool)
    last = np.append(np.flatnonzero(new)[1:], len(key)) - 1
    begins, ends, rows = start[new], (furthest - key)[last] if len(key) else key, of_row[new]
    return place, np.searchsorted(rows, row), np.searchsorted(rows, row + 1), live, np.stack([begins, ends])


class Automaton:
    """The compiled tables, and the words encoded so far."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self._check(spec)
        self.labels = {i: label for label, i in vocab.items()}
        made = dict.fromkeys(self.labels, -1)
        rows = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], dtype=np.int64).reshape(-1, 3)
        for time, (a, b, token) in enumerate(rows.tolist()):
            if made[token] >= 0 or token in (a, b):
                raise ValueError("each merge has to make a new token of earlier ones")
            made[token] = time
        place, begin, end, live, cuts = compile_gadgets(rows, max(vocab.values()) + 1)
        self.place, self.begin, self.end = place.tolist(), begin.tolist(), end.tolist()
        self.cut_from, self.cut_to = array("i", cuts[0].tolist()), array("i", cuts[1].tolist())
        self._trie([(self._symbols(label), i) for label, i in vocab.items() if live[i]])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.labels |= {i: t for t, i in self.special.items()}
        self.cutter = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        symbols = {b: s for s, b in byte_symbols().items()}
        self.of_byte = [self.codes[symbols[b]] for b in range(256)]
        self.ends = {self.codes[s]: self.codes[s + self.suffix] for s in symbols.values()} if self.suffix else {}
        self.library = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}

    def _symbols(self, label: str) -> list[str]:
        """The symbols of a token: an end-of-word suffix belongs to the last one."""
        if self.suffix and label.endswith(self.suffix) and len(label) > len(self.suffix):
            label = label[: -len(self.suffix)]
            return [*label[:-1], label[-1] + self.suffix]
        return list(label)

    def _trie(self, tokens: list[tuple[list[str], int]]) -> None:
        """Steps by node and symbol; of each node the node of its longest other ending, and the longest token that it ends with."""
        self.codes = {s: k for k, s in enumerate(sorted({s for symbols, _ in tokens for s in symbols}))}
        self.width = len(self.codes)
        self.steps: dict[int, int] = {}
        self.token, self.long = [-1], [0]
        parents: list[tuple[int, int]] = [(0, 0)]
        for symbols, i in tokens:
            node = 0
            for code in map(self.codes.__getitem__, symbols):
                if (to := self.steps.get(node * self.width + code)) is None:
                    to = self.steps[node * self.width + code] = len(self.token)
                    self.token.append(-1)
                    self.long.append(self.long[node] + 1)
                    parents.append((node, code))
                node = to
            self.token[node] = i
        self.ending, self.shorter = [0] * len(parents), [0] * len(parents)
        self.most = len(self.steps) + MORE_STEPS
        self.node_place, self.node_begin, self.node_end = ([x[t] if t >= 0 else -1 for t in self.token] for x in (self.place, self.begin, self.end))
        for node in sorted(range(1, len(parents)), key=self.long.__getitem__):
            above, code = parents[node]
            if above:
                at = self.ending[above]
                while (to := self.steps.get(at * self.width + code)) is None and at:
                    at = self.ending[at]
                self.ending[node] = to or 0
            known = self.ending[node]
            self.shorter[node] = known if self.token[known] >= 0 else self.shorter[known]

    def step(self, node: int, code: int) -> int:
        """The node of the longest ending, one symbol further; remembered as a step of its own, in bounded number."""
        steps, width, at = self.steps, self.width, node
        while (to := steps.get(at * width + code)) is None and at:
            at = self.ending[at]
        if at != node:
            if len(steps) > self.most:
                self.steps = steps = {k: v for k, v in steps.items() if self.long[v] == self.long[k // width] + 1}
            steps[node * width + code] = to or 0
        return to or 0

    def arc(self, u: int, t: int) -> bool:
        """Whether the state behind token u has an arc t."""
        at = bisect_right(self.cut_from, self.place[t], self.begin[u], self.end[u])
        return at == self.begin[u] or self.cut_to[at - 1] <= self.place[t]

    def _check(self, spec: dict) -> None:
        """The kinds of files that this reads: lower-casing, splitting by a pattern, byte symbols."""
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = [p["type"] for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"] or pre != ["Split", "ByteLevel"] or spec.get("decoder") or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError("not a file of the kind that this encoder reads")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # the library's white space is the Unicode property; this module's \s has more
        self.splitter = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        # letters that only this module's newer Unicode knows: texts with them are split by the library itself
        unassigned = "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn")
        self.newer = frozenset(regex.findall(r"[\p{L}\p{N}]", unassigned))

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given as byte symbols."""
        codes = [self.codes[s] for s in word]
        if self.suffix:
            codes[-1] = self.codes[word[-1] + self.suffix]
        return self._path(codes)

    def _path(self, codes: list[int]) -> list[int]:
        """Ids of a word, given as codes of its symbols."""
        steps, width, shorter, long = self.steps, self.width, self.shorter, self.long
        place, begin, end, cut_from, cut_to = self.node_place, self.node_begin, self.node_end, self.cut_from, self.cut_to
        node, stop, last = 0, 0, [0]
        for code in codes:
            stop += 1
            if (to := steps.get(node * width + code)) is None:
                to = self.step(node, code)
                steps = self.steps
            node = to
            found = node if place[node] >= 0 else shorter[node]
            while (start := stop - long[found]) > 0:
                u, at = last[start], place[found]
                row = begin[u]
                # as arc() says
                if (cut := bisect_right(cut_from, at, row, end[u])) == row or cut_to[cut - 1] <= at:
                    break
                found = shorter[found]
            last.append(found)
        out, token = [], self.token
        while stop:
            found = last[stop]
            out.append(token[found])
            stop -= long[found]
        return out[::-1]

    def _ids(self, symbols: str) -> bytes:
        return array("I", self.encode_word(symbols)).tobytes()

    def _word(self, word: str) -> bytes:
        if (known := self.words.get(word)) is not None:
            return known
        codes = list(map(self.of_byte.__getitem__, word.encode("utf-8", "surrogatepass")))
        if self.suffix:
            codes[-1] = self.ends[codes[-1]]
        ids = array("I", self._path(codes)).tobytes()
        if len(word) <= CACHED_CHARS:
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def _has_newer(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return not self.newer.isdisjoint(text)
        return False

    def _plain(self, text: str) -> bytes:
        if self._has_newer(text):
            text = self.library.normalizer.normalize_str(text)
            return b"".join(self._ids(symbols) for symbols, _ in self.library.pre_tokenizer.pre_tokenize_str(text))
        text = unicodedata.normalize("NFC", text)
        # lower-casing goes letter by letter: no final form of sigma
        text = text.replace("Σ", "σ").lower()
        words, get = self.splitter.findall(text), self.words.get
        return b"".join([get(w) or self._word(w) for w in words])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.cutter or "<" not in text and not any(s in text for s in self.special):
            return self._plain(text)
        out, at = [], 0
        for found in self.cutter.finditer(text):
            out += [self._plain(text[at : found.start()]), np.array([self.special[found[0]]], "<u4").tobytes()]
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The labels of the ids, joined as the library does for files without a decoder."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ids (binary, little-endian unsigned 32-bit) and decoded; columns with these names are replaced."""
    base = docs.drop("ids", "decoded")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields), "ids binary", "decoded string"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = hold(("words", path), lambda: Automaton(path))
        for batch in batches:
            ids = [machine.encode(t) for t in texts_of(batch, text_col)]
            columns = [*batch.columns, pa.array(ids, pa.binary()), pa.array(map(machine.decode, ids), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "ids", "decoded"])

    return map_arrow(base, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: ids and decoded text of every document, as digests."""
    import public_tokenizers

    rows = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
