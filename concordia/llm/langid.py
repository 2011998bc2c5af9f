"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds all substrings of a bounded sample of
labelled text.  A text is parsed greedily against each automaton: a phrase runs as
far as the automaton can follow it (the longest match), then the next phrase starts.
``phrases * log2(sample length)`` estimates the bits the text costs in that language;
the language with the fewest bits wins.

Letters are lower-cased, every run of other characters counts as one space, and a
phrase never crosses the border of a block of ``BLOCK`` characters, so that blocks
are parsed side by side with bounded memory.  Every letter of the samples has a code of
its own, however many there are.  The automata's arcs lie in one sparse table: the row of
a state is shifted to where its arcs meet free places, and each place names its row.

What is learned from is bounded by rows, and whole texts are taken: at most
``ROWS_PER_LANG`` of a language, chosen by a hash of their id among those of up to
``LONG_TEXT`` characters (longer ones, shortest first, only where these don't suffice),
as many as fit ``CHARS_PER_LANG`` characters, one at least.  With many languages each has
less, so that all samples together hold about ``CHARS_IN_ALL`` characters.

Defined results: null, empty or letterless text gives ``und`` with score 0; equal
texts, and rows that repeat, give equal results; ties go to the first language in alphabetical order;
without labelled rows every text is ``und``; texts of any length are read whole; an empty
table gives no rows; columns of the input named like a result are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordia.llm._common import crc_fold, hold, map_arrow, slices, table, texts_of

UNDETERMINED = "und"
#: Bounds of the labelled sample that is learned from.
ROWS_PER_LANG, CHARS_PER_LANG, CHARS_IN_ALL, LONG_TEXT = 64, 48_000, 8_000_000, 4_000
#: Languages whose cuts (24 bytes each) are broadcast at most; more are shuffled.
BROADCAST_LANGS = 10_000
BLOCK = 512
#: Share of the sparse table's places that arcs may take.
LOAD = 0.55
#: Bits are weighed down to this share in the score, for neighbouring phrases aren't independent.
TEMPER = 0.25


@lru_cache(maxsize=1)
def letter_flags() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=np.bool_, count=0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class SuffixAutomaton:
    """Online construction; state 0 is the root."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def extend(self, code: int) -> None:
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[self.last] + 1)
        self.link.append(0)
        at = self.last
        while at >= 0 and code not in self.next[at]:
            self.next[at][code] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][code]
            if self.length[to] == self.length[at] + 1:
                self.link[new] = to
            else:
                copy = len(self.next)
                self.next.append(dict(self.next[to]))
                self.length.append(self.length[at] + 1)
                self.link.append(self.link[to])
                while at >= 0 and self.next[at].get(code) == to:
                    self.next[at][code] = copy
                    at = self.link[at]
                self.link[to] = self.link[new] = copy
        self.last = new


class StepTable:
    """The arcs of one automaton: from the row of a state, ``target[row + code]`` if ``owner[row + code]`` is that row.

    A state without such an arc ends the phrase, and the next one starts with ``start[code]``.
    The root has no arcs here, so that each phrase's first letter is counted as a start.
    """

    def __init__(self, automaton: SuffixAutomaton, width: int) -> None:
        degree = np.fromiter(map(len, automaton.next), np.int64, len(automaton.next))
        degree[0] = 0
        first = np.cumsum(degree) - degree
        arcs = int(degree.sum())
        codes = np.fromiter((c for s in automaton.next[1:] for c in s), np.int64, arcs)
        targets = np.fromiter((t for s in automaton.next[1:] for t in s.values()), np.int64, arcs)
        size = max(64, int(arcs / LOAD))
        row = np.full(len(degree), -1, dtype=np.int64)
        used, taken = np.zeros(size + width, dtype=bool), np.zeros(size, dtype=bool)
        self.owner = np.full(size + 2 * width, -1, dtype=np.int32)
        chance = np.random.default_rng(len(degree))
        # states of most arcs first, while places are free; in each round those that meet no one settle
        for many in sorted(set(degree[degree > 0].tolist()), reverse=True):
            left = np.flatnonzero(degree == many)
            own = codes[first[left][:, None] + np.arange(many)]
            while len(left):
                try_ = chance.integers(0, size, len(left))
                place = try_[:, None] + own
                claim = np.full(size + width, -1, dtype=np.int64)
                claim[place] = np.arange(len(left))[:, None]
                row_claim = np.full(size, -1, dtype=np.int64)
                row_claim[try_] = np.arange(len(left))
                fine = ~used[place].any(axis=1) & ~taken[try_] & (claim[place] == np.arange(len(left))[:, None]).all(axis=1) & (row_claim[try_] == np.arange(len(left)))
                row[left[fine]] = try_[fine]
                used[place[fine]] = True
                taken[try_[fine]] = True
                left, own = left[~fine], own[~fine]
        # states without arcs, and the root, own no place
        row[degree == 0] = size + width
        self.root = size + width
        places = np.repeat(row, degree) + codes
        self.owner[places] = np.repeat(row, degree)
        self.target = np.zeros(size + 2 * width, dtype=np.int32)
        self.target[places] = row[targets]
        self.start = np.full(width, self.root, dtype=np.int32)
        for code, to in automaton.next[0].items():
            self.start[code] = row[to]
        self.bits = math.log2(max(2, automaton.length[automaton.last]))

    def phrases(self, grid: np.ndarray) -> np.ndarray:
        """Phrases of each lane of ``grid`` (steps x lanes); a step on padding counts as one."""
        lanes = grid.shape[1]
        state, count = np.full(lanes, self.root, dtype=np.int64), np.zeros(lanes, dtype=np.int32)
        place, own = np.empty(lanes, dtype=np.int64), np.empty(lanes, dtype=np.int32)
        for column in grid:
            np.add(state, column, out=place)
            np.take(self.owner, place, out=own, mode="clip")
            end = own != state
            state[:] = np.where(end, np.take(self.start, column), np.take(self.target, place, mode="clip"))
            count += end
        return count


class CrossParser:
    """The step tables of all languages over one set of codes: 0 for a space, 1, 2, … for letters, then unknown letters, then padding."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.langs = sorted(samples)
        flags = letter_flags()
        joined = {k: [t.lower() for t in v] for k, v in samples.items()}
        seen = np.unique(np.concatenate([code_points("".join(v)) for v in joined.values()])) if joined else np.zeros(0, np.uint32)
        letters = seen[flags[seen]] if len(seen) else seen
        self.codes = np.zeros(0x110000, dtype=np.int32)
        self.codes[flags] = len(letters) + 1
        self.codes[letters] = np.arange(1, len(letters) + 1)
        self.pad = len(letters) + 2
        self.tables = []
        for lang in self.langs:
            automaton = SuffixAutomaton()
            for text in joined[lang]:
                for code in self.normal(text)[0].tolist():
                    automaton.extend(code)
            self.tables.append(StepTable(automaton, self.pad + 1))

    def normal(self, text: str) -> tuple[np.ndarray, int]:
        """The codes of a lower-cased text, 0 for a run of other characters; the number of letters."""
        codes = self.codes[code_points(text)]
        keep = codes != 0
        n = int(np.count_nonzero(keep))
        keep[1:] |= codes[:-1] != 0
        return codes[keep], n

    def phrases(self, pieces: list[np.ndarray]) -> np.ndarray:
        """Phrases of each piece (row) in each language (column)."""
        sizes = np.array([len(p) for p in pieces])
        blocks = -(-sizes // BLOCK)
        first = np.cumsum(blocks) - blocks
        lanes = int(blocks.sum())
        grid = np.full(lanes * BLOCK, self.pad, dtype=np.int32)
        shift = np.repeat(first * BLOCK - (np.cumsum(sizes) - sizes), sizes)
        grid[np.arange(len(shift)) + shift] = np.concatenate(pieces)
        padding = blocks * BLOCK - sizes
        grid = np.ascontiguousarray(grid.reshape(lanes, BLOCK).T)
        out = np.zeros((len(pieces), len(self.langs)), dtype=np.int64)
        full = blocks > 0
        for k, steps in enumerate(self.tables if lanes else ()):
            out[full, k] = np.add.reduceat(steps.phrases(grid), first[full]) - padding[full]
        return out

    def predict(self, texts: list[str]) -> Iterator[tuple[str, float, list[int]]]:
        total = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        letters = np.zeros(len(texts), dtype=np.int64)
        for group in slices(texts):
            rows, pieces = [], []
            for row, piece in group:
                codes, n = self.normal(piece.lower())
                letters[row] += n
                rows.append(row)
                pieces.append(codes)
            np.add.at(total, rows, self.phrases(pieces))
        bits = total * np.array([t.bits for t in self.tables])
        for row in range(len(texts)):
            if not letters[row] or not self.langs:
                yield UNDETERMINED, 0.0, []
                continue
            over = bits[row] - bits[row].min()
            best = int(over.argmin())
            yield self.langs[best], float(1 / np.exp2(-TEMPER * np.minimum(over, 1000)).sum()), total[row].tolist()


def learn(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, list[str]]:
    """A bounded sample of whole texts for each language (see above).

    Rows are taken by a hash of their id, so the sample doesn't depend on their order.
    """
    spark = labelled.sparkSession
    size = F.greatest(F.length(text_col), F.lit(LONG_TEXT)).alias("size")
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), size, F.xxhash64(F.col(id_col)).alias("h"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("size", "h", "text"))
    by_size = F.row_number().over(Window.partitionBy("lang").orderBy("size", "h"))
    # at most ROWS_PER_LANG rows of three numbers a language
    found: dict[str, list[tuple[int, int, int]]] = {}
    for row in rows.select("lang", "size", "h", F.length("text").alias("chars")).withColumn("rank", by_size).filter(F.col("rank") <= ROWS_PER_LANG).collect():
        found.setdefault(row["lang"], []).append((row["size"], row["h"], row["chars"]))
    if not found:
        return {}
    most = min(CHARS_PER_LANG, max(1, CHARS_IN_ALL // len(found)))
    cuts = []
    for lang, own in sorted(found.items()):
        own.sort()
        total, n = own[0][2], 1
        while n < len(own) and total + own[n][2] <= most:
            total += own[n][2]
            n += 1
        cuts.append((lang, *own[n - 1][:2], n))
    cut = spark.createDataFrame(cuts, "lang string, last_size int, last_h long, n int")
    taken = rows.join(F.broadcast(cut) if len(cuts) <= BROADCAST_LANGS else cut, "lang")
    taken = taken.filter((F.col("size") < F.col("last_size")) | ((F.col("size") == F.col("last_size")) & (F.col("h") <= F.col("last_h"))))
    out: dict[str, list[str]] = {}
    # ids may repeat: the texts decide, and no more rows are taken
    for row in sorted(taken.withColumn("rank", rank).filter(F.col("rank") <= F.col("n")).select("lang", "rank", "text").collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(row["lang"], []).append(row["text"])
    return out


def identify(docs: DataFrame, samples: dict[str, list[str]], *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and phrases (one count for each language, alphabetically).

    Columns of ``docs`` with these names are replaced.
    """
    key = tuple((k, tuple(v)) for k, v in sorted(samples.items()))
    names = ("lang_pred", "score", "phrases")
    base = docs.drop(*names)
    fields = [(f.name, f.dataType.simpleString()) for f in base.schema.fields]
    schema = ", ".join(f"`{n}` {t}" for n, t in [*fields, ("lang_pred", "string"), ("score", "double"), ("phrases", "array<bigint>")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = hold(("language", key), lambda: CrossParser({k: list(v) for k, v in key}))
        for batch in batches:
            langs, scores, counts = zip(*parser.predict(texts_of(batch, text_col)), strict=True) if batch.num_rows else ((), (), ())
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *names])

    return map_arrow(base, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every document, learned from labelled documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    samples = learn(docs.filter(crc_fold("doc_id", 4) != 2))
    rows = docs.select("doc_id", "text", (crc_fold("doc_id", 4) == 2).alias("held_out"))
    return identify(rows, samples).select("doc_id", "held_out", "lang_pred", "score")
