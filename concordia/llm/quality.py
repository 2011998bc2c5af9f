"""Quality classification with a factorisation machine.

Features are hashed words (logarithmic counts, scaled to length one), statistics of the
text's structure in logarithmic bins, and its length as metadata.  A second-order
factorisation machine weighs them and, through low-rank vectors, all their pairs; by the
sum-of-squares identity a text of n features is scored in n * RANK steps.  It is fitted
by AdaGrad on a bounded, documented sample of labelled texts (``SAMPLE`` rows, taken by a
hash of their id); every text is scored whole.

Defined results: null counts as empty, and empty texts get the score of their structure
alone; equal texts get equal scores; without labels every score is 0.5; labels other than
0 and 1 and labels without a document are not used; repeated labels count each, up to ``SAMPLE``
rows in all; an empty table gives no rows; columns of the input named like a result are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm._common import crc_fold, map_arrow, table, texts_of

#: Labelled rows that are learned from at most.
SAMPLE = 6000
WORD_BUCKETS, BINS, RANK = 4096, 12, 8
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 128, 0.08, 1e-5, 3
#: The score from which a text is predicted to have label 1.
CUT = 0.3
CACHED_WORDS = 400_000

_KINDS = ("upper", "lower", "digit", "space", "stop", "comma", "mark", "sign", "high", "control")


def _byte_kinds() -> np.ndarray:
    """For each byte a one-hot row over _KINDS."""
    out = np.zeros((256, len(_KINDS)))
    for b in range(256):
        c = chr(b)
        kind = (
            "high" if b > 127 else "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else "space" if c.isspace()
            else "stop" if c in ".:;" else "comma" if c in ",'-" else "mark" if c in "!?\"()" else "sign" if b > 32 and b != 127 else "control"
        )
        out[b, _KINDS.index(kind)] = 1
    return out


_kinds = _byte_kinds()
STATISTICS = (*_KINDS, "length", "words", "word_length", "distinct_words", "top_word", "lines", "line_length", "distinct_lines", "top_line", "long_words", "short_words", "stops_a_word")
WIDTH = WORD_BUCKETS + len(STATISTICS) * BINS


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word) % WORD_BUCKETS
        return value


def _bin(share: float) -> int:
    """Shares 0 to 1 in bins that halve towards 0."""
    return 0 if share <= 0 else max(1, BINS - 1 + math.floor(math.log2(min(1.0, share)) * 1.25))


def _scale(value: float, top: float) -> int:
    """Sizes from 0 in logarithmic bins up to ``top``."""
    return min(BINS - 1, int((BINS - 1) * math.log1p(value) / math.log1p(top)))


def features(text: str, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers and values."""
    data = text.encode("utf-8", "surrogatepass")
    parts = data.lower().split()
    if len(words) > CACHED_WORDS:
        words.clear()
    n, size = len(parts), max(1, len(data))
    counts = np.bincount(np.fromiter(map(words.__getitem__, parts), np.int64, n), minlength=WORD_BUCKETS)
    index = np.flatnonzero(counts)
    value = np.log1p(counts[index])
    kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _kinds
    lines = [x for x in data.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, parts), np.int64, n)
    many = max(1, n)
    tops = np.array(list(Counter(parts).values()), np.int64)
    unlike = set(lines)
    repeats = 1.0 - len(unlike) / len(lines) if lines else 0.0
    binned = [_bin(k / size) for k in kinds]
    binned += [
        _scale(len(text), 100_000), _scale(n, 20_000), _scale(sizes.mean() if n else 0, 40), _bin(1.0 - len(tops) / many), _bin(tops.max() / many if n else 0),
        _scale(len(lines), 1000), _scale(size / max(1, len(lines)), 20_000), _bin(repeats), _bin(1 / len(unlike) if repeats else 0),
        _bin((sizes > 14).mean() if n else 0), _bin((sizes < 3).mean() if n else 0), _bin(kinds[_KINDS.index("stop")] / many),
    ]
    place = WORD_BUCKETS + np.arange(len(STATISTICS)) * BINS + np.array(binned)
    norm = math.sqrt(float(value @ value)) or 1.0
    return np.concatenate([index, place]), np.concatenate([value / norm, np.full(len(place), 1 / math.sqrt(len(place)))])


class FactorisationMachine:
    """bias + <w, x> + half of the sum over ranks of (sum v x)^2 - sum (v x)^2, through a logistic."""

    def __init__(self, width: int = WIDTH, rank: int = RANK, seed: int = SEED) -> None:
        self.chance = np.random.default_rng(seed)
        self.bias, self.w = 0.0, np.zeros(width)
        self.v = self.chance.normal(0, 0.05, (width, rank))

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        vx = self.v[index] * value[:, None]
        total = vx.sum(axis=0)
        return float(self.bias + self.w[index] @ value + 0.5 * (total @ total - (vx * vx).sum()))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> FactorisationMachine:
        if not len(rows):
            return self
        share = float(np.clip(labels.mean(), 0.01, 0.99))
        self.bias = math.log(share / (1 - share))
        sums = [1e-8, np.full_like(self.w, 1e-8), np.full_like(self.v, 1e-8)]
        for _ in range(EPOCHS):
            order = self.chance.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                batch = order[at : at + BATCH]
                x = np.zeros((len(batch), len(self.w)))
                for k, row in enumerate(batch):
                    x[k, rows[row][0]] = rows[row][1]
                used = np.flatnonzero(x.any(axis=0))
                x, w, v = x[:, used], self.w[used], self.v[used]
                xv = x @ v
                margin = self.bias + x @ w + 0.5 * ((xv**2).sum(axis=1) - (x**2 @ v**2).sum(axis=1))
                g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[batch]) / len(batch)
                steps = (g.sum(), x.T @ g + DECAY * w, x.T @ (g[:, None] * xv) - (x**2).T @ g[:, None] * v + DECAY * v)
                sums[0] += steps[0] ** 2
                sums[1][used] += steps[1] ** 2
                sums[2][used] += steps[2] ** 2
                self.bias -= RATE * steps[0] / math.sqrt(sums[0])
                self.w[used] -= RATE * steps[1] / np.sqrt(sums[1][used])
                self.v[used] -= RATE * steps[2] / np.sqrt(sums[2][used])
        return self


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> FactorisationMachine:
    """A machine fitted to at most ``sample`` labelled rows."""
    chosen = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    chosen = chosen.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64("__id"), "__id", "label").limit(sample)
    # bounded by ``sample``, so it is broadcast
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id").select("__id", "text", "label")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            found = [features(t, words) for t in texts_of(batch)]
            columns = [batch.column(0), batch.column(2), pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "index", "value"])

    kind = rows.schema["__id"].dataType.simpleString()
    # ids may repeat: the rows are in one order, and no more are taken than labels were
    got = map_arrow(rows, run, f"id {kind}, label int, index binary, value binary").orderBy("id", "label", "index", "value").limit(sample).toArrow()
    pairs = [(np.frombuffer(i, "<i4"), np.frombuffer(v, "<f4").astype(float)) for i, v in zip(got.column("index").to_pylist(), got.column("value").to_pylist(), strict=True)]
    return FactorisationMachine().fit(pairs, np.array(got.column("label").to_pylist(), dtype=float))


def score(docs: DataFrame, machine: FactorisationMachine, *, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted; columns with these names are replaced."""
    base = docs.drop("score", "predicted")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields), "score double, predicted int"])
    bias, w, v = machine.bias, machine.w.astype(np.float32), machine.v.astype(np.float32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = _Words(), FactorisationMachine()
        own.bias, own.w, own.v = bias, w.astype(float), v.astype(float)
        for batch in batches:
            scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, own.margin(*features(t, words)))))) for t in texts_of(batch, text_col)]
            columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= CUT) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score", "predicted"])

    return map_arrow(base, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every document's quality, learned from labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = learn(docs, labels.filter(crc_fold("doc_id", 5) != 0))
    rows = docs.select("doc_id", "text", (crc_fold("doc_id", 5) == 0).alias("held_out"))
    return score(rows, machine).select("doc_id", "held_out", "score", "predicted")
