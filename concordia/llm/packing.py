"""Best-fit packing of token sequences by a grouping genetic algorithm.

Pieces of equal length are interchangeable, so a packing is a list of (bin pattern,
number of bins) over the histogram of lengths, which has at most ``capacity`` entries
however large the corpus is.  On it runs a grouping genetic algorithm: crossover injects
whole well-filled bins of one parent into the other, bins that would use a piece twice
are removed, and the displaced pieces go back by best fit in decreasing order, or as the
sets that fill a bin best; mutation
empties poorly filled bins.  Islands evolve as separate Spark tasks and send their elite
to their neighbours between epochs.  It stops early, after a generation at least, at the lower bound,
or when epochs bring nothing any more.

The winning patterns then deal out the pieces: the rank of a piece among those of its
length tells its bin and its place there.  Ranks are exact and distributed (counts of
hashed sub-buckets, then a rank inside each), so a length that a third of all pieces
share is no hot spot, and no text or token crosses the network.

Defined results: null text is empty; an empty text is the end id alone; texts of any
length are encoded whole, and only those of more than ``capacity`` ids are cut, so that
just the first piece is shorter; equal rows are packed each; an empty table gives no rows;
columns of the input named like a result are replaced.
"""

from __future__ import annotations

import json
import pickle
import random
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordia.llm._common import hold, map_arrow, materialize, table, texts_of

CAPACITY, END_ID = 2048, 0
ISLANDS, EPOCHS, GENERATIONS, POPULATION, SEED = 4, 6, 30, 6, 20
#: Share of the bound by which best fit may miss it before sets of pieces are looked for.
EASY = 0.002
#: Rows of a sub-bucket in which pieces of one length are ranked, about; its hashes have at most MAX_SUBS values.
SUB_ROWS, MIN_SUBS, MAX_SUBS = 200_000, 8, 4096
#: Token ids that a Python worker holds before it hands them on.
HELD_IDS = 1 << 20

Pattern = tuple[int, ...]
Packing = dict[Pattern, int]


# ---------------------------------------------------------------- tokens
def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """A function from text to ids, equal to the tokenizers library on the file.

    Byte-level files whose ids follow the order of the merges run on the faster rank
    encoder; anything that it can't do is left to the tokenizers library.
    """
    import tiktoken
    from tokenizers import Tokenizer

    @lru_cache(maxsize=1)
    def slow() -> Tokenizer:
        out = Tokenizer.from_file(path)
        out.no_truncation()
        out.no_padding()
        return out

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab[a + b] for a, b in pairs]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex") and not spec.get("normalizer")
    if not plain or made != sorted(set(made)) or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        return lambda text: slow().encode(text, add_special_tokens=False).ids
    symbols = byte_symbols()
    ranks = {bytes(symbols[c] for c in token): i for token, i in vocab.items()}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    # the pattern that byte-level pre-tokenizers of this library use
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all", disallowed_special=())
        except BaseException as error:  # the rank encoder panics on some very long runs
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return slow().encode(text, add_special_tokens=False).ids

    return encode


def tokenize(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` ids: id, piece, start, length, ids (little-endian unsigned 32-bit)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = hold(("ids", path), lambda: encoder(path))
        for batch in batches:
            own = batch.column(0)
            rows, columns, held = [], [[], [], [], []], 0

            def flush(own=own):
                arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
                return pa.RecordBatch.from_arrays([own.take(pa.array(rows, pa.int64())), *arrays], ["doc_id", *schema.names])

            for row, text in enumerate(texts_of(batch)):
                ids = np.array([*encode(text), end_id], dtype="<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)] if len(ids) > capacity else [0, len(ids)]
                for piece, (start, stop) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append(row)
                    for column, value in zip(columns, (piece, start, stop - start, ids[start:stop].tobytes()), strict=True):
                        column.append(value)
                held += len(ids)
                if held > HELD_IDS:
                    yield flush()
                    rows, columns, held = [], [[], [], [], []], 0
            if rows:
                yield flush()

    return map_arrow(rows, run, f"doc_id {kind}, piece int, start long, length long, ids binary")


# ---------------------------------------------------------------- packings of a histogram
def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins (Martello and Toth): for each least length, the pieces that share a bin with none so long, and the volume that doesn't fit beside those of more than half a bin."""
    if not counts:
        return 0
    length = np.array(sorted(counts), dtype=np.int64)
    number = np.array([counts[k] for k in length.tolist()], dtype=np.int64)
    n, volume = np.append(0, np.cumsum(number)), np.append(0, np.cumsum(number * length))
    half = int(np.searchsorted(length, capacity // 2, side="right"))
    least = np.append(0, length[:half])
    small = np.searchsorted(length, least)
    alone = np.maximum(half, np.searchsorted(length, capacity - least, side="right"))
    middle = n[alone] - n[half]
    beside = volume[half] - volume[small] - (capacity * middle - (volume[alone] - volume[half]))
    return int((n[-1] - n[alone] + middle + np.maximum(0, -(-beside // capacity))).max())


def size_of(packing: Packing) -> int:
    return sum(packing.values())


def fitness(packing: Packing, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (mean squared fill)."""
    return size_of(packing), -sum(n * (sum(p) / capacity) ** 2 for p, n in packing.items())


def best_fit(counts: dict[int, int], capacity: int, kept: Packing | None = None, chance: random.Random | None = None) -> Packing:
    """Put pieces, longest first (or nearly, with ``chance``), into the fullest open bin that takes them, else into new bins."""
    done: Counter = Counter()
    gaps: dict[int, dict[Pattern, int]] = {}
    order: list[int] = []

    def put(pattern: Pattern, n: int) -> None:
        gap = capacity - sum(pattern)
        if not n or not gap:
            done[pattern] += n
            return
        if gap not in gaps:
            gaps[gap] = {}
            insort(order, gap)
        gaps[gap][pattern] = gaps[gap].get(pattern, 0) + n

    for pattern, n in (kept or {}).items():
        put(pattern, n)
    noise = {k: chance.uniform(0.7, 1.3) if chance else 1.0 for k in sorted(counts)}
    for length in sorted((k for k, n in counts.items() if n), key=lambda k: (-k * noise[k], -k)):
        left = counts[length]
        while left:
            at = bisect_left(order, length)
            if at < len(order):
                gap = order[at]
                pattern, n = gaps[gap].popitem()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                gap, pattern, n = capacity, (), left
            each = gap // length
            full = min(n, left // each)
            put((*pattern, *[length] * each), full)
            left -= full * each
            n -= full
            if left and n and left < each:
                put((*pattern, *[length] * left), 1)
                left, n = 0, n - 1
            if pattern:
                put(pattern, n)
    for group in gaps.values():
        for pattern, n in group.items():
            done[pattern] += n
    return {p: n for p, n in done.items() if n}


def best_sets(counts: dict[int, int], capacity: int, chance: random.Random, tries: int = 24) -> Packing:
    """Bin by bin, the longest piece left and those sets of up to three others that leave the least room; of full triples ``tries`` first pieces are tried."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    left[list(counts)] = list(counts.values())
    every = np.arange(capacity + 1)
    out: Counter = Counter()

    def open_lengths() -> tuple[np.ndarray, np.ndarray]:
        """The lengths left, and for each room the longest of them that it takes."""
        return np.flatnonzero(left), np.maximum.accumulate(np.where(left > 0, every, 0))

    def best_set(gap: int) -> list[int]:
        a = lengths[: np.searchsorted(lengths, gap, side="right")]
        b = floor[gap - a]
        b = np.where((b == a) & (left[a] < 2), 0, b)
        at = int((a + b).argmax())
        found = [int(a[at]), int(b[at])]
        if sum(found) < gap:
            first = a if len(a) <= tries else a[sorted(chance.sample(range(len(a)), tries))]
            room = gap - first[:, None] - a[None, :]
            c = np.where(room > 0, floor[np.maximum(room, 0)], 0)
            twice = (first[:, None] == a[None, :]).astype(int)
            need = np.maximum(1 + twice + (c == first[:, None]), 1 + (c == a[None, :]) + twice)
            enough = (left[first][:, None] > twice) & (left[c] >= np.where(c > 0, 1 + (c == first[:, None]) + (c == a[None, :]), 0)) & (left[a][None, :] >= np.where(twice > 0, need, 1))
            total = np.where((room >= 0) & enough, first[:, None] + a[None, :] + c, 0)
            if total.max() > sum(found):
                i, j = np.unravel_index(int(total.argmax()), total.shape)
                found = [int(first[i]), int(a[j]), int(c[i, j])]
        return [x for x in found if x]

    lengths, floor = open_lengths()
    while len(lengths):
        pieces, gap = [int(lengths[-1])], capacity - int(lengths[-1])
        left[lengths[-1]] -= 1
        lengths, floor = open_lengths()
        while len(lengths) and gap >= lengths[0]:
            more = best_set(gap)
            for k in more:
                left[k] -= 1
            pieces += more
            gap -= sum(more)
            lengths, floor = open_lengths()
        # half of the bins that could be alike are made alike
        need = Counter(pieces)
        again = int(min(left[k] // c for k, c in need.items())) // 2
        for k, c in need.items():
            left[k] -= c * again
        out[tuple(sorted(pieces, reverse=True))] += 1 + again
        lengths, floor = open_lengths()
    return dict(out)


def put_back(free: dict[int, int], capacity: int, kept: Packing, chance: random.Random, sets: float) -> Packing:
    """Displaced pieces into the bins kept and new ones by best fit, or in a share ``sets`` of cases into new ones by best sets."""
    free = {k: n for k, n in free.items() if n}
    if free and chance.random() < sets:
        return dict(Counter(kept) + Counter(best_sets(free, capacity, chance)))
    return best_fit(free, capacity, kept, chance if chance.random() < 0.7 else None)


def cross(mine: Packing, other: Packing, counts: dict[int, int], capacity: int, chance: random.Random, sets: float = 0.0) -> Packing:
    """Inject well-filled bins of ``other``, keep what then still fits of ``mine``, put back the rest."""
    free = dict(counts)

    def take(pattern: Pattern, most: int) -> int:
        need = Counter(pattern)
        n = min(most, *(free[k] // c for k, c in need.items()))
        for k, c in need.items():
            free[k] -= c * n
        return n

    kept: Counter = Counter()
    share = chance.uniform(0.2, 0.6)
    for pattern, n in sorted(other.items(), key=lambda x: (-sum(x[0]), x[0])):
        if sum(pattern) < capacity - capacity // 64:
            break
        if chance.random() < share:
            kept[pattern] += take(pattern, n)
    for pattern, n in sorted(mine.items(), key=lambda x: (-sum(x[0]), x[0])):
        kept[pattern] += take(pattern, n)
    return put_back(free, capacity, {p: n for p, n in kept.items() if n}, chance, sets)


def mutate(packing: Packing, capacity: int, chance: random.Random, sets: float = 0.0) -> Packing:
    """Empty some bins and put their pieces back: a few, poorly filled ones rather than full ones, or the poorly filled ones and a share of all."""
    free: Counter = Counter()
    kept: Packing = {}
    bins, room = size_of(packing), sum(n * (capacity - sum(p)) for p, n in packing.items())
    few = chance.random() < sets
    # bins to empty in proportion to their room, with a little for full ones; or a share of all bins
    aim = max(6.0, bins * chance.choice((0.01, 0.03, 0.1, 0.3)))
    short, share = capacity - capacity // 32, chance.choice((0.05, 0.15, 0.4, 0.7))
    for pattern, n in sorted(packing.items()):
        part = min(1.0, aim * (capacity - sum(pattern) + 0.5) / (room + 0.5 * bins)) if few else 1.0 if sum(pattern) < short and chance.random() < 0.7 else share
        # of many equal bins the share itself goes, of few each by chance
        gone = min(n, round(n * part * chance.uniform(0.5, 1.5))) if n > 20 and part < 1 else sum(chance.random() < part for _ in range(n))
        for k in pattern:
            free[k] += gone
        if n > gone:
            kept[pattern] = n - gone
    return put_back(free, capacity, kept, chance, sets if few else 0.0)


def evolve(counts: dict[int, int], capacity: int, start: list[Packing], generations: int, population: int, seed: int) -> list[Packing]:
    """One island for one epoch; the best packings come first."""
    chance = random.Random(seed)
    bound = lower_bound(counts, capacity)
    key = lambda p: fitness(p, capacity)
    pool = [best_fit(counts, capacity), *start]
    # far from the bound, pieces are too long to fill the gaps that best fit leaves: sets are looked for
    sets = 0.6 if size_of(pool[0]) > bound * (1 + EASY) else 0.0
    if sets and not start:
        pool.append(best_sets(counts, capacity, chance))
    while len(pool) < population:
        pool.append(mutate(chance.choice(pool[:2]), capacity, chance, sets))
    pool.sort(key=key)
    for generation in range(generations):
        if generation and size_of(pool[0]) <= bound:
            break
        children = []
        for _ in range(population // 2):
            a, b = chance.sample(pool[: max(2, population // 2)], 2)
            crossed = chance.random() < (0.3 if sets else 0.7)
            child = cross(a, b, counts, capacity, chance, sets) if crossed else a
            children.append(child if crossed and chance.random() < 0.5 else mutate(child, capacity, chance, sets))
        # equal packings would fill the pool
        unlike = {tuple(sorted(p.items())): p for p in [*pool, *children]}
        pool = sorted(unlike.values(), key=key)[:population]
        if len(pool) < 2:
            pool.append(mutate(pool[0], capacity, chance, sets))
    return pool


def islands(spark, counts: dict[int, int], capacity: int = CAPACITY, *, n_islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION, seed: int = SEED) -> Packing:
    """The best packing of all islands; each epoch starts from the elite of an island and of its neighbour.

    It ends at the lower bound, or when epochs have brought no bin less, or after ``epochs``.
    """
    bound = lower_bound(counts, capacity)
    elite: list[list[Packing]] = [[] for _ in range(n_islands)]
    best: Packing = {}
    sizes: list[int] = []
    for epoch in range(epochs if counts else 0):
        # near the bound one epoch without a bin less is enough, else two
        wait = 2 if best and size_of(best) <= bound * (1 + EASY) else 3
        if best and (size_of(best) <= bound or sizes[-wait:] == [size_of(best)] * wait):
            break
        sent = [pickle.dumps([*own, *before[:1]]) for own, before in zip(elite, elite[-1:] + elite[:-1], strict=True)]

        def run(batches, epoch=epoch, sent=sent):
            for batch in batches:
                ids = batch.column(0).to_pylist()
                out = [pickle.dumps(evolve(counts, capacity, pickle.loads(sent[i]), generations, population, seed + 1000 * epoch + i)[:2]) for i in ids]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["island", "elite"])

        rows = map_arrow(spark.range(0, n_islands, 1, n_islands), run, "island long, elite binary").collect()
        for row in rows:
            elite[row["island"]] = pickle.loads(row["elite"])
        best = min([*([best] if best else []), *(e[0] for e in elite)], key=lambda p: fitness(p, capacity))
        sizes.append(size_of(best))
    return best


# ---------------------------------------------------------------- places
def layout(packing: Packing) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, in order of rank: first rank, pieces of it in each bin, first bin, offset of the first piece in a bin."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    first_bin = 0
    for pattern, n in sorted(packing.items()):
        offset = 0
        for length, each in sorted(Counter(pattern).items(), reverse=True):
            rows.setdefault(length, []).append((used[length], each, first_bin, offset))
            used[length] += n * each
            offset += length * each
        first_bin += n
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, *, keys: tuple[str, ...] = ("doc_id", "piece"), length_col: str = "length", **options) -> DataFrame:
    """``pieces`` with sequence_id and offset; lengths are 1 to ``capacity``, and ``keys`` order equal lengths.

    Columns with these names are replaced.  ``pieces`` is read three times: pass a stored table.
    """
    spark = pieces.sparkSession
    rows = pieces.drop("sequence_id", "offset").withColumn("__length", F.col(length_col).cast("long"))
    counts = {r["__length"]: r["n"] for r in rows.groupBy("__length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = layout(islands(spark, counts, capacity, **options))
    subs = min(MAX_SUBS, max(MIN_SUBS, sum(counts.values()) // SUB_ROWS))
    rows = rows.withColumn("__sub", F.pmod(F.xxhash64(*keys), F.lit(subs)))
    before = Window.partitionBy("__length").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("__length", "__sub").agg(F.count(F.lit(1)).alias("__n"))
    offsets = offsets.select("__length", "__sub", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__length", "__sub").orderBy(*keys)
    ranked = rows.join(offsets, ["__length", "__sub"]).withColumn("__rank", F.col("__before") + F.row_number().over(within) - 1)
    ranked = ranked.drop("__sub", "__before")
    names = [c for c in ranked.columns if c not in ("__length", "__rank")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*names).schema.fields), "sequence_id long", "offset long"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("__length", "__rank"))
            bins, offsets = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                mine = lengths == length
                first, each, base, offset = places[int(length)]
                at = np.searchsorted(first, ranks[mine], side="right") - 1
                bin_, nth = np.divmod(ranks[mine] - first[at], each[at])
                bins[mine], offsets[mine] = base[at] + bin_, offset[at] + nth * length
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bins), pa.array(offsets)], [*names, "sequence_id", "offset"])

    return map_arrow(ranked.select(*names, "__length", "__rank"), run, schema)


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """The ids of every sequence (binary): ``pieces`` of tokenize() put where pack() says."""
    joined = packed.select("doc_id", "piece", "sequence_id", "offset").join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))


def pack_documents(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    pieces = tokenize(docs, path, capacity=capacity, end_id=end_id)
    digests = materialize(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(digests, capacity, keys=("doc_id", "piece", "ids_crc32"))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: all documents into sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
