"""Near-duplicate groups with SetSketch registers.

A text's set holds its distinct shingles of five words (runs of characters other than
space and tab to carriage return, A-Z lower-cased); fewer words form one shingle.  Rows
with equal sets form a class at once.  Each class has ``REGISTERS`` SetSketch registers
(Ertl 2021): register i is floor(1 - log_b(least exponentially spaced hash i)), clipped to
two bytes; registers of unions are the larger ones, and equal registers are
locality-sensitive.  Bands of four registers form buckets.

1. In each bucket every class is a candidate with the bucket's least class (a star).
2. Candidates whose set sizes rule a link out, or whose maximum-likelihood similarity,
   from the numbers of greater, smaller and equal registers and the set sizes, falls below
   ``ESTIMATE_FLOOR`` (more than four standard errors under the threshold), are dropped;
   the others are verified on full sets.
3. Verified links give connected components (alternating large and small stars).
4. Buckets that still hold several components are searched in full: the sketches of the
   classes outside a bucket's largest component (stragglers) against all others of the
   bucket, in bounded blocks.  Components with plausible partners form clusters, for which
   each block writes a spanning forest, not its pairs.  Within a cluster the stragglers
   are compared on full sets with all its members, through inverted indexes of blocks,
   which write forests again.  So a hot bucket costs its size once, times the blocks of
   its stragglers, and no link that shares a bucket is lost.

Two sets of similarity 0.75 share none of the 32 bands with probability 6e-6.

Defined results: null text and text without words has the empty set, links with nothing
and stays; equal texts are in one component; a component without any id has a null
component_id, and rows with a null id are kept only there; rows that repeat are in one component and
each has a row; texts are read whole; an empty table gives no rows; only the id and text columns are
read, so others may be named like results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm._common import map_arrow, materialize, release, table, texts_of, work_tables

SHINGLE, THRESHOLD = 5, 75
REGISTERS, BAND, BASE, RATE = 128, 4, 1.001, 20.0
ESTIMATE_FLOOR = 0.58
#: Classes of a block in the full search of a bucket; parts of PART shingles of a block of texts in the comparison with a component.
BLOCK, TEXT_BLOCK, PART = 1024, 512, 400
#: Partners of a class that one block verifies; rows from which a node may be hot; hot values that are broadcast at most.
PARTNERS, HOT_DEGREE, HOT_VALUES = 256, 512, 100_000
#: Rows of a stored table of hashes that is broadcast at most; larger ones are shuffled.
BROADCAST_ROWS = 100_000
#: Partitions over which the rows of one bucket or cluster spread.
SALTS = 16
#: Words whose hashes a worker remembers; hashes that are minimised at once.
CACHED_WORDS, CHUNK = 100_000, 4096

_multipliers = np.random.default_rng(7).integers(0, 1 << 64, REGISTERS, dtype=np.uint64) | np.uint64(1)
_places = np.random.default_rng(11).integers(0, 1 << 64, SHINGLE, dtype=np.uint64) | np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str, words: _Words) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    if len(words) > CACHED_WORDS:
        words.clear()
    hashed = np.fromiter(map(words.__getitem__, parts), np.uint64, n)
    size = min(n, SHINGLE)
    out = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        out = _mix(out + hashed[k : n - size + 1 + k] * _places[k])
    return np.unique(out + np.uint64(size))


def registers(shingles: np.ndarray) -> np.ndarray:
    """The SetSketch of a set that isn't empty."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), CHUNK):
        np.minimum(least, (shingles[None, at : at + CHUNK] * _multipliers[:, None]).min(axis=1), out=least)
    u = (least.astype(np.float64) + 1.0) / 2.0**64
    spaced = np.maximum(-np.log1p(-np.minimum(u, 1 - 2.0**-53)), 1e-300) / RATE
    return np.clip(np.floor(1 - np.log(spaced) / np.log(BASE)), 0, 65535).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches (rows) with known set sizes, on a grid of 1/200."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    best, found = np.full(len(a), -np.inf), np.zeros(len(a))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    tiny = 1e-12
    for share in np.linspace(0, 1, 201):
        j = share * most
        up, down = p(u - v * j), p(v - u * j)
        log = more * np.log(up + tiny) + less * np.log(down + tiny) + (REGISTERS - more - less) * np.log(np.maximum(1 - up - down, 0) + tiny)
        better = log > best
        best, found = np.where(better, log, best), np.where(better, j, found)
    return found


def plausible_pairs(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether estimate() reaches the floor, and the sizes allow a link.

    The likelihood is concave, so its slope at the floor tells on which side the maximum is.
    """
    fits = 100 * np.minimum(n_a, n_b) >= THRESHOLD * np.maximum(n_a, n_b)
    more, less = (a > b).sum(axis=-1), (a < b).sum(axis=-1)
    u = n_a / (n_a + n_b)
    v, c, log = 1 - u, (BASE - 1) / BASE, np.log(BASE)
    up, down = np.maximum(u - v * ESTIMATE_FLOOR, 1e-9), np.maximum(v - u * ESTIMATE_FLOOR, 1e-9)
    p_up, p_down = -np.log1p(-up * c) / log, -np.log1p(-down * c) / log
    s_up, s_down = c / (log * (1 - up * c)) * v, c / (log * (1 - down * c)) * u
    slope = (REGISTERS - more - less) * (s_up + s_down) / (1 - p_up - p_down) - more * s_up / p_up - less * s_down / p_down
    return fits & (slope >= 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(len(column), REGISTERS)


def sketch(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, node (16-byte hash of the set, null if empty), sketch, fp (hash of the text) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("fp"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        words = _Words()
        for batch in batches:
            sizes, nodes, sketches = [], [], []
            for text in texts_of(batch):
                shingles = shingle_set(text, words)
                sizes.append(len(shingles))
                nodes.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                sketches.append(registers(shingles).tobytes() if len(shingles) else None)
            columns = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "fp", "n_shingles", "node", "sketch"])

    return map_arrow(rows, run, f"id {kind}, fp long, n_shingles long, node binary, sketch binary")


def bands(classes: DataFrame) -> DataFrame:
    """node and key of every band of every class."""
    width = 2 * BAND
    keys = [F.xxhash64(F.lit(k), F.substring("sketch", 1 + k * width, width)) for k in range(REGISTERS // BAND)]
    return classes.select("node", F.explode(F.array(*keys)).alias("key"))


def plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose estimated similarity reaches the floor."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}"), F.col("n_shingles").alias(f"n_{c}"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                get = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
                near = plausible_pairs(_matrix(get("sketch_a")), _matrix(get("sketch_b")), np.asarray(get("n_a")), np.asarray(get("n_b")))
                yield pa.RecordBatch.from_arrays([get("a"), get("b")], ["a", "b"]).filter(pa.array(near))

    return map_arrow(pairs.join(side("b"), "b").join(side("a"), "a"), run, "a binary, b binary")


def _few(rows: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it has at most BROADCAST_ROWS rows (of some 50 bytes)."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def texts_of_nodes(needed: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node and the text of one document of each class in ``needed`` (distinct nodes); documents aren't shuffled for few."""
    needed = _few(materialize(needed, "needed", slim=True))
    needed = materialize(classes.select("node", "rep").join(needed, "node").select("node", F.col("rep.id").alias("id"), F.col("rep.fp").alias("fp")), "representatives", slim=True)
    texts = docs.select(F.col(id_col).alias("tid"), F.xxhash64(text_col).alias("tfp"), F.col(text_col).alias("text"))
    texts = texts.join(_few(needed), (texts["tfp"] == needed["fp"]) & texts["tid"].eqNullSafe(needed["id"])).select("node", "text")
    return materialize(texts.dropDuplicates(["node"]), "candidates")


def _often(rows: DataFrame, column: str, least: int) -> DataFrame:
    """column and n of the values of ``column`` in at least ``least`` rows and so large a share of all that they are few: HOT_VALUES at most."""
    least = max(least, rows.count() // HOT_VALUES + 1)
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.

    The partners of ``a`` are dealt to blocks of about PARTNERS; a block's rows come to a
    task in a row, ``a`` first, so that two texts are held at a time and ``a`` is sent once a block.
    """
    texts = texts_of_nodes(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), classes, docs, id_col, text_col)
    hot = _often(pairs, "a", PARTNERS).select("a", F.ceil(F.col("n") / PARTNERS).alias("blocks"))
    # at most HOT_VALUES rows of 24 bytes
    dealt = pairs.join(F.broadcast(hot), "a", "left").select("a", "b", F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("b"), "blocks")).cast("int").alias("block"))
    dealt = materialize(dealt, "dealt", slim=True)
    first = texts.withColumnRenamed("node", "a").join(_few(materialize(dealt.select("a", "block").distinct(), "blocks", slim=True)), "a").select("a", "block", F.lit(None).cast("binary").alias("b"), "text")
    rest = texts.withColumnRenamed("node", "b").join(_few(dealt), "b").select("a", "block", "b", "text")
    rows = first.union(rest).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        words, one = _Words(), None
        for batch in batches:
            a, b, text, linked = batch.column(0), batch.column(1), batch.column(2), []
            for row in range(batch.num_rows):
                two = shingle_set(text[row].as_py(), words)
                if not b[row].is_valid:
                    one = two
                    linked.append(False)
                    continue
                common = len(np.intersect1d(one, two, assume_unique=True))
                linked.append(100 * common >= THRESHOLD * (len(one) + len(two) - common))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return map_arrow(rows.select("a", "b", "text"), run, "a binary, b binary")


def _meet(rows: DataFrame, least: DataFrame, hot: int) -> DataFrame:
    """``rows`` (u, v) with the m of their u in ``least`` (u, m, degree); nodes of at least ``hot`` rows meet theirs by a broadcast, all if ``hot`` is 0."""
    if not hot:
        return rows.join(F.broadcast(least.select("u", "m")), "u")
    # a node has ``hot`` of the rows, so there are at most HOT_VALUES of them
    few = least.filter(F.col("degree") >= hot).select("u", F.col("m").alias("hot_m"))
    rows = rows.join(F.broadcast(few), "u", "left")
    rest = rows.filter(F.col("hot_m").isNull()).select("u", "v").join(least.select("u", "m"), "u")
    return rows.filter(F.col("hot_m").isNotNull()).select("u", "v", F.col("hot_m").alias("m")).union(rest.select("u", "v", "m"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node of edges (a < b) has one least node a, which has none: then the components are known."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("below")), F.struct(F.col("b").alias("node"), F.lit(1).alias("below")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.below").alias("below"), F.count(F.lit(1)).alias("n"))
    return nodes.filter((F.col("below") > 0) & (F.col("n") > 1)).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node and label (least node) of every node that a link (a, b) has, by large and small stars."""
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges", slim=True)
    while not _stars(edges):
        n = edges.count()
        # an edge has two nodes: of few edges all nodes are broadcast
        hot = 0 if 2 * n <= BROADCAST_ROWS else max(HOT_DEGREE, 2 * n // HOT_VALUES + 1)
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
        large = _meet(sides.filter("v > u"), least, hot).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        small = _meet(large, least, hot).select(F.explode(F.array("u", "v")).alias("b"), F.col("m").alias("a")).filter("a <> b")
        edges = materialize(small.select("a", "b").distinct(), "edges", slim=True)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def _blocks(rows: DataFrame, sizes: DataFrame, by: str, block: int) -> DataFrame:
    """``rows`` (by, node, label) dealt to groups (by, first, second), with out (not in the largest component) and block.

    A group is block ``first`` of the stragglers with block ``second`` >= first of the
    stragglers, or with block -1 - ``second`` of the largest component.  ``sizes`` has by, label, n.
    """
    mixed = sizes.groupBy(by).agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("labels"))
    mixed = mixed.filter("labels > 1").select(
        by,
        F.col("top.label").alias("top"),
        F.ceil(F.col("top.n") / block).cast("int").alias("top_blocks"),
        F.ceil((F.col("all") - F.col("top.n")) / block).cast("int").alias("blocks"),
    )
    mixed = materialize(mixed, "mixed", slim=True)
    if mixed.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(mixed), by)
    else:
        # a hot group's rows meet its one row of ``mixed`` in SALTS partitions
        mixed = mixed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64("node", F.lit("salt")), F.lit(SALTS)).cast("int"))
        rows = rows.join(mixed, [by, "__salt"]).drop("__salt")
    rows = rows.withColumn("out", F.col("label") != F.col("top"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("out"), F.col("blocks")).otherwise(F.col("top_blocks"))).cast("int"))
    each = lambda n, body: F.transform(F.sequence(F.lit(0), F.col(n) - 1), body)
    pair = lambda first, second: F.struct(first.alias("first"), second.alias("second"))
    own = F.col("block")
    others = each("blocks", lambda i: pair(F.least(i, own), F.greatest(i, own)))
    tops = each("top_blocks", lambda t: pair(own, -1 - t))
    top = each("blocks", lambda i: pair(i, -1 - own))
    rows = rows.withColumn("group", F.explode(F.when(F.col("out"), F.concat(others, tops)).otherwise(top)))
    return rows.select(by, F.col("group.first").alias("first"), F.col("group.second").alias("second"), "node", "label", "out", "block")


def _forest(group: pa.Table, near) -> pa.Table:
    """Links of nodes that join the group's components: near(i, js) picks the partners of row i among rows js."""
    out = np.array(group.column("out").to_pylist(), dtype=bool)
    first, second = group.column("first")[0].as_py(), group.column("second")[0].as_py()
    block = np.asarray(group.column("block"))
    nodes, labels = group.column("node").to_pylist(), group.column("label").to_pylist()
    ids = {label: i for i, label in enumerate(dict.fromkeys(labels))}
    root = np.arange(len(ids))
    label = np.array([ids[x] for x in labels])
    right = np.flatnonzero(~out) if second < 0 else np.flatnonzero(out & (block == second))
    found_a, found_b = [], []
    for i in np.flatnonzero(out & (block == first)):
        js = right[root[label[right]] != root[label[i]]]
        for j in near(i, js) if len(js) else ():
            if root[label[j]] != root[label[i]]:
                root[root == root[label[j]]] = root[label[i]]
                found_a.append(nodes[i])
                found_b.append(nodes[j])
    return pa.table({"a": pa.array(found_a, pa.binary()), "b": pa.array(found_b, pa.binary())})


def clusters(members: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """label and cluster of the components that plausible partners in buckets (members: key, node) connect."""
    known = members.join(_few(labels), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    rows = _blocks(known, known.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")), "key", BLOCK)
    rows = rows.join(classes.select("node", "sketch", "n_shingles"), "node").select("key", "first", "second", "node", "label", "out", "block", "sketch", "n_shingles")

    def run(group: pa.Table) -> pa.Table:
        matrix, n = _matrix(group.column("sketch").combine_chunks()), np.asarray(group.column("n_shingles"))
        return _forest(group, lambda i, js: js[plausible_pairs(matrix[i][None], matrix[js], n[i], n[js])])

    pairs = materialize(rows.groupBy("key", "first", "second").applyInArrow(run, "a binary, b binary").distinct(), "near-nodes", slim=True)
    few = labels.count() <= BROADCAST_ROWS

    def name(c: str) -> DataFrame:
        side = labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}"))
        return F.broadcast(side) if few else side

    pairs = pairs.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    return components(pairs).select(F.col("node").alias("label"), F.col("label").alias("cluster"))


def join_components(cluster: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified links (a, b) that join all components of a cluster that any link joins."""
    # a component of one class isn't in ``labels``
    cluster = _few(cluster)
    alone = cluster.join(labels.select("label").distinct(), "label", "left_anti").select(F.col("label").alias("node"), "label", "cluster")
    held = materialize(labels.join(cluster, "label").select("node", "label", "cluster").union(alone), "cluster-members", slim=True)
    # blocks are bounded by what their sets hold, not by rows: a long text has many parts
    parts = held.join(classes.select("node", F.ceil(F.col("n_shingles") / PART).alias("parts")), "node")
    rows = materialize(_blocks(held, parts.groupBy("cluster", "label").agg(F.sum("parts").alias("n")), "cluster", TEXT_BLOCK), "comparisons", slim=True)
    texts = texts_of_nodes(rows.select("node").distinct(), classes, docs, id_col, text_col)

    def run(group: pa.Table) -> pa.Table:
        words = _Words()
        sets = [shingle_set(t, words) for t in group.column("text").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        shingles = np.concatenate(sets)
        order = np.argsort(shingles, kind="stable")
        shingles, owner = shingles[order], np.repeat(np.arange(len(sets)), sizes)[order]

        def near(i: int, js: np.ndarray) -> np.ndarray:
            first, last = np.searchsorted(shingles, sets[i], "left"), np.searchsorted(shingles, sets[i], "right")
            times = last - first
            at = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
            common = np.bincount(owner[at], minlength=len(sets))[js]
            return js[100 * common >= THRESHOLD * (sizes[js] + sizes[i] - common)]

        return _forest(group, near)

    return texts.join(_few(rows), "node").groupBy("cluster", "first", "second").applyInArrow(run, "a binary, b binary")


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept, text_fp (xxhash64 of the text) of every row of ``docs``."""
    with work_tables(docs.sparkSession) as keep:
        rows = keep(materialize(sketch(docs, id_col=id_col, text_col=text_col), "sketches"))
        named = keep(_named(rows, docs, id_col, text_col))
    found = rows.select("id", "fp", "n_shingles", "node").join(_few(named), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"), F.col("fp").alias("text_fp"))


def _named(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node and component_id of all sets."""
    classes = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("rep"), F.max("sketch").alias("sketch"), F.max("n_shingles").alias("n_shingles")
    )
    classes = materialize(classes, "classes")
    keyed = bands(classes)
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).filter("n > 1")
    members = materialize(keyed.join(shared, "key").select("key", "node", "hub"), "members", slim=True)
    pairs = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    pairs = materialize(plausible(pairs, classes), "pairs", slim=True)
    links = verify(pairs, classes, docs, id_col=id_col, text_col=text_col)
    first = materialize(components(materialize(links, "links", slim=True)), "labels", slim=True)
    cluster = materialize(clusters(members.select("key", "node"), first, classes), "clusters", slim=True)
    found = join_components(cluster, first, classes, docs, id_col=id_col, text_col=text_col)
    # components of the first round count as links to their least node
    labels = components(first.select(F.col("label").alias("a"), F.col("node").alias("b")).union(found))
    of = classes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.col("rep.id").alias("id"))
    of = materialize(of, "class-labels", slim=True)
    least = of.groupBy("label").agg(F.min("id").alias("component_id"))
    return materialize(of.join(least, "label").select("node", "component_id"), "class-components", slim=True)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: one row for each document with its component."""
    return near_groups(table(spark, sf_dir, "documents")).drop("text_fp")
