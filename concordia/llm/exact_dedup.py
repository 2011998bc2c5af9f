"""Exact deduplication with counting quotient filters.

Every text has a 64-bit fingerprint.  Each partition builds counting quotient filters of
its fingerprints: the top bits name a block, the next bits are the quotient within it,
the rest is the remainder.  A filter keeps a bitmap of occupied quotients, a bitmap of
run ends, the remainders sorted inside each run, and their counts.  Filters of a block
from all partitions merge without loss by walking their sorted remainders and adding
counts.  Only texts whose fingerprint counts more than one go on to byte verification:
grouping by the text itself, with partial groups on each partition first.

A group of copies of any size is one counter in each filter and one row of each
partition's partial groups, so it is no hot spot.

Defined results: null counts as empty, and empty texts are copies of each other; of equal
texts the largest id stays (null ids are smaller than others); rows that repeat both id
and text count as the kept row each time; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm._common import map_arrow, materialize, release, table, work_tables

#: Fingerprints of a filter, at most; fingerprints of a block over all partitions, about.
FILTER_ROWS, BLOCK_ROWS = 1 << 20, 1 << 20
MIN_BLOCK_BITS, MAX_BLOCK_BITS = 4, 16
#: Repeated fingerprints that are broadcast at most (8 bytes each); more are shuffled.
BROADCAST_ROWS = 200_000


def encode_filter(fingerprints: np.ndarray, counts: np.ndarray, block_bits: int) -> bytes:
    """The filter of one block: sorted distinct unsigned fingerprints that share their top ``block_bits``."""
    n = len(fingerprints)
    q = max(3, (n - 1).bit_length())
    r = 64 - block_bits - q
    quotient = ((fingerprints >> np.uint64(r)) & np.uint64((1 << q) - 1)).astype(np.int64)
    occupied = np.zeros(1 << q, dtype=bool)
    occupied[quotient] = True
    run_end = np.append(quotient[1:] != quotient[:-1], True)
    remainder = fingerprints & np.uint64((1 << r) - 1)
    head = struct.pack("<IBB", n, q, r)
    return head + np.packbits(occupied).tobytes() + np.packbits(run_end).tobytes() + remainder.astype("<u8").tobytes() + counts.astype("<i8").tobytes()


def decode_filter(data: bytes, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints of a filter and their counts."""
    n, q, r = struct.unpack_from("<IBB", data)
    at = 6
    occupied = np.unpackbits(np.frombuffer(data, np.uint8, (1 << q) // 8, at)).astype(bool)
    at += (1 << q) // 8
    run_end = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at))[:n].astype(bool)
    at += -(-n // 8)
    remainder = np.frombuffer(data, "<u8", n, at)
    counts = np.frombuffer(data, "<i8", n, at + 8 * n)
    run = np.append(0, np.cumsum(run_end)[:-1])
    quotient = np.flatnonzero(occupied)[run].astype(np.uint64)
    return np.uint64((block << (q + r)) & ((1 << 64) - 1)) | quotient << np.uint64(r) | remainder, counts


def merge_filters(filters: list[bytes], block: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of filters of one block: sorted fingerprints with the sums of their counts."""
    parts = [decode_filter(f, block) for f in filters]
    fingerprints = np.concatenate([p[0] for p in parts])
    order = np.argsort(fingerprints, kind="stable")  # a merge, for the parts are sorted runs
    fingerprints, counts = fingerprints[order], np.concatenate([p[1] for p in parts])[order]
    first = np.flatnonzero(np.append(True, fingerprints[1:] != fingerprints[:-1]))
    return fingerprints[first], np.add.reduceat(counts, first)


def repeated(fingerprints: DataFrame, block_bits: int) -> DataFrame:
    """fp and n of all fingerprints (column ``fp``) that occur more than once."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def filters(held: list[np.ndarray]) -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held).view(np.uint64), return_counts=True)
            blocks = (values >> np.uint64(64 - block_bits)).astype(np.int64)
            starts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
            stops = np.append(starts[1:], len(blocks))
            data = [encode_filter(values[a:b], counts[a:b], block_bits) for a, b in zip(starts, stops, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(blocks[starts].astype(np.int32)), pa.array(data, pa.binary())], ["block", "filter"])

        release()
        held, n = [], 0
        for batch in batches:
            held.append(np.asarray(batch.column(0)).astype(np.int64))
            n += batch.num_rows
            if n >= FILTER_ROWS:
                yield filters(held)
                held, n = [], 0
        if n:
            yield filters(held)

    def merge(block: pa.Table) -> pa.Table:
        values, counts = merge_filters(block.column("filter").to_pylist(), block.column("block")[0].as_py())
        more = counts > 1
        return pa.table({"fp": pa.array(values[more].view(np.int64)), "n": pa.array(counts[more])})

    built = map_arrow(fingerprints.select("fp"), build, "block int, filter binary")
    return built.groupBy("block").applyInArrow(merge, "fp long, n long")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256; columns with these names are replaced."""
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.withColumns({"__fp": F.xxhash64(text), "text_sha256": F.sha2(text.cast("binary"), 256)})
    total = docs.count()
    block_bits = min(MAX_BLOCK_BITS, max(MIN_BLOCK_BITS, (total // BLOCK_ROWS).bit_length()))
    with work_tables(docs.sparkSession) as keep:
        twice = materialize(repeated(docs.select(F.xxhash64(text).alias("fp")), block_bits).select("fp"), "repeated", slim=True)
        few = twice.count() <= BROADCAST_ROWS
        suspects = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("fp"), text.alias("text"))
        suspects = suspects.join(F.broadcast(twice) if few else twice, "fp", "left_semi")
        groups = suspects.groupBy("fp", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = groups.filter(F.col("group_size") > 1).select(
            F.col("fp").alias("__fp"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size", F.lit(True).alias("__group")
        )
        groups = keep(materialize(groups, "copies", slim=True))
    few = groups.count() <= BROADCAST_ROWS // 8
    joined = marked.join(F.broadcast(groups) if few else groups, ["__fp", "text_sha256"], "left")
    keep = F.when(F.col("__group"), F.col("keep_id")).otherwise(F.col(id_col))
    return joined.select(
        *[F.col(c) for c in docs.columns],
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col(id_col)).alias("kept"),
        "text_sha256",
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op5: one row for each document, dropped ones too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicate(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
