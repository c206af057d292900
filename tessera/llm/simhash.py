"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of its shingles. Two fingerprints link
if they differ in at most two bits. A fingerprint has two segments of 32 bits, and there is a table for each: number and
value of the segment, fingerprint. Of two bits that differ, one segment at least has at most one, so each fingerprint probes,
in each table, the Hamming ball of radius one around its own segment; of two neighbours the one that lacks the bit probes the
other, which halves the ball. What the tables hold there is fetched, and the complete distance is verified.

A table's bucket of more than CROWD fingerprints isn't fetched, as its pairs grow as a square. All that are in such a bucket or
probe it are linked exactly in another way: each enumerates the balls in both segments, the other segment as it is. Two
fingerprints within two bits have one of these 65 entries in common, at most 65 share one, and each links to the smallest of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels
from tessera.llm.components import components
from tessera.llm.shared import fresh, row_key, written

RADIUS, CROWD = 2, 64


def fingerprints_of(column: pa.Array, width: int = 3) -> np.ndarray:
    """A fingerprint (uint64) for each text; zero without words. Fewer words than width: the whole sequence is the one shingle."""
    out = np.zeros(len(column), np.uint64)
    digest = xxhash.xxh64_intdigest
    for lo, hi, data, off in kernels.text_blocks(column):
        low = kernels.LOWER[data]
        member = kernels.WORD[low]
        starts, ends, first = kernels.runs(member, off)
        flat, to, end = kernels.squeezed(low, member, starts, ends)
        n = np.diff(first)
        shingles = np.where(n == 0, 0, np.maximum(1, n - width + 1))
        at = np.cumsum(shingles) - shingles
        begin = np.repeat(first[:-1] - at, shingles) + np.arange(int(shingles.sum()))
        last = np.minimum(begin + width, np.repeat(first[1:], shingles)) - 1
        whole, h = flat.tobytes(), np.empty(len(begin), np.uint64)
        for i in range(0, len(begin), 1 << 17):
            part = slice(i, i + (1 << 17))
            pieces = [whole[a:b] for a, b in zip(to[begin[part]].tolist(), end[last[part]].tolist(), strict=True)]
            h[part] = np.fromiter(map(digest, pieces, repeat(42)), np.uint64, len(pieces))
        out[lo:hi] = kernels.majority(h, np.append(at, len(begin)))
    return out


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """The other columns but text, and fp (the fingerprint as a signed long). One pass, no shuffle."""
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest, F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array(fingerprints_of(batch.column(len(rest)), width).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(rest))] + [fp], names=[*rest, "fp"])

    return docs.select(*rest, text).mapInArrow(run, schema)


_LOW, _HIGH = "fp & 4294967295L", "shiftrightunsigned(fp, 32) | 4294967296L"


def _met(fps: DataFrame) -> DataFrame:
    """(src, dst): edges that connect all fps within two bits of each other, through an entry of both their balls."""
    bits = F.explode(F.expr("sequence(0, 64)")).alias("i")
    entries = fps.select("fp", bits).select("fp", F.expr("if(i = 64, fp, fp ^ shiftleft(1L, i))").alias("entry"))
    least = entries.groupBy("entry").agg(F.min("fp").alias("dst"), F.max("fp").alias("most")).where("dst != most").drop("most")
    return entries.join(least, "entry").where("fp != dst").select(F.col("fp").alias("src"), "dst").where(f"bit_count(src ^ dst) <= {RADIUS}").distinct()


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(src, dst): edges that connect all distinct fingerprints (column fp) within two bits. None of a bucket's pairs is lost, however large it is."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = written(fps.select("fp").distinct().repartition(parts, "fp"), "segments")
    table = fps.select(F.explode(F.expr(f"array({_LOW}, {_HIGH})")).alias("key"), "fp")
    crowded = written(table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"), "crowded")
    probes = fps.select("fp", F.explode(F.expr("sequence(0, 65)")).alias("i"))
    probes = probes.select("fp", F.expr("i % 33").alias("bit"), F.expr(f"if(i < 33, {_LOW}, {_HIGH})").alias("own"))
    probes = probes.where("bit = 32 OR (own & shiftleft(1L, bit)) = 0").select("fp", F.expr("if(bit = 32, own, own | shiftleft(1L, bit))").alias("key"))
    fetched = probes.join(table.join(crowded, "key", "left_anti").toDF("key", "dst"), "key")
    near = fetched.where("fp != dst").where(f"bit_count(fp ^ dst) <= {RADIUS}").select(F.greatest("fp", "dst").alias("src"), F.least("fp", "dst").alias("dst"))
    if crowded.isEmpty():
        return near.distinct()
    inside = probes.join(crowded, "key").select("fp").distinct()
    return near.distinct().union(_met(inside.union(table.join(crowded, "key").select("fp")).distinct()))


def _grouped(docs: DataFrame, doc_id: str, text: str, width: int = 3) -> DataFrame:
    """near_duplicates' columns and root, the smallest fingerprint of the row's component: it names the component whatever its ids."""
    src = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(text).alias("text"))
    fps = written(fingerprints(src, "text", width), "fingerprints")
    least = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(least)).withColumnRenamed("node", "fp")
    grouped = least.join(roots, "fp")
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = grouped.join(named, "root").select("fp", "root", "component_id")
    by_fp = least.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    # from a table, so that this join has an exchange on both sides and a group of copies can be split
    return fps.join(written(by_fp, "named-fingerprints"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "key", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links), key (the row's).

    Null and empty texts, and texts of white space, have fingerprint zero and link like any other. Copies share a
    fingerprint and never become pairs. Rows that repeat come back as often. A null doc_id is never a component_id
    unless the component has no other. Other columns, whatever their names, are ignored. No rows: no rows.
    """
    return _grouped(docs, doc_id, text, width).drop("root")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of which each component keeps one, that with its smallest doc_id, null ids last. Ids may be null or shared by unlike texts."""
    order, name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"), fresh(docs.columns, "key")
    found = _grouped(docs, doc_id, text).groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.key").alias(name))
    kept = docs.withColumn(name, row_key(F.col(doc_id), F.col(text))).join(found, name, "left_semi")
    return kept.dropDuplicates([name]).select(*docs.columns)
