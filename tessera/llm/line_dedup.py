"""Fuzzy line deduplication over a corpus.

Lines are normalised (A-Z lower-cased, digits to 0, white space collapsed) and equal ones become one node. Lines of fewer
than MIN_WORDS words keep their digits and only meet their equals.

A longer line's fingerprint is a row of SimHash blocks, each voted by some of its words of letters and digits (separators made unlike lines alike). Once the words are dealt to BLOCKS
blocks by their place, a fifth of the line to each, and once to CLASSES blocks by their hash. A word that is replaced, or that
has a letter more or less, touches one block of the first kind; a word that comes in or drops out touches one of the second,
where it moves no other word. So by the pigeonhole principle lines agree on some choice of blocks: of the places, on as many blocks as
hold about KEPT words (4 of 5 for lines under 14 words, one of 5 from 40 words on) unless more blocks than the others are touched;
of the classes, on all but one. Nodes are joined on every such choice, for places together with the number of words. Candidates
whose edit similarity is `similarity` or more are linked, and of each connected group the first occurrence stays.

A bucket never becomes all its pairs: one of two nodes is its pair. In a larger one every member first meets the smallest and
the largest node, which joins a group of copies in linear work. After those links are resolved, only members that aren't with
the bucket's smallest node meet the others in it, and only those of another component: no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels
from tessera.llm.components import components
from tessera.llm.filters import bit_filter, passes
from tessera.llm.shared import discarded, fresh, key_bits, row_key, written

MIN_WORDS, SIMILARITY = 5, 0.8
BLOCKS, CLASSES, KEPT = 5, 4, 8
#: Columns of a fingerprint: two blocks of 32 bits each; the last one's lower half has the choices of classes allowed and the number of words.
PARTS = [f"f{i}" for i in range(5)]
_COUNT = (1 << 28) - 1

_FOLD = kernels.LOWER.copy()
_FOLD[ord("0") : ord("9") + 1] = ord("0")
_DIGIT, _FEATURE = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = _FEATURE[ord("0") : ord("9") + 1] = _FEATURE[ord("a") : ord("z") + 1] = _FEATURE[128:] = True
_POWERS = kernels.mix(np.arange(1, 1 << 16, dtype=np.uint64)) | np.uint64(1)
_LOWER_TEXT = str.maketrans({chr(c): chr(kernels.LOWER[c]) for c in range(128)})
_FOLD_TEXT = str.maketrans({chr(c): chr(_FOLD[c]) for c in range(128)})


def normalised(line: str, min_words: int = MIN_WORDS) -> str:
    words = line.translate(_LOWER_TEXT).encode().split()
    text = b" ".join(words).decode()
    return text if len(words) < min_words else text.translate(_FOLD_TEXT)


def tag_of(key: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A hash for the filter of lines, from the row's key and the line's number."""
    return kernels.mix(key * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64)).view(np.int64)


def lines_of(folded: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words' starts, ends and first of each text; for each line with words: its first word (and the end), text and number."""
    starts, ends, first = kernels.runs(kernels.WORD[folded], off)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line = breaks[starts]
    new = np.ones(len(starts), bool)
    new[1:] = np.diff(line) > 0
    new[first[:-1][np.diff(first) > 0]] = True
    begin = np.append(np.flatnonzero(new), len(starts))
    text = np.searchsorted(first, begin[:-1], "right") - 1
    return starts, ends, begin, text, line[begin[:-1]] - breaks[off[text]]


def _any(member: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a word has a byte of the kind."""
    seen = np.zeros(len(data) + 1, np.int32)
    np.cumsum(member[data], out=seen[1:])
    return seen[ends] > seen[starts]


def nodes_of(data: np.ndarray, off: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each line with words: its text's number in the block, its number in the text, its node, a second hash of it, and its fingerprint's PARTS (zeros for lines with fewer than min_words words of letters or digits)."""
    low = kernels.LOWER[data]
    starts, ends, begin, text, number = lines_of(low, data, off)
    size = np.diff(begin)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros((0, len(PARTS)), np.int64)
    h = kernels.span_hash(low, starts, ends)
    numerals = np.flatnonzero(np.repeat(size >= min_words, size) & _any(_DIGIT, data, starts, ends))
    h[numerals] = kernels.span_hash(_FOLD[low], starts[numerals], ends[numerals])
    place = np.arange(len(h)) - np.repeat(begin[:-1], size)
    power = _POWERS[place % len(_POWERS)]
    lap = (place // len(_POWERS)).astype(np.uint64)
    node = kernels.mix(np.add.reduceat(h * power + lap, begin[:-1]) + size.astype(np.uint64))
    check = kernels.mix(np.add.reduceat((h ^ (h >> np.uint64(31))) * (power + np.uint64(2)) + lap, begin[:-1]))
    told = np.flatnonzero(_any(_FEATURE, low, starts, ends))
    first = np.searchsorted(told, begin)
    return text, number, node.view(np.int64), check.view(np.int64), fingerprints(h[told], first, np.diff(first) >= min_words)


def block_votes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The SimHash of each block of words. One that is no more than the hash of one of three or more words, which is then most of them, is that of their sum."""
    found = kernels.votes(h, first)
    size = np.diff(first)
    ruled = np.zeros(len(size) + 1, np.int64)
    same = np.flatnonzero((h & np.uint64(0xFFFFFFFF)) == np.repeat(found, size))
    np.add.at(ruled, np.searchsorted(first, same, "right") - 1, 1)
    one = np.flatnonzero((ruled[:-1] > 0) & (size > 2))
    if len(one):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kernels.mix(h), dtype=np.uint64)])
        found[one] = kernels.mix(sums[first[1:][one]] - sums[first[:-1][one]]) & np.uint64(0xFFFFFFFF)
    return found


def fingerprints(h: np.ndarray, begin: np.ndarray, long: np.ndarray) -> np.ndarray:
    """The PARTS of lines whose words' of letters or digits have the hashes h[begin[i]:begin[i + 1]]; zeros for those that aren't long."""
    size = np.diff(begin)
    cuts = begin[:-1, None] + size[:, None] * np.arange(BLOCKS) // BLOCKS
    blocks = list(block_votes(h, np.append(cuts.ravel(), begin[-1])).reshape(-1, BLOCKS).T)
    of, allowed = (h >> np.uint64(58)) % np.uint64(CLASSES), np.zeros(len(size), np.uint64)
    for c in range(CLASSES):
        at = np.flatnonzero(of == c)
        first = np.searchsorted(at, begin)
        held = np.diff(first)
        blocks.append((block_votes(h[at], first) + held.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF))
        rest = size - held
        allowed |= ((rest >= 3) & (2 * rest >= size)).astype(np.uint64) << np.uint64(28 + c)
    blocks.append(allowed | np.minimum(size, _COUNT).astype(np.uint64))
    out = np.stack([blocks[2 * i] << np.uint64(32) | blocks[2 * i + 1] for i in range(len(PARTS))], 1)
    out[~long] = 0
    return out.view(np.int64)


def occurrences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """key, doc_id, line, node, check and PARTS for each line with words, from documents with key, doc_id, text. One pass, no shuffle."""
    names = ["line", "node", "check", *PARTS]
    schema = docs.select("key", "doc_id", *(F.lit(0).cast("long").alias(c) for c in names)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, off in kernels.text_blocks(batch.column(2)):
                text, line, node, check, parts = nodes_of(data, off, min_words)
                at = pa.array(text + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x) for x in (line, node, check, *parts.T))], names=schema.names)

    return docs.select("key", "doc_id", "text").mapInArrow(run, schema)


def kept_blocks(words: int) -> int:
    """On how many blocks of places lines of so many words must agree: as many as hold about KEPT words."""
    return min(BLOCKS - 1, max(1, -(-BLOCKS * KEPT // words)))


def _choices(kept: int) -> list[tuple[int, ...]]:
    return list(combinations(range(BLOCKS), kept))


def bucket_arrays(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the bucket keys of long lines, from a row of PARTS for each: for each choice of blocks a hash of its number, the words' number (for places) and the blocks."""
    word = parts.view(np.uint64)
    block = [x for i in range(len(PARTS)) for x in (word[:, i] >> np.uint64(32), word[:, i] & np.uint64(0xFFFFFFFF))]
    words = word[:, -1] & np.uint64(_COUNT)
    kept = np.minimum(BLOCKS - 1, np.maximum(1, -(-BLOCKS * KEPT // np.maximum(words, np.uint64(1)).astype(np.int64))))
    rows, keys = [], []

    def add(at: np.ndarray, number: int, columns: list[np.ndarray]) -> None:
        h = np.full(len(at), number, np.uint64)
        for c in columns:
            h = kernels.mix(h * np.uint64(0x9E3779B97F4A7C15) + c[at])
        rows.append(at)
        keys.append(h)

    for k in range(1, BLOCKS):
        at = np.flatnonzero(kept == k)
        for i, chosen in enumerate(_choices(k) if len(at) else []):
            add(at, 100 * k + i, [words, *(block[b] for b in chosen)])
    for c in range(CLASSES):
        at = np.flatnonzero(word[:, -1] >> np.uint64(28 + c) & np.uint64(1))
        if len(at):
            add(at, c, [block[BLOCKS + b] for b in range(CLASSES) if b != c])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def edits_within(a: str, b: str, limit: int) -> bool:
    """Whether the edit distance is at most limit: common ends cut off, then Myers's bit-parallel columns on whole integers, unless words that differ in their places settle it."""
    if abs(len(a) - len(b)) > limit:
        return False
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) and sum(max(len(v), len(w)) for v, w in zip(x, y, strict=True) if v != w) <= limit:
        return True

    def common(n: int, same) -> int:
        lo, hi = 0, n
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if same(mid) else (lo, mid - 1)
        return lo

    k = common(min(len(a), len(b)), lambda n: a[:n] == b[:n])
    a, b = a[k:], b[k:]
    k = common(min(len(a), len(b)), lambda n: n == 0 or a[-n:] == b[-n:])
    a, b = (a[:-k], b[:-k]) if k else (a, b)
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if len(b) <= limit or m == 0:
        return len(b) <= limit
    full, top, where = (1 << m) - 1, 1 << (m - 1), {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    up, down, distance, left = full, 0, m, len(b)
    for c in b:
        x = where.get(c, 0) | down
        d = (((x & up) + up) ^ up) | x
        plus, minus = down | (full & ~(up | d)), up & d
        left -= 1
        if plus & top:
            distance += 1
        elif minus & top:
            distance -= 1
        if distance - left > limit:
            return False
        plus = (plus << 1 | 1) & full
        up, down = (minus << 1 | (full & ~(plus | d))) & full, plus & d
    return distance <= limit


def _similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough."""
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [edits_within(x, y, int((1 - similarity) * max(len(x), len(y)) + 1e-9)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["src", "dst"])

    return both.mapInArrow(run, "src long, dst long")


def _texts(docs: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """node, text (normalised) for wanted (node, key, line), from one pass over the documents; filters of fixed size spare most documents the work and most other lines the shuffle."""
    spark = docs.sparkSession

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = key_bits(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(tag_of(key, batch.column(1).to_numpy()))], names=["row", "tag"])

    asked = wanted.select("key", "line").mapInArrow(hashed, "row long, tag long")
    rows, tags = (spark.sparkContext.broadcast(bit_filter(asked, c)) for c in ("row", "tag"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(rows.value, key_bits(batch.column(0)).view(np.int64))))
            keys = key_bits(batch.column(0))
            for lo, _, data, off in kernels.text_blocks(batch.column(1)):
                _, _, _, text, line = lines_of(data, data, off)
                hit = np.flatnonzero(passes(tags.value, tag_of(keys[text + lo], line)))
                text, line = text[hit], line[hit]
                out, now, lines = [], -1, []
                for i, k in zip(text.tolist(), line.tolist(), strict=True):
                    if i != now:
                        now, lines = i, data[off[i] : off[i + 1]].tobytes().decode().split("\n")
                    out.append(normalised(lines[k], min_words))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + lo)), pa.array(line), pa.array(out, pa.string())], names=["key", "line", "text"])

    found = docs.select("key", "text").mapInArrow(run, "key binary, line long, text string")
    return found.join(wanted, ["key", "line"]).groupBy("node").agg(F.min("text").alias("text"))


def groups(docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """(node, root) of all nodes that are linked to another. nodes: node, key and line (of one occurrence), PARTS; docs: key, text."""
    spark = nodes.sparkSession
    fuzzy = nodes.where(f"({PARTS[-1]} & {_COUNT}L) >= {min_words}").select("node", *PARTS)

    def entries(batches: Iterator[pa.RecordBatch], mask=None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            row, key = bucket_arrays(np.stack([c.to_numpy() for c in batch.columns[1:]], 1))
            if mask is not None:
                hit = passes(mask.value, key)
                row, key = row[hit], key[hit]
            yield pa.RecordBatch.from_arrays([pa.array(node[row]), pa.array(key)], names=["node", "bucket"])

    table = fuzzy.mapInArrow(entries, "node long, bucket long")
    shared = written(table.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low != high"), "shared-buckets")
    large = shared.where("n > 2").select("bucket", "low", "high")
    mask = spark.sparkContext.broadcast(bit_filter(large, "bucket"))
    members = written(fuzzy.mapInArrow(lambda batches: entries(batches, mask), "node long, bucket long").join(large, "bucket"), "buckets")
    ends = members.select("node", F.explode(F.array("low", "high")).alias("end")).where("node != end")
    pair = [F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")]
    pairs = written(ends.select(*pair).union(shared.where("n = 2").select("low", "high")).distinct(), "pairs")
    asked = members.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    wanted = written(nodes.select("node", "key", "line").join(asked, "node"), "wanted")
    texts = written(_texts(docs, wanted, min_words), "lines")
    links = written(_similar(pairs, texts, similarity), "links")
    roots = written(components(links), "roots")
    crowd = members.select("bucket", "node", "low").join(roots, "node", "left").select("bucket", "node", "low", F.coalesce("root", "node").alias("root"))
    lows = roots.select(F.col("node").alias("low"), F.col("root").alias("low_root"))
    crowd = written(crowd.join(lows, "low", "left").withColumn("apart", F.expr("root != coalesce(low_root, low)")), "crowd")
    apart = crowd.where("apart").select("bucket", F.col("node").alias("end"), F.col("root").alias("end_root"))
    more = crowd.join(apart, "bucket").where("root != end_root").select(*pair).distinct().join(pairs, ["a", "b"], "left_anti")
    more = written(_similar(more, texts, similarity), "links")
    found = roots if more.isEmpty() else components(roots.toDF("src", "dst").union(more))
    discarded(shared, members, pairs, wanted, texts, links, crowd, more)
    return found


def dropped_lines(docs: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """key, flags, n: for each row that loses lines, a byte for each line up to the last of them (1: it goes), and their number. docs: key, doc_id, text.

    Equal lines are those with equal hashes of 128 bits: where two unlike lines share a node, which needs about 10**10 lines, all of them stay.
    """
    lines = written(occurrences(docs, min_words), "occurrences")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "line")
    same = [F.min(p).alias(p) for p in PARTS]
    found = lines.groupBy("node").agg(F.min(order).alias("o"), F.count("*").alias("n"), F.min("check").alias("check"), F.max("check").alias("other"), *same)
    nodes = written(found.where("check = other").select("node", "n", "o", F.col("o.key").alias("key"), F.col("o.line").alias("line"), *PARTS), "nodes")
    named = nodes.select("node", "n", "o").join(groups(docs, nodes, similarity, min_words), "node", "left")
    linked = written(named.where("root IS NOT NULL"), "linked")
    first = written(linked.groupBy("root").agg(F.min("o").alias("first")), "first")
    stays = linked.join(first, "root").select("node", "first").union(named.where("root IS NULL AND n > 1").select("node", F.col("o").alias("first")))
    gone = lines.select("key", "line", "node").join(stays, "node").where("key != first.key OR line != first.line")
    gone = gone.groupBy("key").agg(F.collect_set("line").alias("lines"))

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = []
            for lines in batch.column(1).to_pylist():
                flag = bytearray(max(lines) + 1)
                for k in lines:
                    flag[k] = 1
                flags.append(bytes(flag))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flags, pa.binary()), pa.array([sum(f) for f in flags], pa.int64())], names=["key", "flags", "n"])

    return gone.mapInArrow(flagged, "key binary, flags binary, n long")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: bool = True, **how) -> DataFrame:
    """The documents with the text that is left, and (with counts) n_lines and n_dropped.

    Lines are separated by line feeds. Blank ones always stay; those with fewer than min_words words go only if they are equal to
    an earlier one but for case and white space. Of each group the occurrence with the smallest (doc_id, line) stays, null ids
    last. Rows that repeat id and text are one document that comes back as often. Null texts stay null with no lines. No rows:
    no rows. Columns named like the two new ones are replaced; without counts all columns come back, whatever their names.
    """
    rest = [c for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    key, flags, n = (fresh(docs.columns, c) for c in ("key", "flags", "n"))
    keyed = docs.select(*rest, row_key(F.col(doc_id), F.col(text)).alias(key))
    src = keyed.select(F.col(key).alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    lost = dropped_lines(src, **how).toDF(key, flags, n)
    joined = keyed.join(lost, key, "left")
    lines = F.split(F.col(text), "\n", -1)
    left = F.array_join(F.filter(lines, lambda _, i: F.coalesce(F.substring(flags, i + 1, F.lit(1)) != F.lit(b"\x01"), F.lit(True))), "\n")
    kept = [F.when(F.col(flags).isNull(), F.col(c)).otherwise(left).alias(c) if c == text else F.col(c) for c in rest]
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return joined.select(*kept, *((n_lines.alias("n_lines"), F.coalesce(n, F.lit(0)).cast("long").alias("n_dropped")) if counts else ()))
