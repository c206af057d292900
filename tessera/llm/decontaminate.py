"""Benchmark decontamination with suffix arrays of the training text.

Each shard (a bounded block of documents) gets a suffix array over its words; every distinct window of the benchmark is
looked up in it by binary search, and so is every suffix that starts with a found one, which gives the longest verbatim
match of each place and where it lies: the longest one of a place is with the suffix just before or just after it. A window's
places are a range of the array and stay one, so that the work follows the words and not the pairs of equal places.
Matches that count have a window's length at least, so a shard's array only needs the stretches of so many consecutive words
that all occur in the benchmark; that loses no match. Words are equal if two hashes of 64 bits are. Shards are independent:
documents are read once and never shuffled. The benchmark is held in blocks of bounded size; more blocks mean more passes,
whose findings are merged by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels
from tessera.llm.shared import row_key, written

WINDOW, BLOCK_BYTES = 10, 8 << 20
#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD = 3 << 20
#: Words: runs of digits, letters a-z (after lower-casing A-Z) and whatever isn't ASCII.
MEMBER = np.zeros(256, bool)
MEMBER[ord("0") : ord("9") + 1] = MEMBER[ord("a") : ord("z") + 1] = MEMBER[128:] = True

FOUND = "n_words long, n_hit long, longest long, longest_item string, longest_at long, items array<string>, spans array<struct<start:long,end:long>>"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
_NAMES = ["n_words", "n_hit", "longest", "longest_item", "longest_at", "items", "spans"]


@dataclass
class Windows:
    """The distinct windows of one length, in the order of their words."""

    length: int
    at: np.ndarray  # where each window occurs first in the items' suffix array's order
    first: np.ndarray  # each window's first suffix in `suffixes` (and the end)
    suffixes: np.ndarray  # places that start with it
    owners: np.ndarray  # for each window the number of its set of items


@dataclass
class Items:
    """A block of benchmark items: word ids (from 1, in the order of the words' hashes) laid end to end."""

    names: list[str]
    vocabulary: np.ndarray
    check: np.ndarray
    filter: np.ndarray
    words: np.ndarray
    end: np.ndarray  # for each place the end of its item
    owner: np.ndarray
    rank: np.ndarray  # of each place's suffix
    sums: np.ndarray
    windows: list[Windows]
    sets: list[np.ndarray]  # sets of items


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes; the words' hashes, starts and ends; each text's first word (and the end)."""
    low = kernels.LOWER[data]
    starts, ends, first = kernels.runs(MEMBER[low], off)
    return low, kernels.span_hash(low, starts, ends), starts, ends, first


_BASE = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def prefix_sums(x: np.ndarray) -> np.ndarray:
    """Sums of which differences, brought to one power, are equal for equal stretches."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(kernels.mix(x.astype(np.uint64) + np.uint64(1)) * powers(len(x)), dtype=np.uint64)])


def common(x_sums: np.ndarray, at: np.ndarray, end: np.ndarray, y_sums: np.ndarray, to: np.ndarray, stop: np.ndarray, power: np.ndarray) -> np.ndarray:
    """How many words the stretches at:end of x and to:stop of y have in common from their starts, by binary search over their sums."""
    lo, hi = np.zeros(len(at), np.int64), np.minimum(end - at, stop - to)
    while (open_ := lo < hi).any():
        mid = (lo + hi + 1) >> 1
        same = (x_sums[at + mid] - x_sums[at]) * power[to] == (y_sums[to + mid] - y_sums[to]) * power[at]
        lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)
    return lo


def prepared(names: list[str], texts: list[str | None], window: int) -> Items:
    bodies = [(t or "").encode() for t in texts]
    off = np.cumsum([0, *map(len, bodies)])
    low, h, starts, ends, first = words_of(np.frombuffer(b"".join(bodies), np.uint8), off)
    vocabulary, where, ids = np.unique(h, return_index=True, return_inverse=True)
    check = kernels.span_hash(low, starts[where], ends[where], 1)
    table = np.zeros(1 << 20, bool)
    table[(vocabulary >> np.uint64(44)).astype(np.intp)] = True
    size = np.diff(first)
    owner, x = np.repeat(np.arange(len(size)), size), ids.astype(np.int64) + 1
    end = np.repeat(first[1:], size)
    order = suffix_array(x, end)
    rank = np.empty(len(x), np.int64)
    rank[order] = np.arange(len(x))
    number: dict[bytes, int] = {}
    sets, windows = [], []
    for w in sorted(set(np.minimum(size[size > 0], window).tolist())):
        ok = (order + w <= end[order]) & ((size[owner[order]] == w) if w < window else (size[owner[order]] >= window))
        suffixes = order[ok]
        new = np.zeros(len(suffixes), bool)
        new[:1] = True
        for j in range(w):
            new[1:] |= x[suffixes[1:] + j] != x[suffixes[:-1] + j]
        begin = np.append(np.flatnonzero(new), len(suffixes))
        owners = np.zeros(len(begin) - 1, np.int64)
        for g, (a, b) in enumerate(zip(begin.tolist(), begin[1:].tolist(), strict=False)):
            found = np.unique(owner[suffixes[a:b]])
            owners[g] = number.setdefault(found.tobytes(), len(sets))
            if owners[g] == len(sets):
                sets.append(found)
        windows.append(Windows(w, suffixes[begin[:-1]], begin, suffixes, owners))
    return Items(names, vocabulary, check, table, x, end, owner, rank, prefix_sums(x), windows, sets)


def suffix_array(x: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The suffixes of x in order, each up to the end of its stretch (end: for each place), by prefix doubling."""
    rank, k, longest = x.copy(), 1, int((end - np.arange(len(x))).max(initial=1))
    order = np.argsort(rank, kind="stable")
    while k < longest:
        after = np.zeros(len(x), np.int64)
        inside = np.flatnonzero(np.arange(len(x)) + k < end)
        after[inside] = rank[inside + k] + 1
        both = rank * (int(rank.max()) + 2 + len(x)) + after
        order = np.argsort(both, kind="stable")
        steps = np.diff(both[order]) > 0
        if steps.all():
            break
        rank[order] = np.concatenate([[0], np.cumsum(steps)])
        k *= 2
    return order


def interval(x: np.ndarray, end: np.ndarray, order: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pattern (a row of word ids) the range of suffixes in order that start with it, by binary search."""
    n, w = patterns.shape

    def bound(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(n, np.int64), np.full(n, len(order))
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            at = order[np.minimum(mid, len(order) - 1)]
            cells = at[:, None] + np.arange(w)
            have = np.where(cells < end[at][:, None], x[np.minimum(cells, len(x) - 1)], 0)
            differ = have != patterns
            where = differ.argmax(1)
            rows = np.arange(n)
            equal = ~differ[rows, where]
            less = np.where(equal, upper, have[rows, where] < patterns[rows, where])
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        return lo

    return bound(False), bound(True)


def ids_of(items: Items, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a shard: the benchmark's id of each word in a stretch that may hold a window, their places and stretches' ends (in the order of such words), and each text's first word."""
    low, h, starts, ends, first = words_of(data, off)
    none = np.zeros(0, np.int64)
    if not items.windows or not len(h):
        return none, none, none, first
    ids = np.zeros(len(h), np.int64)
    maybe = np.flatnonzero(items.filter[(h >> np.uint64(44)).astype(np.intp)])
    at = np.minimum(np.searchsorted(items.vocabulary, h[maybe]), len(items.vocabulary) - 1)
    ids[maybe] = np.where(items.vocabulary[at] == h[maybe], at + 1, 0)

    def stretches() -> tuple[np.ndarray, np.ndarray]:
        a, b, _ = kernels.runs(ids > 0, first)
        long = b - a >= items.windows[0].length
        return a[long], b[long]

    a, b = stretches()
    if not len(a):
        return none, none, none, first
    place = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange(int((b - a).sum()))
    other = kernels.span_hash(low, starts[place], ends[place], 1) != items.check[ids[place] - 1]
    if other.any():
        ids[place[other]] = 0
        a, b = stretches()
        place = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange(int((b - a).sum()))
    return ids[place], place, np.repeat(np.cumsum(b - a), b - a), first


def shard_matches(items: Items, x: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a shard's words in stretches (ids, ends): places where a window starts, the window's length and its set of items; then each place once, its longest match's length, and the suffix of the benchmark that it is with."""
    none = np.zeros(0, np.int64)
    if not len(x):
        return (none,) * 6
    order = suffix_array(x, end)
    present = np.zeros(len(items.vocabulary) + 2, bool)
    present[x] = True
    absent = np.concatenate([[0], np.cumsum(~present[items.words])])
    places, lengths, owners, tests = [], [], [], []
    for win in items.windows:
        some = np.flatnonzero(absent[win.at + win.length] == absent[win.at])
        if not len(some):
            continue
        lo, hi = interval(x, end, order, items.words[win.at[some][:, None] + np.arange(win.length)])
        hit = hi > lo
        some, lo, n = some[hit], lo[hit], (hi - lo)[hit]
        slots = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        places.append(order[slots])
        lengths.append(np.full(len(slots), win.length))
        owners.append(np.repeat(win.owners[some], n))
        of = np.diff(win.first)[some]
        tests.append(win.suffixes[np.repeat(win.first[some] - (np.cumsum(of) - of), of) + np.arange(int(of.sum()))])
    if not places:
        return (none,) * 6
    place, length, owner = (np.concatenate(c) for c in (places, lengths, owners))
    test = np.concatenate(tests)
    test = test[np.argsort(items.rank[test])]
    sums, power = prefix_sums(x), powers(max(len(x), len(items.words)) + 1)
    following = lambda values, at, stop: np.where(at < stop, values[np.minimum(at, len(values) - 1)], 0)
    lo, hi = np.zeros(len(test), np.int64), np.full(len(test), len(order))
    while (open_ := lo < hi).any():  # how many of the shard's suffixes come before each of the benchmark's
        mid = (lo + hi) >> 1
        at = order[np.minimum(mid, len(order) - 1)]
        n = common(sums, at, end[at], items.sums, test, items.end[test], power)
        less = following(x, at + n, end[at]) < following(items.words, test + n, items.end[test])
        lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    slot = np.empty(len(x), np.int64)
    slot[order] = np.arange(len(x))
    once = np.unique(place)
    near = np.searchsorted(lo, slot[once], "right") - 1
    longest, suffix = np.zeros(len(once), np.int64), np.zeros(len(once), np.int64)
    for step in (0, 1):
        k = near + step
        some = np.flatnonzero((k >= 0) & (k < len(test)))
        t, at = test[k[some]], once[some]
        n = common(sums, at, end[at], items.sums, t, items.end[t], power)
        better = n > longest[some]
        longest[some[better]], suffix[some[better]] = n[better], t[better]
    return place, length, owner, once, longest, suffix


def _scan(batches: Iterator[pa.RecordBatch], items: Items, window: int, n_rest: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[] for _ in _NAMES]
        for lo, hi, data, off in kernels.text_blocks(batch.column(n_rest), SHARD):
            x, where, end, first = ids_of(items, data, off)
            n = np.diff(first)
            rows[0] += n.tolist()
            place, length, owner, once, longest, suffix = shard_matches(items, x, end)
            marks = np.zeros(int(first[-1]) + 1, np.int64)
            np.add.at(marks, where[place], 1)
            np.add.at(marks, where[place] + length, -1)
            begin, finish, run_of = kernels.runs(np.cumsum(marks)[:-1] > 0, first)
            doc = np.searchsorted(first, where[place], "right") - 1
            sets = np.unique(doc * (len(items.sets) + 1) + owner)
            cut = np.searchsorted(sets, np.arange(hi - lo + 1) * (len(items.sets) + 1))
            at = where[once]
            doc = np.searchsorted(first, at, "right") - 1
            best = np.lexsort((at, -longest, doc))
            head = best[np.searchsorted(doc[best], np.arange(hi - lo))[np.diff(cut) > 0]]
            tops = iter(head.tolist())
            for i in range(hi - lo):
                if cut[i] == cut[i + 1]:
                    for r, v in zip(rows[1:], (0, 0, None, None, [], []), strict=True):
                        r.append(v)
                    continue
                spans = [{"start": int(a - first[i]), "end": int(b - first[i])} for a, b in zip(begin[run_of[i] : run_of[i + 1]], finish[run_of[i] : run_of[i + 1]], strict=True)]
                found = np.unique(np.concatenate([items.sets[k] for k in sets[cut[i] : cut[i + 1]] % (len(items.sets) + 1)]))
                top = next(tops)
                for r, v in zip(rows[1:], (sum(s["end"] - s["start"] for s in spans), int(longest[top]), items.names[items.owner[suffix[top]]], int(at[top] - first[i]), sorted({items.names[k] for k in found}), spans), strict=True):
                    r.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n_rest)] + [pa.array(r, t) for r, t in zip(rows, _TYPES, strict=True)], names=[*batch.schema.names[:n_rest], *_NAMES])


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[tuple[list[str], list[str | None]]]:
    names, texts, size = [], [], 0
    for row in benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")), F.col(text)).toLocalIterator():
        more = len((row[1] or "").encode())
        if names and size + more > limit:
            yield names, texts
            names, texts, size = [], [], 0
        names.append(row[0])
        texts.append(row[1])
        size += more
    yield names, texts


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each document: doc_id, key (the row's) and the columns of FOUND.

    spans: the words inside any occurrence of a window; items: the item_ids with an occurring window, sorted as strings;
    longest: the longest verbatim match in words, with its item and its place. Null and empty texts have no words and no
    hits; a null item_id reads "null"; items that share an item_id count once; repeated documents come back as often.
    An empty benchmark hits nothing. Other columns are ignored.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(text).alias("text"))
    schema = src.select("doc_id", "key").schema
    spark = docs.sparkSession
    full = spark.createDataFrame([], FOUND).schema
    for field in full:
        schema = schema.add(field)
    passes = []
    for names, texts in _blocks(benchmark, item_id, item_text, block_bytes):
        items = spark.sparkContext.broadcast(prepared(names, texts, window))
        passes.append(src.mapInArrow(lambda batches, items=items: _scan(batches, items.value, window, 2), schema))
    if len(passes) == 1:
        return passes[0]
    passes = [written(passes[0], "hits"), *(written(p.where("n_hit > 0"), "hits") for p in passes[1:])]
    hits = passes[0].where("n_hit > 0")
    for p in passes[1:]:
        hits = hits.unionByName(p)
    best = F.max(F.struct("longest", F.struct("longest_item", "longest_at").alias("where"))).alias("best")
    merged = hits.groupBy("key").agg(best, F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    joined = F.expr("""aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint>>), (acc, s) ->
        if(size(acc) > 0 and element_at(acc, -1).end >= s.start,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end)))),
           concat(acc, array(s))))""")
    merged = merged.withColumn("spans", joined).select("key", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_hit"), F.col("best.longest").alias("longest"), F.col("best.where.longest_item").alias("longest_item"), F.col("best.where.longest_at").alias("longest_at"), "items", "spans")
    base = passes[0].select("doc_id", "key", "n_words").join(merged, "key", "left")
    empty = {"n_hit": F.lit(0).cast("long"), "longest": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "spans": F.array().cast("array<struct<start:bigint,end:bigint>>")}
    return base.select("doc_id", "key", "n_words", *(F.coalesce(F.col(c), empty[c]).alias(c) if c in empty else F.col(c) for c in _NAMES[1:]))


def report(found: DataFrame) -> DataFrame:
    """The digest columns of matches()."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any occurrence of a benchmark window, with all their columns, whatever their names: a document stays where it is read, and nothing is shuffled."""
    at, spark = docs.columns.index(text), docs.sparkSession
    for names, texts in _blocks(benchmark, item_id, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(prepared(names, texts, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for lo, _, data, off in kernels.text_blocks(batch.column(at), SHARD):
                    x, where, end, first = ids_of(items, data, off)
                    place = shard_matches(items, x, end)[0]
                    keep[lo + np.searchsorted(first, where[place], "right") - 1] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
