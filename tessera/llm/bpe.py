"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Code points become classes (letter, number, space, other white space, the rest, and apostrophes that would start
's 't 'm 'd 're 've 'll), and a class is a transition of an eight-state machine. Transitions compose associatively:
the machine's finite monoid is enumerated once, so that the state before every code point comes from a blocked scan
of small integers over a whole block of texts, without a regular expression. States and classes give the boundaries;
white space looks one code point ahead. The slices between boundaries go through a cache of merged pieces; token
offsets are kept, and decoding by them restores any byte range.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernels

L, N, S, W, O, A2, A3 = range(7)
FRESH, IN_L, IN_N, IN_O, AFTER_S, AFTER_W, NEED1, NEED2 = range(8)
#: What the pre-tokeniser's pattern takes after an apostrophe.
SHORT, LONG = "stmd", ("re", "ve", "ll")
CACHED_PIECES, SHORT_PIECE, STEP = 125_000, 40, 256


def members(pattern: str) -> np.ndarray:
    """The code points that match a one-character pattern, by the library's own tables: a match comes out as its bytes, the rest doesn't."""
    spell = tiktoken.Encoding("members", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    points = "".join(map(chr, chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))
    return np.frombuffer(bytes(spell.encode_ordinary(points)).decode().encode("utf-32-le"), np.uint32)


@cache
def class_table() -> np.ndarray:
    """Each code point's class, by the version of Unicode that tiktoken has."""
    table = np.full(sys.maxunicode + 1, O, np.uint8)
    for pattern, kind in ((r"\p{L}", L), (r"\p{N}", N), (r"\s", W), (r"\x20", S)):
        table[members(pattern)] = kind
    return table


def _step(state: int, kind: int) -> int:
    if kind == L:
        return {NEED1: FRESH, NEED2: NEED1}.get(state, IN_L)
    if kind in (A2, A3):
        return IN_O if state in (IN_O, AFTER_S) else NEED1 if kind == A2 else NEED2
    return {N: IN_N, S: AFTER_S, W: AFTER_W, O: IN_O}[kind]


@cache
def machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """generator (class -> function), compose (function, function -> function), apply (function, state -> state), step (class, state -> state), split (class, state -> boundary before it).

    Classes from 8 on are those of a text's first code point: they forget the state before.
    """
    step = np.array([[_step(s if k < 8 else FRESH, k % 8) if k % 8 < 7 else 0 for s in range(8)] for k in range(16)], np.uint8)
    functions: dict[tuple, int] = {}
    queue = [tuple(range(8)), *map(tuple, step.tolist())]
    for f in queue:
        if f not in functions:
            functions[f] = len(functions)
            queue += [tuple(int(step[k][s]) for s in f) for k in range(16)]
    names = list(functions)
    compose = np.array([[functions[tuple(g[s] for s in f)] for g in names] for f in names], np.int32)
    joins = {L: (IN_L, AFTER_S, NEED1, NEED2), N: (IN_N, AFTER_S), O: (IN_O, AFTER_S), A2: (IN_O, AFTER_S), A3: (IN_O, AFTER_S), S: (AFTER_S, AFTER_W), W: (AFTER_S, AFTER_W)}
    split = np.array([[k >= 8 or s not in joins.get(k, ()) for s in range(8)] for k in range(16)])
    return np.array([functions[tuple(f)] for f in step.tolist()], np.int32), compose, np.array(names, np.uint8), step, split


def states_before(kinds: np.ndarray) -> np.ndarray:
    """The machine's state before each code point, by a blocked associative scan."""
    generator, compose, apply, step, _ = machine()
    n = len(kinds)
    rows = -(-n // STEP)
    grid = np.zeros(rows * STEP, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, STEP).T)
    flat, width = compose.ravel(), compose.shape[1]
    total = generator[grid[0]]
    for j in range(1, STEP):
        total = flat[total * width + generator[grid[j]]]
    hop = 1
    while hop < rows:  # inclusive scan of the rows' functions
        total = np.concatenate([total[:hop], flat[total[:-hop] * width + total[hop:]]])
        hop *= 2
    state = np.concatenate([[FRESH], apply[total[:-1], FRESH]]).astype(np.uint8)
    out = np.empty_like(grid)
    lookup = step.ravel()
    for j in range(STEP):
        out[j] = state
        state = lookup[(grid[j].astype(np.intp) << 3) | state]
    return out.T.ravel()[:n]


def boundaries(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces start, in bytes; a piece ends where the next starts."""
    head = (data & 0xC0) != 0x80
    at = np.flatnonzero(head)
    n = len(at)
    if not n:
        return at
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kinds = class_table()[points]
    starts = np.zeros(n + 1, bool)
    starts[n] = True
    starts[np.searchsorted(at, off[:-1][np.diff(off) > 0])] = True
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        padded, fence = np.append(points, [0, 0]), np.append(starts, [True])
        one, two, same1 = padded[quote + 1], padded[quote + 2], ~starts[quote + 1]
        same2 = same1 & ~fence[np.minimum(quote + 2, n + 1)]
        kinds[quote[same1 & np.isin(one, [ord(c) for c in SHORT])]] = A2
        long = np.zeros(len(quote), bool)
        for a, b in LONG:
            long |= (one == ord(a)) & (two == ord(b))
        kinds[quote[same2 & long]] = A3
    white = (kinds == S) | (kinds == W)
    coded = kinds + np.where(starts[:n], 8, 0).astype(np.uint8)
    split = machine()[4][coded, states_before(coded)]
    after = np.zeros(n, bool)
    after[:-1] = ~white[1:] & ~starts[1:n]
    return at[split | (white & after)]


class Codec:
    """Ranks (bytes -> id) and a bounded cache of merged pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.bytes_of[i] = piece
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        outer = self

        class Pieces(dict):
            before: dict = {}  # what the cache held when it was last full: frequent pieces come back from there

            def __missing__(self, piece: bytes) -> tuple[int, ...]:
                if len(self) >= CACHED_PIECES:
                    self.before = dict(self)
                    self.clear()
                ids = self.before.get(piece)
                if ids is None:
                    ids = outer.merged(piece)
                if len(piece) <= 64:
                    self[piece] = ids
                return ids

        self.pieces = Pieces()

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Joins the adjacent pair of lowest rank, the leftmost first, until no pair has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        n = len(piece)
        if n <= SHORT_PIECE:  # a few pairs are looked through faster than a heap is kept
            get, never = ranks.get, len(self.length)
            parts, pairs = [piece[i : i + 1] for i in range(n)], [get(piece[i : i + 2], never) for i in range(n - 1)]
            while pairs and (r := min(pairs)) < never:
                i = pairs.index(r)
                joined = parts[i] + parts.pop(i + 1)
                parts[i] = joined
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = get(joined + parts[i + 1], never)
                if i:
                    pairs[i - 1] = get(parts[i - 1] + joined, never)
            return tuple(map(ranks.__getitem__, parts))
        stop, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (j := stop[i]) >= n or stop[j] != end:
                continue
            alive[j] = False
            stop[i] = end
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : stop[end]])) is not None:
                    heapq.heappush(heap, (r, i, stop[end]))
            if (k := before[i]) >= 0 and (r := ranks.get(piece[k:end])) is not None:
                heapq.heappush(heap, (r, k, end))
        return tuple(ranks[piece[i : stop[i]]] for i in range(n) if alive[i])

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The ids of a block, and where each text's begin (and the last end)."""
        start = boundaries(data, off)
        whole = data.tobytes()
        edges = [*start.tolist(), len(whole)]
        nested = [self.pieces[whole[a:b]] for a, b in zip(edges, edges[1:])]  # noqa: B905, RUF007
        count = np.zeros(len(nested) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, nested), np.int64, len(nested)), out=count[1:])
        return list(chain.from_iterable(nested)), count[np.searchsorted(start, off)]

    def forget(self) -> None:
        """Empties the cache, at the end of a task: a worker that goes on to other work doesn't keep it."""
        self.pieces.clear()
        self.pieces.before = {}

    def offsets(self, ids: list[int]) -> np.ndarray:
        """Where each token starts in its text's bytes, and where the last ends."""
        return np.concatenate([[0], np.cumsum(self.length[ids])]) if len(ids) else np.zeros(1, np.int64)

    def decode(self, ids: list[int], offsets: np.ndarray | None = None, lo: int = 0, hi: int | None = None) -> bytes:
        """The bytes of the ids; with offsets, only bytes lo to hi, from the tokens that cover them."""
        if offsets is None:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        hi = int(offsets[-1]) if hi is None else hi
        a, b = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))
        base = int(offsets[max(a, 0)])
        return b"".join(map(self.bytes_of.__getitem__, ids[max(a, 0) : b]))[lo - base : hi - base]


@cache
def codec(ranks_file: bytes) -> Codec:
    return Codec({base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)})


def ranks_file(path: str | None = None) -> bytes:
    """The rank file's bytes (a vocabulary of fixed size, so it may be broadcast); the default is the one for many languages."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def _shared(spark: SparkSession, path: str | None):
    return spark.sparkContext.broadcast(ranks_file(path))


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """The other columns, ids array<int> and offsets array<long> (each token's first byte, then the length). Null: no ids."""
    rest, ranks = [c for c in docs.columns if c not in (text, "ids", "offsets")], _shared(docs.sparkSession, path)
    schema = docs.select(*rest, F.array().cast("array<int>").alias("ids"), F.array().cast("array<bigint>").alias("offsets")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value)
        for batch in batches:
            ids, offsets = [], []
            for lo, hi, data, off in kernels.text_blocks(batch.column(len(rest))):
                flat, first = own.encode(data, off)
                ids += [flat[first[i] : first[i + 1]] for i in range(hi - lo)]
                offsets += [own.offsets(x) for x in ids[-(hi - lo) :]]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(rest))] + [pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int64()))], names=[*rest, "ids", "offsets"])
        own.forget()

    return docs.select(*rest, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """The other columns and decoded, the bytes of the ids. Null ids: null."""
    rest, ranks = [c for c in encoded.columns if c not in (ids, "decoded")], _shared(encoded.sparkSession, path)
    schema = encoded.select(*rest, F.lit(b"").alias("decoded")).schema
    schema["decoded"].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value)
        for batch in batches:
            out = [None if x is None else own.decode(x) for x in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(rest))] + [pa.array(out, pa.binary())], names=[*rest, "decoded"])

    return encoded.select(*rest, ids).mapInArrow(run, schema)


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_bytes (the last offset): encodes each text and decodes its ids, in one pass.

    Null and empty texts have no tokens. Rows that repeat come back as often; other columns are ignored.
    """
    ranks = _shared(docs.sparkSession, path)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = src.select("doc_id", F.expr("cast(0 as bigint) n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256"), F.expr("cast(0 as bigint) n_bytes")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = codec(ranks.value), hashlib.sha256
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for lo, hi, data, off in kernels.text_blocks(batch.column(1), 1 << 20):
                flat, first = own.encode(data, off)
                spelled = list(map(own.decimal.__getitem__, flat))
                ends = np.zeros(len(flat) + 1, np.int64)
                np.cumsum(own.length[flat] if flat else [], out=ends[1:])
                for i in range(hi - lo):
                    a, b = int(first[i]), int(first[i + 1])
                    rows[0].append(b - a)
                    rows[1].append(sha(",".join(spelled[a:b]).encode()).hexdigest())
                    rows[2].append(sha(own.decode(flat[a:b])).hexdigest())
                    rows[3].append(int(ends[b] - ends[a]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int64())], names=schema.names)
        own.forget()

    return src.mapInArrow(run, schema)
