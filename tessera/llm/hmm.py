"""A hidden Markov language model.

Corpus counts of every word are exact: summed by partition, then by word, in a table. The model's symbols are the OWN most
frequent words, one each, and BUCKETS classes that share the other words by hash; a word of a class has a
probability in it from its count. The training texts, each whole, are written once as symbols, in SLICES by a hash of the text.
Baum-Welch starts from the counts of all words and goes over the slices in turn: a step replaces one slice's expected counts, summed over its
tasks, in the sum of all slices' and fits the model to that sum (incremental EM), so that a sweep over the corpus fits the model
SLICES times. Sweeps go on until the likelihood of all training texts settles. What a step brings to the driver are as many numbers as the model has. A text's
likelihood is the exact, scaled forward recursion over all its tokens. The counts of the most frequent words, FAST at most, go
along with the model (a fixed size); those of all others are looked up by a join on the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels
from tessera.llm.shared import written
from tessera.plans.storage import new_path

STATES, OWN, BUCKETS, FAST = 6, 4096, 512, 1 << 16
#: Baum-Welch ends after a sweep over all SLICES that raises the training texts' log-likelihood by less than this share of it.
SLICES, SETTLED = 8, 5e-4
#: Tokens that are worked on at once; a longer text is worked on alone.
POOL = 3 << 19
FOLDS, OUT = 7, 2
HELD_ENTRIES = 1 << 20


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves OUT; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == OUT


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes (signed) and each text's first word (and the end)."""
    low = kernels.LOWER[data]
    starts, ends, first = kernels.runs(kernels.WORD[low], off)
    return kernels.span_hash(low, starts, ends).view(np.int64), first


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (its hash), n: exact counts over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(words, kind="stable")
            words, n = words[order], n[order]
            cut = np.flatnonzero(np.diff(words, prepend=words[:1] - 1) != 0) if len(words) else words
            return words[cut], np.add.reduceat(n, cut) if len(cut) else n

        for batch in batches:
            for _, _, data, off in kernels.text_blocks(batch.column(0)):
                held.append(np.unique(tokens(data, off)[0], return_counts=True))
                if sum(len(w) for w, _ in held) > HELD_ENTRIES:
                    held = [merged()]
                    if len(held[0][0]) > HELD_ENTRIES // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["word", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["word", "n"])

    return docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Symbols and counts: fast words sorted by hash with their counts and symbols (-1: by bucket)."""

    words: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    filter: np.ndarray
    log_rest: np.ndarray  # log10 of N_b + V_b + 1 for each bucket
    total: int  # N
    distinct: int  # V
    texts: int
    seen: np.ndarray  # how often each symbol occurs, the end included

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, count) of each word; count -1: not among the fast ones."""
        symbol = (OWN + (words.view(np.uint64) % np.uint64(BUCKETS))).astype(np.int32)
        count = np.full(len(words), -1, np.int64)
        if len(self.words):
            maybe = np.flatnonzero(self.filter[words.view(np.uint64) >> np.uint64(42)])
            at = np.minimum(np.searchsorted(self.words, words[maybe]), len(self.words) - 1)
            same = self.words[at] == words[maybe]
            maybe, at = maybe[same], at[same]
            count[maybe] = self.counts[at]
            own = self.symbols[at] >= 0
            symbol[maybe[own]] = self.symbols[at[own]]
        return symbol, count


END = OWN + BUCKETS
SYMBOLS = END + 1


def lexicon(counts: DataFrame, texts: int) -> Lexicon:
    bucket = F.expr(f"pmod(pmod(word, {BUCKETS}) + {BUCKETS}, {BUCKETS})")  # 2**64 is a multiple of BUCKETS, so signs don't matter
    sums = counts.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    # counts fall into a few thousand classes in their order; the fast words are whole classes from the top and, by hash, the part of the
    # next one that there is room for, so no task gathers candidates
    rank_of = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(F.log2("n") * 64))
    cut, part, room = -1, 0, FAST
    for r in sorted(counts.groupBy(rank_of.alias("c")).agg(F.count("*").alias("v")).collect(), key=lambda r: -r.c):
        if r.v > room:
            cut, part = r.c, int(room / r.v * (1 << 20) * 0.95)
            break
        room -= r.v
    top = counts.where((rank_of > cut) | (rank_of == cut) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < part)).toArrow()
    words, n = (np.asarray(top.column(c).to_numpy()) for c in ("word", "n"))
    n_b, v_b = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in sums:
        n_b[r.b], v_b[r.b] = r.n, r.v
    total, distinct = int(n_b.sum()) + texts, int(v_b.sum()) + bool(texts)
    rank = np.lexsort((words, -n))[:OWN]
    own_bucket = (words[rank].view(np.uint64) % np.uint64(BUCKETS)).astype(np.int64)
    np.subtract.at(n_b, own_bucket, n[rank])
    np.subtract.at(v_b, own_bucket, 1)
    symbols = np.full(len(words), -1, np.int32)
    symbols[rank] = np.arange(len(rank))
    order = np.argsort(words)
    table = np.zeros(1 << 22, bool)
    table[words.view(np.uint64) >> np.uint64(42)] = True
    seen = np.zeros(SYMBOLS)
    seen[: len(rank)], seen[OWN:END], seen[END] = n[rank], n_b, texts
    return Lexicon(words[order], n[order], symbols[order], table, np.log10(n_b + v_b + 1.0), total, distinct, texts, seen)


@dataclass
class Model:
    start: np.ndarray  # (K,)
    move: np.ndarray  # (K, K)
    emit: np.ndarray  # (SYMBOLS + 1, K); the last row, of ones, is padding

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        emit = emit[:SYMBOLS] + 0.05
        return Model((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(1, keepdims=True), np.vstack([emit / emit.sum(0), np.ones(emit.shape[1])]))


def sequences(lex: Lexicon, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """symbols with an END after each text, each text's first (and the end), and symbol and count of each word."""
    symbol, count = lex.look_up(words)
    n_docs = len(first) - 1
    begin = first + np.arange(n_docs + 1)
    flat = np.full(len(words) + n_docs, END, np.int32)
    inside = np.ones(len(flat), bool)
    inside[begin[1:] - 1] = False
    flat[inside] = symbol
    return flat, begin, symbol, count


def summed(model: Model, flat: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch's expected counts (start, move, emit) of whole texts, and their log-likelihood. Cells are laid out by time, then text, longest first."""
    k = len(model.start)
    size = np.diff(begin)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((SYMBOLS + 1, k))
    order = np.argsort(-size, kind="stable")
    at, n = begin[:-1][order], size[order]
    if not len(n) or not n[0]:
        return start, move, emit, 0.0
    a, e = model.move.astype(np.float32), model.emit.astype(np.float32)
    live = np.searchsorted(-n, -np.arange(int(n[0])), "left")  # texts longer than t
    edges = np.concatenate([[0], np.cumsum(live)])
    time = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    cell = edges[time] + np.repeat(np.arange(len(n)), n)
    symbols = np.empty(len(cell), np.int32)
    symbols[cell] = flat[np.repeat(at, n) + time]
    seen = e[symbols]
    alpha, scale = np.empty_like(seen), np.empty((len(cell), 1), np.float32)
    cuts = edges.tolist()
    now = None
    for t, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        now = (now[: hi - lo] @ a if t else model.start.astype(np.float32)) * seen[lo:hi]
        c = now.sum(1, keepdims=True)
        now /= c
        alpha[lo:hi], scale[lo:hi] = now, c
    seen /= scale
    beta = np.ones((len(cell), k), np.float32)
    back = np.ascontiguousarray(a.T)
    for t in range(len(live) - 1, 0, -1):
        lo, hi = cuts[t], cuts[t + 1]
        after = beta[lo:hi] * seen[lo:hi]
        before = cuts[t - 1]
        move += alpha[before : before + hi - lo].T @ after
        beta[before : before + hi - lo] = after @ back
    alpha *= beta
    start += alpha[: cuts[1]].sum(0, dtype=float)
    for s in range(k):
        emit[:, s] += np.bincount(symbols, alpha[:, s], SYMBOLS + 1)
    return start, move * model.move, emit, float(np.log(scale, dtype=float).sum())


def expected(model: Model, flat: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch's expected counts (start, move, emit)."""
    return summed(model, flat, begin)[:3]


def log_likelihood(model: Model, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Natural log-probability of each symbol sequence, by the scaled forward recursion, many texts at a time."""
    size = np.diff(begin)
    order = np.argsort(-size, kind="stable")
    at, n = begin[:-1][order], size[order]
    out = np.zeros(len(order))
    if not len(order):
        return out
    now, product = model.start * model.emit[flat[at]], np.ones(len(order))
    live = np.searchsorted(-n, -np.arange(int(n[0]) + 1), "left")  # texts longer than t
    for t in range(int(n[0])):
        m = int(live[t])
        if t:
            now = (now[:m] @ model.move) * model.emit[flat[at[:m] + t]]
        c = now.sum(1)
        now /= c[:, None]
        product[:m] *= c
        if t % 16 == 15:
            out[:m] += np.log(product[:m])
            product[:m] = 1.0
    out += np.log(product)
    back = np.empty_like(out)
    back[order] = out
    return back


def first_model(lex: Lexicon) -> Model:
    """Where Baum-Welch starts: the counts of all symbols, perturbed for each state."""
    if not lex.texts:
        return Model.from_counts(np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((SYMBOLS, STATES)))
    spread = np.exp(np.random.default_rng(7).normal(0, 0.7, (SYMBOLS, STATES)))
    return Model.from_counts(np.ones(STATES), np.eye(STATES) * 200, lex.seen[:, None] * spread)


def symbol_table(docs: DataFrame, lex: Lexicon, text: str = "text") -> list[DataFrame]:
    """symbols (16-bit numbers, END last) of each text, as a table for each slice."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in kernels.text_blocks(batch.column(1)):
                flat, begin, _, _ = sequences(shared.value, *tokens(data, off))
                edges = pa.array(begin * 2, pa.int32()).buffers()[1]
                symbols = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, edges, pa.py_buffer(flat.astype("<i2").tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), symbols], names=["slice", "symbols"])

    slice_of = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(SLICES)).cast("int")
    table = docs.select(slice_of.alias("slice"), F.col(text).alias("text")).mapInArrow(run, "slice int, symbols binary")
    path = new_path(spark, "symbols")
    table.write.partitionBy("slice").parquet(path)
    return [spark.read.schema("symbols binary, slice int").parquet(path).where(F.col("slice") == i).select("symbols") for i in range(SLICES)]


def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(symbols, each text's first and the end) of about POOL tokens at a time."""
    flats, begins, at = [], [], 0
    for batch in batches:
        for _, _, data, off in kernels.text_blocks(batch.column(0), POOL // 4):
            flat, begin = data.view("<i2"), off // 2
            if flats and at + len(flat) > POOL:
                yield np.concatenate(flats), np.append(np.concatenate(begins), at)
                flats, begins, at = [], [], 0
            flats.append(flat)
            begins.append(begin[:-1] + at)
            at += len(flat)
    if flats:
        yield np.concatenate(flats), np.append(np.concatenate(begins), at)


def counted(symbols: DataFrame, model: Model) -> np.ndarray:
    """The expected counts of all the texts, a row for each cell of the model: start, move, emit, and their log-likelihood."""
    shared = symbols.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for flat, begin in pooled(batches):
            found = summed(shared.value, flat, begin)
            total = found if total is None else tuple(x + y for x, y in zip(total, found, strict=True))
        if total is not None:
            cells = np.vstack([total[0][None], total[1], total[2][:SYMBOLS], np.full((1, STATES), total[3])])
            some = np.flatnonzero(cells.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(cells[some, s]) for s in range(STATES))], names=["cell", *(f"s{s}" for s in range(STATES))])

    sums = symbols.mapInArrow(run, "cell long, " + ", ".join(f"s{s} double" for s in range(STATES))).groupBy("cell").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(STATES))).toArrow()
    shared.destroy()
    cells = np.zeros((2 + STATES + SYMBOLS, STATES))
    cells[sums.column("cell").to_numpy()] = np.column_stack([sums.column(f"s{s}").to_numpy() for s in range(STATES)])
    return cells


def train(docs: DataFrame, lex: Lexicon, text: str = "text", sweeps: list[float] | None = None) -> Model:
    """Baum-Welch over all the texts, slice by slice, until a sweep hardly raises their log-likelihood (appended to sweeps)."""
    model = first_model(lex)
    if not lex.texts:
        return model
    slices = symbol_table(docs, lex, text)
    held, last = [np.zeros((2 + STATES + SYMBOLS, STATES))] * SLICES, -np.inf
    while True:
        for i, part in enumerate(slices):
            held[i] = counted(part, model)
            total = np.sum(held, 0)
            model = Model.from_counts(total[0], total[1 : 1 + STATES], total[1 + STATES : -1])
        likely = float(sum(cells[-1, 0] for cells in held))
        if sweeps is not None:
            sweeps.append(likely)
        if likely - last < SETTLED * abs(likely):
            return model
        last = likely


_PART = "row long, n_tokens long, known long, base double, part double, rare array<struct<word:bigint,times:int>>"


def score(docs: DataFrame, counts: DataFrame, lex: Lexicon, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities) of every text."""
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    schema = src.select("doc_id", "held_out").schema
    for field in spark.createDataFrame([], _PART).schema:
        schema = schema.add(field)
    shared = spark.sparkContext.broadcast((lex, model))
    rare_type = pa.list_(pa.struct([("word", pa.int64()), ("times", pa.int32())]))
    norm = float(np.log10(lex.total + lex.distinct + 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hmm = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            flats, begins, at = [], [], 0
            n_tok, known, base, part, rare_parts, rare_sizes = [], [], [], [], [], []
            for _, _, data, off in kernels.text_blocks(batch.column(2)):
                words, first = tokens(data, off)
                flat, begin, symbol, count = sequences(own, words, first)
                flats.append(flat.astype(np.int16))
                begins.append(begin[:-1] + at)
                at += len(flat)
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                m = len(first) - 1
                fast = count >= 0
                log_c = np.log10(np.where(fast, count, 0) + 1.0)
                base.append(np.bincount(doc, log_c, m) + np.log10(own.texts + 1.0))
                shared_class = np.where(symbol >= OWN, own.log_rest[np.maximum(symbol - OWN, 0)], 0.0)
                part.append(np.bincount(doc, np.where(symbol >= OWN, log_c, 0.0) - shared_class, m))
                known.append(np.bincount(doc, fast, m).astype(np.int64) + bool(own.texts))
                n_tok.append(np.diff(first) + 1)
                slow = np.flatnonzero(~fast)
                order = np.lexsort((words[slow], doc[slow]))
                w, d = words[slow][order], doc[slow][order]
                cut = np.flatnonzero(np.concatenate([[True], (np.diff(w) != 0) | (np.diff(d) != 0)])) if len(w) else np.zeros(0, np.int64)
                times = np.diff(np.append(cut, len(w))).astype(np.int32)
                rare_parts.append((w[cut], times))
                rare_sizes.append(np.bincount(d[cut], minlength=m) if len(cut) else np.zeros(m, np.int64))
            if not flats:
                continue
            likely = log_likelihood(hmm, np.concatenate(flats), np.append(np.concatenate(begins), at)) / np.log(10)
            n_tok = np.concatenate(n_tok)
            w, times = (np.concatenate(x) for x in zip(*rare_parts, strict=True))
            edges = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(rare_sizes))]), pa.int32())
            rare = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays([pa.array(w), pa.array(times)], fields=list(rare_type.value_type)))
            rows = pa.array(np.arange(row, row + len(n_tok)))
            row += len(n_tok)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows, pa.array(n_tok), pa.array(np.concatenate(known)), pa.array(np.concatenate(base) - n_tok * norm), pa.array(likely + np.concatenate(part)), rare], names=schema.names)

    parts = written(src.mapInArrow(run, schema), "scores")
    looked = parts.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times").join(counts, "word")
    rest = looked.groupBy("row").agg(F.sum("times").alias("known_"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("gain_"))
    gain = F.coalesce("gain_", F.lit(0.0))
    return parts.drop("rare").join(rest, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known_", F.lit(0))).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"), (F.col("base") + gain).alias("base_score"), (F.col("part") + gain).alias("score"))


def language_model(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Learns from the documents outside the held-out fold and scores all of them, each text whole.

    Words are told apart by hashes of 64 bits. Of words that occur equally often the one with the smaller hash is the more frequent.

    Null and empty texts have one token, the end. Repeated rows count and come back as often as they occur. Other columns are
    ignored. Without training texts all counts are zero and the model is uniform. No rows: no rows.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    learn = src.where(~held_out(F.col("doc_id")))
    counts = written(word_counts(learn), "word-counts")
    lex = lexicon(counts, learn.count())
    return score(src, counts, lex, train(learn, lex))
