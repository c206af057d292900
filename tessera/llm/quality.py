"""Quality rules: fixed floors, and robust multivariate outliers by minimum covariance determinant.

Each document has a vector of transformed statistics. For every language and source the minimum-covariance-determinant
estimate has three starts (medians with median deviations, means with covariances, medians with one scale for all) and is
improved by concentration steps: distances to the current estimate, the share H of nearest rows, their mean and covariance.
A step is one pass: rows are summed by group, start and class of distance (a sixteenth of a logarithm wide), combined before
the shuffle, and the nearest classes that hold the share make the next estimate. Steps end when no determinant changes, and of a group's
starts that with the smallest determinant stays. A document is rejected if the logarithm of its squared Mahalanobis distance
passes the group's median by SIGMAS robust standard deviations; these come from the group's median and third quartile, since
distances of ordinary documents have far heavier tails than a chi-square variable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels
from tessera.llm.shared import written

MIN_WORDS, MAX_REPEATED = 50, 0.5
#: The share of a group's rows that the estimate rests on, and the fewest rows that get an estimate of their own.
H, MIN_GROUP = 0.75, 60
#: Steps end when no logarithm of a determinant changes by more, or after so many steps.
SETTLED, MOST_STEPS = 0.02, 12
#: The cutoff, in robust standard deviations of the logarithm of squared distances, and the third quartile of a normal variable.
SIGMAS, QUARTILE = 3.0, 0.6745
CLASSES = 16
STATS = ["word_length", "symbols", "capitals", "marks", "repeated", "dup_lines"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
DIMS = len(STATS)
#: What a statistic varies by at least (standard deviation), so that one that is constant in a group doesn't reject small deviations.
FLOOR = [0.03, 0.06, 0.04, 0.05, 0.08, 0.08]


def _kind(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOLS = _kind(b"#*$%&|<>")
_CAPITALS = _kind(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTERS = _CAPITALS | _kind(b"abcdefghijklmnopqrstuvwxyz")
_MARKS = _kind(bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,"))
_HEADS = kernels.WORD.copy()
_HEADS[0x80:0xC0] = False  # a code point's first byte


def repeats(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each hash whether its text has it twice or more."""
    order = np.argsort(kernels.mix(text.astype(np.uint64) + np.uint64(1)) + h)
    same = (np.diff(h[order]) == 0) & (np.diff(text[order]) == 0)
    out = np.zeros(len(h), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def measured(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """COUNTS and STATS of each text of a block."""
    def total(member: np.ndarray) -> np.ndarray:
        seen = np.zeros(len(data) + 1, np.int64)
        np.cumsum(member[data], out=seen[1:])
        return np.diff(seen[off])

    n_texts = len(off) - 1
    starts, ends, first = kernels.runs(kernels.WORD[data], off)
    n = np.diff(first)
    h = kernels.span_hash(data, starts, ends)
    text = np.repeat(np.arange(n_texts), n)
    repeated = np.zeros(n_texts, np.int64)
    if len(h) > 2:
        whole = np.flatnonzero(text[2:] == text[:-2])
        windows = kernels.mix(kernels.mix(kernels.mix(h[whole]) + h[whole + 1]) + h[whole + 2])
        hit = whole[repeats(text[whole], windows)]
        cover = np.zeros(len(h), bool)
        for k in range(3):
            cover[hit + k] = True
        repeated = np.bincount(text[cover], minlength=n_texts)
    a, b, line_first = kernels.runs(data != 10, off)
    own = np.searchsorted(a, starts, "right") - 1  # each word's line
    worded = np.zeros(len(a), bool)
    worded[own] = True
    line_text = np.repeat(np.arange(n_texts), np.diff(line_first))[worded]
    line_hash = kernels.span_hash(data, a[worded], b[worded])
    order = np.lexsort((line_hash, line_text))
    dup = np.bincount(line_text[order][1:][(np.diff(line_hash[order]) == 0) & (np.diff(line_text[order]) == 0)], minlength=n_texts)
    lines = np.bincount(line_text, minlength=n_texts)
    chars, symbols, marks, letters, capitals = (total(t) for t in (_HEADS, _SYMBOLS, _MARKS, _LETTERS, _CAPITALS))
    each = np.maximum(n, 1)
    stats = [np.log(np.maximum(chars, 1) / each), *(np.sqrt(x / y) for x, y in ((symbols, each), (capitals, np.maximum(letters, 1)), (marks, each), (repeated, each), (dup, np.maximum(lines, 1))))]
    return [n, chars, symbols, dup, repeated], stats


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, lang, source, COUNTS, STATS and base_failed. One pass, no shuffle. Null texts have no words."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    schema = src.select("doc_id", "lang", "source", *(F.lit(0).cast("long").alias(c) for c in COUNTS), *(F.lit(0.0).alias(c) for c in STATS)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in kernels.text_blocks(batch.column(3), 1 << 19):
                counts, stats = measured(data, off)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:3]), *(pa.array(c, pa.int64()) for c in counts), *(pa.array(c, pa.float64()) for c in stats)], names=schema.names)

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * MAX_REPEATED * F.col("n_words"))
    return src.mapInArrow(run, schema).withColumn("base_failed", failed)


def _grouped(stats: DataFrame) -> DataFrame:
    """lang_, source_, grp: groups too small for an estimate pool by language, then all together."""
    one = stats.groupBy("lang_", "source_").agg(F.count("*").alias("n"))
    small = one.where(F.col("n") < MIN_GROUP).groupBy("lang_").agg(F.sum("n").alias("of_lang"))
    key = F.when(F.col("n") >= MIN_GROUP, F.concat_ws("\x01", F.lit("s"), "lang_", "source_")).when(F.col("of_lang") >= MIN_GROUP, F.concat_ws("\x01", F.lit("l"), "lang_")).otherwise(F.lit("a"))
    return one.join(small, "lang_", "left").select("lang_", "source_", key.alias("grp"))


def _distance(center: str = "center", inverse: str = "inverse") -> str:
    d = [f"({c} - {center}[{i}])" for i, c in enumerate(STATS)]
    return " + ".join(f"{inverse}[{i * DIMS + j}] * {d[i]} * {d[j]}" + (" * 2" if i != j else "") for i in range(DIMS) for j in range(i, DIMS))


_SUMS = [f"s{i}" for i in range(DIMS)] + [f"s{i}_{j}" for i in range(DIMS) for j in range(i, DIMS)]
_FIT = "grp string, start int, center array<double>, inverse array<double>, logdet double"


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums about a centre (grp, start, center, n, sums) -> grp, start, center, inverse, logdet."""
    floor = np.diag(np.square(FLOOR))
    for batch in batches:
        centers, inverses, logdets = [], [], []
        for center, n, sums in zip(*(batch.column(c).to_pylist() for c in ("center", "n", "sums")), strict=True):
            n, s = max(n, 1), np.array(sums[:DIMS])
            cov = np.zeros((DIMS, DIMS))
            cov[np.triu_indices(DIMS)] = np.array(sums[DIMS:]) / n
            cov = cov + np.triu(cov, 1).T - np.outer(s / n, s / n) + floor
            centers.append((np.array(center) + s / n).tolist())
            inverses.append(np.linalg.inv(cov).ravel().tolist())
            logdets.append(float(np.linalg.slogdet(cov)[1]))
        doubles = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("start"), pa.array(centers, doubles), pa.array(inverses, doubles), pa.array(logdets, pa.float64())], names=["grp", "start", "center", "inverse", "logdet"])


def _moments(rows: DataFrame, *by: str) -> DataFrame:
    """n and the sums about center, from rows with center and STATS."""
    d = [f"({c} - center[{i}])" for i, c in enumerate(STATS)]
    sums = [f"sum({x})" for x in d] + [f"sum({d[i]} * {d[j]})" for i in range(DIMS) for j in range(i, DIMS)]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.expr(x).alias(c) for x, c in zip(sums, _SUMS, strict=True)))


def _classed(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """The rows with their groups' estimates and class: a range of squared distances."""
    return rows.join(fit, "grp").withColumn("class", F.expr(f"floor({CLASSES} * ln({_distance()} + 1e-12D))"))


def starts(rows: DataFrame) -> DataFrame:
    """grp, start, center, inverse, logdet (null) of the three starts of each group."""
    median = written(rows.groupBy("grp").agg(*(F.expr(f"percentile_approx({c}, 0.5, 2000)").alias(f"m_{c}") for c in STATS)), "medians")
    spread = rows.join(median, "grp").groupBy("grp").agg(*(F.expr(f"percentile_approx(abs({c} - m_{c}), 0.5, 2000)").alias(f"d_{c}") for c in STATS))
    center = f"array({', '.join(f'm_{c}' for c in STATS)}) AS center"
    diagonal = lambda own: f"array({', '.join(own(i) if i == j else '0D' for i in range(DIMS) for j in range(DIMS))}) AS inverse"
    by_spread = median.join(spread, "grp").selectExpr("grp", "0 AS start", center, diagonal(lambda i: f"1 / (pow(1.4826 * d_{STATS[i]}, 2) + {FLOOR[i] ** 2})"), "cast(null as double) AS logdet")
    by_one = median.selectExpr("grp", "2 AS start", center, diagonal(lambda i: "1D"), "cast(null as double) AS logdet")
    about = median.selectExpr("grp", center)
    whole = _moments(rows.join(about, "grp"), "grp").join(about, "grp").selectExpr("grp", "1 AS start", "center", "n", f"array({', '.join(_SUMS)}) AS sums")
    classical = whole.mapInArrow(_estimate, _FIT).withColumn("logdet", F.lit(None).cast("double"))
    return by_spread.union(classical.select(*by_spread.columns)).union(by_one)


def concentrated(rows: DataFrame, fit: DataFrame, h: float = H) -> DataFrame:
    """The next estimate of every group and start: mean and covariance of the nearest classes that hold the share h."""
    by_class = _moments(_classed(rows, fit), "grp", "start", "center", "class")
    before = "sum(n) OVER (PARTITION BY grp, start ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    nearest = by_class.withColumn("before", F.expr(f"coalesce({before}, 0)")).withColumn("whole", F.expr("sum(n) OVER (PARTITION BY grp, start)")).where(f"before < {h} * whole")
    sums = nearest.groupBy("grp", "start", "center").agg(F.sum("n").alias("n"), F.array(*(F.sum(c) for c in _SUMS)).alias("sums"))
    return sums.mapInArrow(_estimate, _FIT)


def estimates(rows: DataFrame, h: float = H, most_steps: int = MOST_STEPS, sigmas: float = SIGMAS) -> DataFrame:
    """grp, center, inverse, cutoff (of squared distances) from rows with grp and STATS."""
    fit = written(starts(rows), "estimate")
    for _ in range(most_steps):
        new = written(concentrated(rows, fit, h), "estimate")
        moved = new.join(fit.select("grp", "start", F.col("logdet").alias("was")), ["grp", "start"]).agg(F.max(F.abs(F.col("logdet") - F.coalesce("was", F.lit(1e9)))).alias("x")).first().x
        fit = new
        if moved is None or moved < SETTLED:
            break
    best = fit.groupBy("grp").agg(F.min(F.struct("logdet", "start", "center", "inverse")).alias("b")).select("grp", "b.center", "b.inverse")
    best = written(best, "estimate")
    by_class = _classed(rows, best).groupBy("grp", "class").agg(F.count("*").alias("n"))
    upto = by_class.withColumn("upto", F.expr("sum(n) OVER (PARTITION BY grp ORDER BY class)")).withColumn("whole", F.expr("sum(n) OVER (PARTITION BY grp)"))
    at = lambda share: F.min(F.when(F.col("upto") >= share * F.col("whole"), F.struct("class", (F.lit(1.0) - (F.col("upto") - share * F.col("whole")) / F.col("n")).alias("part"))))
    found = upto.groupBy("grp").agg(at(0.5).alias("q2"), at(0.75).alias("q3"))
    q2, q3 = ((F.col(f"{q}.class") + F.col(f"{q}.part")) / CLASSES for q in ("q2", "q3"))
    return best.join(found.select("grp", F.exp(q2 + sigmas / QUARTILE * (q3 - q2)).alias("cutoff")), "grp")


def verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", sigmas: float = SIGMAS) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, distance and cutoff (squared; null where there's no estimate).

    Estimates rest on all documents that pass the base rules. Null languages and sources are groups like any other.
    Groups with fewer than MIN_GROUP such documents pool by language, then all together; if even the pool is smaller, only the base rules decide.
    Null, empty and blank texts have no words and fail the base. Repeated rows count as often as they occur. Other columns,
    whatever their names, are ignored. No rows: no rows.
    """
    stats = statistics(docs, doc_id, text, lang, source).withColumns({f"{c}_": F.coalesce(F.col(c), F.lit("\x00")) for c in ("lang", "source")})
    stats = written(stats, "statistics")
    good = stats.where("NOT base_failed")
    groups = written(_grouped(good), "groups")
    rows = good.join(groups, ["lang_", "source_"])
    enough = rows.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_GROUP).select("grp")
    rows = written(rows.join(enough, "grp").select("grp", *STATS), "measured")
    fit = groups.join(estimates(rows, sigmas=sigmas), "grp").drop("grp")
    out = stats.join(fit, ["lang_", "source_"], "left").withColumn("distance", F.expr(_distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= F.col("cutoff"), F.lit(True))
    return out.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "distance", "cutoff")
