"""Line deduplication and SimHash near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import line_dedup, simhash
from tessera.llm.components import components
from tessera.llm.shared import discarded, fresh, key_bits, row_key, written

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_fingerprint(t):
    w = SPLIT.findall(lower(t))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(pairs, items):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def test_simhash_matches_brute_force(docs):
    got = simhash.near_duplicates(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    fp = {r.doc_id: brute_fingerprint(r.text) for r in rows if r.doc_id is not None}
    ids = sorted(fp)
    root = union([(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fp[a] ^ fp[b]).bit_count() <= 2], ids)
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint == f"{fp[r.doc_id]:016x}" and r.component_id == root[r.doc_id]


def test_simhash_links_every_pair_within_two_bits(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum(1 << k for k in r.sample(range(64), n)) for b in base for n in (0, 1, 2, 2, 3, 4) for _ in range(6)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    r.shuffle(signed)
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    root = union([(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2], signed)
    for crowd in (simhash.CROWD, 3):  # with buckets that are fetched, and with most of them linked in the other way
        found = {x.node: x.root for x in components(simhash.links(table, crowd)).collect()}
        assert {f: found.get(f, f) for f in signed} == root


def test_simhash_keeps_one_of_each(docs, nothing):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = simhash.near_duplicates(docs)
    assert kept.count() == got.select("component_id").distinct().count()
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.one_of_each(nothing).count() == 0


def test_simhash_keeps_unlike_texts_of_null_and_shared_ids(spark):
    unlike = [" ".join(f"w{k}x{i}" for k in range(20)) for i in range(5)]
    rows = [(None, unlike[0]), (None, unlike[1]), (None, unlike[1]), (7, unlike[2]), (7, unlike[3]), (8, unlike[3]), (None, unlike[4]), (9, unlike[4])]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in kept) == sorted([(0, unlike[0]), (0, unlike[1]), (7, unlike[2]), (7, unlike[3]), (9, unlike[4])])


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*path, *star, (5, 5), (None, 3)], "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(50)}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    r = random.Random(2)
    for _ in range(2000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(2))
        k = r.randint(0, 6)
        assert line_dedup.edits_within(a, b, k) == (levenshtein(a, b) <= k)


def plain(line):
    """The normalised form, from its definition."""
    words = SPLIT.findall(lower(line))
    return " ".join(words) if len(words) < 5 else re.sub("[0-9]", "0", " ".join(words))


def brute_lines(rows):
    """Which lines go, by edit similarity alone."""
    occ = [(i is None, i, k, plain(x)) for i, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
    occ = sorted({o for o in occ if o[3]}, key=lambda o: (o[0], o[1] or 0, o[2]))
    lines = list(dict.fromkeys(o[3] for o in occ))
    long = [i for i, x in enumerate(lines) if len(x.split(" ")) >= 5]
    close = lambda a, b: 5 * abs(len(a) - len(b)) <= max(len(a), len(b)) and 5 * levenshtein(a, b) <= max(len(a), len(b))
    root = union([(i, j) for i in long for j in long if j < i and close(lines[i], lines[j])], range(len(lines)))
    at = {x: i for i, x in enumerate(lines)}
    first, gone = {}, {}
    for _, i, k, x in occ:
        if first.setdefault(root[at[x]], (i, k)) != (i, k):
            gone.setdefault(i, set()).add(k)
    return gone


def test_lines_match_brute_force(docs):
    short = docs.where("text is null or length(text) < 2000").withColumn("n", F.lit("user")).withColumn("flags", F.lit(1))
    gone = brute_lines([(r.doc_id, r.text) for r in short.select("doc_id", "text").distinct().collect()])
    assert gone
    got = line_dedup.deduplicated(short)
    assert got.columns[: len(short.columns)] == short.columns
    for a in got.collect():
        source = next(r.text for r in short.collect() if r.doc_id == a.doc_id)
        want = None if source is None else "\n".join(x for k, x in enumerate(source.split("\n")) if k not in gone.get(a.doc_id, ()))
        assert a.text == want and a.n_dropped == len(gone.get(a.doc_id, ())) and a.n_lines == (0 if source is None else source.count("\n") + 1)


def test_lines_of_long_and_empty_input(docs, nothing):
    got = line_dedup.deduplicated(docs)
    assert got.count() == docs.count()
    assert got.where("doc_id is null").first().text == "a null id with some words"
    assert line_dedup.deduplicated(nothing).count() == 0


def made_lines(seed, n, count):
    r = random.Random(seed)
    return [[("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))) for _ in range(n)] for _ in range(count)]


@pytest.mark.parametrize(("kind", "least"), [("letter", 1.0), ("word", 1.0), ("in", 0.9), ("out", 0.9), ("two", 0.9)])
def test_recall_of_lines_of_all_lengths(spark, kind, least):
    """Pairs within the similarity by edit distance alone; each pair is found by itself, as its words are its own."""
    r, rows, sizes = random.Random(kind), [], {"two": (14, 20, 30, 39, 50)}.get(kind, (6, 7, 8, 10, 15, 20, 30, 50))
    for n in sizes:
        for words in made_lines(f"{kind}{n}", n, 60):
            other, at = list(words), r.randrange(n)
            if kind == "letter":
                other[at] += "x"
            elif kind == "in":
                other.insert(at, "now")
            elif kind == "out":
                at = min(range(n), key=lambda k: len(words[k]))
                del other[at]
            else:
                for k in r.sample(range(n), 2 if kind == "two" else 1):
                    other[k] = "".join(r.choice("0123456789") for _ in other[k])
            a, b = " ".join(words), " ".join(other)
            if 5 * levenshtein(plain(a), plain(b)) <= max(len(a), len(b)):
                rows += [(2 * len(rows), a), (2 * len(rows) + 1, b)]
    got = {x.doc_id: x.n_dropped for x in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    found = [got[b] for (_, _), (b, _) in zip(rows[::2], rows[1::2], strict=True)]
    assert not any(got[a] for a, _ in rows[::2]) and len(found) > 100
    assert sum(found) >= least * len(found)


def test_crowded_buckets_link_all(spark):
    """Lines that share four fifths of their words, of which some are similar: what is linked is what edit distance links."""
    r = random.Random(9)
    stems = ["alpha beta gamma delta", "one two three four"]
    lines = [f"{s} {''.join(r.choice('abcdef') for _ in range(r.randint(8, 12)))}" for s in stems for _ in range(80)]
    gone = brute_lines(list(enumerate(lines)))
    got = line_dedup.deduplicated(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).where("n_dropped > 0").collect()
    assert {x.doc_id for x in got} == set(gone) and 20 < len(gone) < 157


def test_lines_with_columns_of_any_name(spark, docs):
    odd = docs.select("*", *(F.lit("u").alias(c) for c in ("key_", "flags", "flags_", "n", "n_", "line", "node", "n_lines", "n_dropped")))
    got = line_dedup.deduplicated(odd, counts=False)
    assert got.columns == odd.columns and got.where("key_ != 'u' or n_lines != 'u' or flags_ != 'u'").count() == 0 and got.count() == odd.count()
    assert simhash.one_of_each(odd).columns == odd.columns and simhash.one_of_each(odd).where("key_ != 'u' or key != 'k' and key is not null").count() == 0


def test_short_lines_go_only_if_equal(spark):
    rows = [(1, "All rights reserved.\nPage 1\n}"), (2, "ALL  rights reserved.\nPage 2\n}\nnew"), (3, "\n\n")]
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "Page 2\nnew", 3: "\n\n"}


def test_bucket_keys_are_those_of_the_choices():
    """As many keys as choices of blocks; lines share the keys whose blocks no change touches."""
    r = random.Random(3)
    lines = [["".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(n)] for n in [*range(5, 60), 200]]
    data = "\n".join(" ".join(x) for x in lines).encode()
    parts = line_dedup.nodes_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 5)[4]
    row, key = line_dedup.bucket_arrays(parts)
    assert len(set(key.tolist())) == len(key)
    choices = {1: 5, 2: 10, 3: 10, 4: 5}
    for i, x in enumerate(lines):
        n = np.count_nonzero(row == i)
        assert choices[line_dedup.kept_blocks(len(x))] <= n <= choices[line_dedup.kept_blocks(len(x))] + 4
        other = " ".join(["changed", *x[1:]]).encode()
        more = line_dedup.bucket_arrays(line_dedup.nodes_of(np.frombuffer(other, np.uint8), np.array([0, len(other)]), 5)[4])[1]
        assert len(set(more.tolist()) & set(key[row == i].tolist())) >= choices[line_dedup.kept_blocks(len(x))] * (5 - line_dedup.kept_blocks(len(x))) // 5
    assert {line_dedup.kept_blocks(n) for n in range(5, 14)} == {4} and line_dedup.kept_blocks(40) == 1


def test_row_keys(spark):
    rows = [(1, "a"), (1, "b"), (None, "a"), (None, None), (2, ""), (1, "a")]
    keys = spark.createDataFrame(rows, "doc_id long, text string").select(row_key(F.col("doc_id"), F.col("text")).alias("k")).toArrow().column("k").combine_chunks()
    assert len(set(keys.to_pylist())) == 5 and all(len(k) == 16 for k in keys.to_pylist())
    assert key_bits(keys).tolist() == [int.from_bytes(k[:8], "little") for k in keys.to_pylist()]
    assert key_bits(keys[2:]).tolist() == key_bits(keys).tolist()[2:] and fresh(["Key", "key_"], "key") == "key__"


def test_written_tables_can_be_discarded(spark):
    a = written(spark.range(3), "a")
    b = written(a, "b")
    discarded(a, a, spark.range(1))
    assert b.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(a.inputFiles()[0])


def test_fingerprints_of_a_very_long_text(spark):
    long = " ".join(f"w{i % 999}" for i in range(400_000))
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(spark.createDataFrame([(1, long), (2, "a b c"), (3, None)], "doc_id long, text string")).collect()}
    assert got[1] == f"{brute_fingerprint(long):016x}" and got[2] == f"{brute_fingerprint('a b c'):016x}" and got[3] == "0" * 16
    line = " ".join(f"w{i}" for i in range(200_000))
    kept = {r.doc_id: r.n_dropped for r in line_dedup.deduplicated(spark.createDataFrame([(1, line), (2, line.replace("w77 ", "z ", 1)), (3, "w1 w2")], "doc_id long, text string")).collect()}
    assert kept == {1: 0, 2: 1, 3: 0}
