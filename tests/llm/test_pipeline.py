"""The corpus pipeline against a plain Python version."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tessera.llm import toxicity
from test_dedup import brute_fingerprint, brute_lines, union
from test_text import TIKTOKEN, brute_hits, sha


def corpus(seed=11):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    texts = ["\n".join(sentence(r.randint(8, 30)) + "." for _ in range(r.randint(2, 6))) for _ in range(120)]
    shared, passage = sentence(60), sentence(40)
    for i in range(0, 20):
        texts[i] += "\n" + shared + "\nThe same foot under all of them, Page 7"
    texts += [t[:-1] + "x." for t in texts[40:50]] + texts[50:55] + [t.replace(".", "!", 1) for t in texts[55:60]]
    texts += [f"{sentence(9)}\n{sentence(4)} {' '.join(passage.split()[k:k + 14])} {sentence(5)}" for k in range(6)]
    toxic = [f"{sentence(9)}. You {r.choice(['vile', 'scummy'])} {sentence(3)}. {sentence(12)}." for _ in range(60)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(1000 + i, t, "de", None, len(t)) for i, t in enumerate(toxic)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, "  \n ", "en", "s", 4), (None, sentence(30), "en", "s", 1), (None, sentence(30), "en", "s", 1), (3, texts[3], "en", "s", 1), (2003, "lonely", "en", "s", 6), (2004, sentence(20_000), "fr", "s", 1)]
    labels = [(i, 1, int(i >= 1000)) for i in [*range(100), *range(1000, 1060)]]
    return rows, labels, [("a", passage), ("b", "never found here"), ("c", None)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows, labels, items = corpus()
    for name, data, columns in (("documents", rows, ("doc_id", "text", "lang", "source", "n_chars")), ("labels", labels, ("doc_id", "quality", "toxic")), ("benchmark", items, ("item_id", "text"))):
        pq.write_table(pa.table({c: [x[i] for x in data] for i, c in enumerate(columns)}), path / f"{name}.parquet")
    return str(path)


@pytest.fixture(autouse=True)
def few_steps(monkeypatch):
    """The classifier's fit is tested elsewhere; here it may be short."""
    monkeypatch.setattr(toxicity, "EPOCHS", 30)
    monkeypatch.setattr(toxicity, "RELAXED", 10)


def test_pipeline_matches_plain_python(spark, folder):
    rows, _, items = corpus()
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scores = {(r.doc_id, r.key): r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    by_text = {(r.doc_id, r.text): scores[r.doc_id, r.key] for r in docs.select("doc_id", "text", toxicity.row_key(docs.doc_id, docs.text).alias("key")).collect()}
    left = [(i, t) for i, t, *_ in rows if by_text[i, t] < 0.5]
    assert {i for i, *_ in rows} - {i for i, _ in left} >= {1000 + k for k in range(55)} and len(left) < len(rows) - 50

    gone = brute_lines([x for x in left if x[1] is not None and len(x[1]) < 20_000])
    cut = [(i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ()))) for i, t in left]
    assert sum(t != u for (_, t), (_, u) in zip(left, cut, strict=True)) >= 15

    fp = [brute_fingerprint(t) for _, t in cut]
    root = union([(a, b) for a in range(len(cut)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 2], range(len(cut)))
    groups = {}
    for k in root:
        groups.setdefault(root[k], []).append(cut[k])
    firsts = [sorted(g, key=lambda x: (x[0] is None, x[0] or 0))[0] for g in groups.values()]

    clean = [x for x, hit in zip(firsts, brute_hits(firsts, items), strict=True) if not hit[-1]]
    assert len(clean) < len(firsts)
    want = []
    for i, t in clean:
        ids = TIKTOKEN.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    got = corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.selectExpr("*", *(f"'u' AS {c}" for c in ("key", "key_", "flags", "n", "n_lines", "n_dropped", "score", "items")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, folder)
        assert odd.columns[:5] == docs.columns and len(odd.columns) == 13
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert odd.where("key != 'u' or key_ != 'u' or n != 'u' or n_lines != 'u' or items != 'u'").count() == 0 and odd.count() > 100
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
    assert np.unique([name for name, _ in corpus_pipeline.STAGES]).size == 5
