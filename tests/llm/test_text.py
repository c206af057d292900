"""Encoding, language model, secrets, toxicity, quality, decontamination: brute force, exact round trips, held-out accuracy."""

import base64
import collections
import hashlib
import json
import math
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, decontaminate, hmm, kernels, quality, secrets, toxicity

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = bpe.codec(bpe.ranks_file())
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS.ranks, special_tokens={})


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def encode(text):
    (_, _, data, off), *_ = kernels.text_blocks(pa.array([text, "tail"]))
    flat, first = RANKS.encode(data, off)
    return flat[first[0] : first[1]]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'strevlmd  \n\t1²éÄ中😀!? 　\x1c\x85"), max_size=40))
def test_encoding_equals_tiktoken(text):
    assert encode(text) == TIKTOKEN.encode_ordinary(text)


def test_bpe_round_trip(docs, nothing):
    for r, t in zip(bpe.round_trip(docs).collect(), docs.collect(), strict=True):
        ids = TIKTOKEN.encode_ordinary(t.text or "")
        assert (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) == (t.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((t.text or "").encode()))
    back = bpe.decode(bpe.encode(docs)).collect()
    assert [bytes(r.decoded).decode() for r in back] == [t.text or "" for t in docs.collect()]
    assert bpe.round_trip(nothing).count() == 0


def test_offsets_decode_any_range():
    text = "some mañana text 学校 with 😀"
    ids = encode(text)
    off = RANKS.offsets(ids)
    raw = text.encode()
    for lo in range(0, len(raw), 3):
        for hi in range(lo, len(raw) + 1, 5):
            assert RANKS.decode(ids, off, lo, hi) == raw[lo:hi]


def test_language_model(docs, nothing):
    rows = docs.select("doc_id", "text").collect()
    words = [[w for w in (t.text or "").encode().lower().split()] + [None] for t in rows]
    out = [zlib.crc32(("" if t.doc_id is None else str(t.doc_id)).encode()) % 7 == 2 for t in rows]
    c = collections.Counter(w for ws, o in zip(words, out, strict=True) if not o for w in ws)
    n, v = sum(c.values()), len(c)
    got = hmm.language_model(docs).collect()
    assert len(got) == len(rows)
    want = sorted((t.doc_id or -1, o, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for t, o, ws in zip(rows, out, words, strict=True))
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert hmm.language_model(nothing).count() == 0


def test_forward_recursion_is_exact():
    rng = np.random.default_rng(0)
    k, symbols = 3, 5
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), np.vstack([rng.dirichlet(np.ones(symbols), k).T, np.ones(k)]))
    seqs = [rng.integers(0, symbols, n) for n in (1, 2, 5, 7, 40)]
    got = hmm.log_likelihood(model, np.concatenate(seqs), np.cumsum([0, *map(len, seqs)]))
    for s, g in zip(seqs, got, strict=True):
        a = model.start * model.emit[s[0]]
        for x in s[1:]:
            a = (a @ model.move) * model.emit[x]
        assert g == pytest.approx(math.log(a.sum()))


def test_expected_counts_match_enumeration(monkeypatch):
    monkeypatch.setattr(hmm, "SYMBOLS", 4)
    rng = np.random.default_rng(1)
    model = hmm.Model(rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), np.vstack([rng.dirichlet(np.ones(4), 2).T, np.ones(2)]))
    seqs = [np.array([0, 3, 1, 1]), np.array([2, 2])]
    start, move, emit = hmm.expected(model, np.concatenate(seqs), np.array([0, 4, 6]))
    s2, m2, e2 = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for s in seqs:
        paths = [[(i >> t) & 1 for t in range(len(s))] for i in range(1 << len(s))]
        p = np.array([model.start[q[0]] * model.emit[s[0], q[0]] * math.prod(model.move[a, b] * model.emit[x, b] for a, b, x in zip(q, q[1:], s[1:], strict=False)) for q in paths])
        for q, w in zip(paths, p / p.sum(), strict=True):
            s2[q[0]] += w
            for a, b in zip(q, q[1:], strict=False):
                m2[a, b] += w
            for a, x in zip(q, s, strict=True):
                e2[x, a] += w
    assert np.allclose(start, s2, atol=1e-4) and np.allclose(move, m2, atol=1e-4) and np.allclose(emit[:4], e2, atol=1e-4)


def test_expected_counts_cross_long_texts(monkeypatch):
    monkeypatch.setattr(hmm, "SYMBOLS", 4)
    rng = np.random.default_rng(2)
    model = hmm.Model(rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), np.vstack([rng.dirichlet(np.ones(4), 2).T, np.ones(2)]))
    seqs = [rng.integers(0, 4, n) for n in (3, 200, 65, 1)]
    begin = np.cumsum([0, *map(len, seqs)])
    start, move, emit = hmm.expected(model, np.concatenate(seqs), begin)
    assert start.sum() == pytest.approx(4, abs=1e-3) and move.sum() == pytest.approx(sum(len(s) - 1 for s in seqs), abs=1e-2)
    assert np.allclose(emit.sum(1)[:4], np.bincount(np.concatenate(seqs), minlength=4), atol=1e-2)
    assert hmm.summed(model, np.concatenate(seqs), begin)[3] == pytest.approx(hmm.log_likelihood(model, np.concatenate(seqs), begin).sum(), rel=1e-5)


def test_language_model_starts_from_all_words(spark):
    d = spark.createDataFrame([(i, f"w{i % 40} common w{i}") for i in range(2000)], "doc_id long, text string")
    lex = hmm.lexicon(hmm.word_counts(d), 2000)
    assert lex.seen.sum() == 8000 and lex.seen[hmm.END] == 2000 and lex.seen.max() == 2000


def brute_base(t):
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def test_secrets(spark):
    key = der(0x30, der(2, b"\0") + der(2, b"\x01" * 200) + der(2, b"\x01\0\x01"))
    jwt = ".".join(base64.urlsafe_b64encode(x).rstrip(b"=").decode() for x in (json.dumps({"alg": "HS256"}).encode(), b'{"sub":"1"}', b"signature"))
    ssh = base64.b64encode(b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", b"k" * 32))).decode()
    texts = ["é PassWord = 'hunter22x' token: short secret:abc", "AKIA" + "A" * 16 + " AKIAX", "x" + "0a" * 14 + "g", f"ü {base64.b64encode(key).decode()} end", f"jwt {jwt}.", f"ssh {ssh}", key.hex(), "M" * 60, "eyJhbGc.eyJ.x", "token=token=abcdef", "secret: token: abcdefgh", f"-----BEGIN PRIVATE KEY-----\n{base64.b64encode(key).decode()}\n-----END PRIVATE KEY-----", None, ""]
    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r, t in zip(got, texts, strict=True):
        base = brute_base(t or "")
        assert r.base_sha256 == sha(base.encode()) and set(filter(None, base.split(","))) <= set(r.spans.split(","))
    kinds = [{s.split(":")[0] for s in r.spans.split(",") if s} - {"assign", "access", "hex"} for r in got]
    assert kinds[3] == {"der"} and kinds[4] == {"token"} and kinds[5] == {"ssh"} and kinds[6] == {"der"} and "armour" in kinds[11]
    assert not any(kinds[i] for i in (0, 1, 2, 7, 8, 9, 10, 12, 13))
    t, (_, a, b) = texts[3], got[3].spans.split(",")[0].split(":")
    assert t[int(a) : int(b)] == base64.b64encode(key).decode()


def test_secrets_from_any_start():
    key = der(0x30, der(2, b"\0") + der(2, b"\x01" * 200) + der(2, b"\x01\0\x01"))
    b64 = base64.b64encode(key).decode()
    ssh = base64.b64encode(b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", b"k" * 32)))
    wrapped = [b64[i : i + 64] for i in range(0, len(b64), 64)]
    big = base64.b64encode(der(0x30, der(2, b"\0") + der(2, b"\x01" * 60_000))).decode()
    kinds = lambda t: {secrets.KINDS[k] for _, k, _ in secrets.confirmed_spans(t.encode())}
    for t in ("path/" + b64, "x_" + b64 + " y", "\\n" + b64, "\n".join(wrapped), "\\n".join(wrapped), "0" + key.hex(), "30" + key.hex() + "a", b64.rstrip("=") + "AB"):
        assert kinds(t) == {"der"}, t
    assert kinds("k/" + ssh.decode()) == {"ssh"} and kinds(base64.b64decode(ssh).hex()) == {"ssh"}
    armour = "-----BEGIN {0}-----{1}-----END {0}-----".format
    for label, body in (("RSA PRIVATE KEY", "\\n" + "\\n".join(wrapped) + "\\n"), ("PRIVATE KEY", "\n" + big + "\n"), ("RSA PRIVATE KEY", "\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n" + "q83v" * 40 + "\n"), ("PGP PRIVATE KEY BLOCK", "\nVersion: 1\n\n" + "lQOY" * 40 + "\n=aBcD\n")):
        assert "armour" in kinds(armour(label, body)), label
    for head in ('{ "alg":"HS256"}', '{\n  "alg": "HS256"}', '{\t"alg":"none"}', '{\r\n"alg":"RS256"}'):
        parts = [base64.urlsafe_b64encode(x).rstrip(b"=").decode() for x in (head.encode(), b'{"sub": 1}', b"sig")]
        assert kinds("t=" + ".".join(parts)) == {"token"}, head
    assert "armour" in kinds(armour("A VERY LONG AND NEVERTHELESS WELL FORMED LABEL OF A PRIVATE KEY", "\n" + b64 + "\n"))
    assert not kinds("M" * 60) and not kinds("MIIE" * 40) and not kinds("30" * 60)
    text = ("see path/" + b64 + " end").encode()
    assert [text[a:b].decode() for a, _, b in secrets.confirmed_spans(text)] == [b64]


def test_secrets_of_any_table(docs, nothing):
    for r, t in zip(secrets.scan(docs).collect(), docs.collect(), strict=True):
        assert r.base_sha256 == sha(brute_base(t.text or "").encode())
    assert secrets.scan(nothing).count() == 0
    assert secrets.exploded(secrets.scan(docs)).columns == ["doc_id", "kind", "start", "end"]


def test_toxicity_learns_sentences_from_documents(spark, docs, nothing):
    rng = np.random.default_rng(4)
    plain, bad = [f"word{i}" for i in range(60)], ["vile", "scummy"]
    rows, labels = [], []
    for i in range(500):
        sentences = [" ".join(rng.choice(plain, 6)) for _ in range(4)]
        y = int(rng.random() < 0.3)
        if y:
            sentences[rng.integers(4)] += f" {rng.choice(bad)} thing"
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, y))
    d = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1001, "")], "doc_id long, text string")
    y = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(d, y)
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    for i in held:
        if got[i].predicted:
            assert any(w in rows[i][1][got[i].offending[0].start : got[i].offending[0].end] for w in bad)
    assert got[1000].score == got[1001].score == 0.0
    left = {r.doc_id for r in toxicity.clean(d, y).collect()}
    assert left == {i for i in got if not got[i].predicted}
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, y.limit(0))).where("score >= 0.5").count() == 0


def test_toxicity_score_is_the_noisy_or(spark):
    """Scores against the product over sentences, from the model's weights; a very long text is scored whole."""
    weights = np.zeros(1 << toxicity.BITS, np.float32)
    texts = ["good day. vile words! more vile words here", "nothing\nat all", "", None, "vile " * 3, ("plain sentence of words. " * 60_000) + "vile end."]
    feature, begin, _, _, _ = toxicity.sentences(*(lambda b: (np.frombuffer(b, np.uint8), np.array([0, len(b)])))(b"vile"))
    weights[feature[0]] = 4.0
    model = toxicity.Model(weights, -5.0)
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        q = 1.0
        for part in re.split(r"[.!?\n]", t or ""):
            words = re.findall("[0-9a-z]+", part.lower())
            if words:
                q *= 1 - 1 / (1 + math.exp(5.0 - 4.0 * ("vile" in words)))
        assert r.score == pytest.approx(1 - q, abs=1e-6) and r.predicted == int(1 - q >= 0.5)


def test_every_code_point_is_encoded_as_by_tiktoken():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for before in "a1":
        for k in range(0, len(points), 1 << 18):
            text = "".join(before + c for c in points[k : k + (1 << 18)])
            assert list(encode(text)) == TIKTOKEN.encode_ordinary(text)


def test_very_long_texts(spark):
    """One text over several blocks' length, beside short ones, in each operator that works by blocks."""
    long = " ".join(f"w{i % 40_000}é" + ("\n" if i % 23 == 0 else "") for i in range(300_000)) + " password=hunter22x " + "ab" * 20
    rows = [(1, "short text"), (2, long), (3, None), (4, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    ids = TIKTOKEN.encode_ordinary(long)
    got = {r.doc_id: r for r in bpe.round_trip(d).collect()}
    assert (got[2].n_tokens, got[2].decoded_sha256) == (len(ids), sha(long.encode())) and got[2].ids_sha256 == sha(",".join(map(str, ids)).encode())
    assert got[3].n_tokens == got[4].n_tokens == 0
    found = {r.doc_id: r for r in secrets.scan(d).collect()}
    assert found[2].base_sha256 == sha(brute_base(long).encode()) and found[2].n_assign == 1 and found[3].spans == ""
    model = {r.doc_id: r for r in hmm.language_model(d).collect()}
    train = [SPLIT.findall(lower(t)) + ["\0end"] for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    count = collections.Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        words = SPLIT.findall(lower(t)) + ["\0end"]
        assert (model[i].n_tokens, model[i].n_known, model[i].train_tokens) == (len(words), sum(w in count for w in words), n)
        assert model[i].base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
        assert math.isfinite(model[i].score)


def test_language_model_of_words_all_equally_frequent(spark, monkeypatch):
    """A class of counts that is larger than there is room for gives some of its words their own symbols, and scores stay right."""
    monkeypatch.setattr(hmm, "FAST", 100)
    d = spark.createDataFrame([(i, f"u{2 * i} u{2 * i + 1}") for i in range(1000)], "doc_id long, text string")
    lex = hmm.lexicon(hmm.word_counts(d), 1000)
    assert 50 < len(lex.words) <= 130 and lex.distinct == 2001 and lex.seen.sum() == 3000


def test_noisy_or_gradient():
    """The slope against brute noisy-or and finite differences."""
    rng = np.random.default_rng(3)
    bags = [[[0, 2], [1]], [[3], [], [0, 1, 3]], [[]], [[2, 3]], []]
    y, w, b = np.array([1, 0, 1, 0, 0]), rng.normal(size=4), -0.7
    x, sentence = np.array([f for d in bags for s in d for f in s]), np.repeat(np.arange(7), [len(s) for d in bags for s in d])
    doc = np.repeat(np.arange(5), [len(d) for d in bags])

    def brute(w, b):
        loss = 0.0
        for d, label in zip(bags, y, strict=True):
            q = math.prod(1 - 1 / (1 + math.exp(-(b + sum(w[f] for f in s)))) for s in d)
            loss -= math.log(1 - q if label else q)
        return loss

    by_weight, by_bias, loss = toxicity.slope(w, b, x, sentence, doc, y)
    step = 1e-6
    assert loss == pytest.approx(brute(w, b))
    assert by_bias == pytest.approx((brute(w, b + step) - brute(w, b - step)) / (2 * step), rel=1e-4)
    for k in range(4):
        e = np.eye(4)[k] * step
        assert by_weight[k] == pytest.approx((brute(w + e, b) - brute(w - e, b)) / (2 * step), rel=1e-4)


def test_toxicity_sample_is_bounded_by_documents(spark):
    d = spark.createDataFrame([(1, f"text {i} vile") for i in range(30)] + [(i, "plain words") for i in range(2, 60)] * 3, "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i == 1)) for i in range(60)], "doc_id long, toxic int")
    rows = toxicity.labelled(d, y, "doc_id", "text", "toxic", 20)
    assert rows.count() == 20 and toxicity.labelled(d, y, "doc_id", "text", "toxic", 1000).count() == 30 * (zlib.crc32(b"1") % 5 != 0) + sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(2, 60))


def brute_quality(t):
    w = SPLIT.findall(t)
    seen, dup = set(), 0
    for x in t.split("\n"):
        if SPLIT.search(x):
            dup += x in seen
            seen.add(x)
    win = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + j for k in range(len(w) - 2) if win[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality_base_and_outliers(spark, docs, nothing):
    rng = np.random.default_rng(6)
    plain = [" ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(120)) for _ in range(200)]
    odd = [" ".join(w + "###" for w in t.split()).upper() for t in plain[:6]]
    d = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(plain + odd)], "doc_id long, text string, lang string, source string").unionByName(docs.select("doc_id", "text", "lang", "source"))
    got = quality.verdicts(d).collect()
    assert len(got) == d.count()
    plainly = {r.doc_id: r for r in quality.verdicts(d.where("source = 's'")).collect()}
    assert all(plainly[i].kept for i in range(200)) and not any(plainly[200 + i].kept for i in range(6))
    want = {(r.doc_id, *brute_quality(r.text or "")) for r in d.collect()}
    assert {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == want
    assert quality.verdicts(nothing).count() == 0 and quality.verdicts(docs).count() == docs.count()


def brute_mcd(x, h=0.75, sigmas=3.0):
    """The minimum-covariance-determinant estimate by concentration steps on whole rows, and the cutoff, from their definitions."""
    n, floor = len(x), np.diag(np.square(quality.FLOOR))
    median = np.median(x, 0)
    first = [(median, np.diag((1.4826 * np.median(abs(x - median), 0)) ** 2) + floor), (x.mean(0), np.cov(x.T, bias=True) + floor), (median, np.eye(x.shape[1]))]
    found = []
    for center, cov in first:
        for _ in range(50):
            d = np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(cov), x - center)
            near = x[np.argsort(d)[: math.ceil(h * n)]]
            center, cov = near.mean(0), np.cov(near.T, bias=True) + floor
        found.append((np.linalg.slogdet(cov)[1], center, cov))
    _, center, cov = min(found, key=lambda f: f[0])
    d = np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(cov), x - center)
    low, high = np.quantile(np.log(d), [0.5, 0.75])
    return d, math.exp(low + sigmas / 0.6745 * (high - low))


def test_estimates_match_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal([1.5, 0.1, 0.2, 0.3, 0.1, 0.1], [0.2, 0.05, 0.1, 0.1, 0.1, 0.02], (1200, 6)) @ (np.eye(6) + rng.normal(0, 0.2, (6, 6)))
    x[:100] += [2, 1, 1, 0, 0, 1]  # a cluster of outliers that pulls the mean
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x] + [("h", *map(float, r + 1)) for r in x[200:900]], "grp string, " + ", ".join(f"{c} double" for c in quality.STATS))
    fit = {r.grp: r for r in quality.estimates(rows).collect()}
    for grp, part in (("g", x), ("h", x[200:900] + 1)):
        d, cutoff = brute_mcd(part)
        mine = np.einsum("ij,jk,ik->i", part - fit[grp].center, np.array(fit[grp].inverse).reshape(6, 6), part - fit[grp].center)
        assert np.median(abs(mine / d - 1)) < 0.08 and fit[grp].cutoff == pytest.approx(cutoff, rel=0.25)
        assert np.mean((mine <= fit[grp].cutoff) == (d <= cutoff)) > 0.99


def test_quality_of_a_very_long_text(spark):
    long = "one two three\n" * 3 + " ".join(f"w{i}" for i in range(700_000)) + "\n \none two three\n"
    rows = [(1, long, "en", "s"), (2, "x", "en", "s"), (3, None, None, None)]
    got = {r.doc_id: r for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert tuple(got[1])[1:7] == brute_quality(long) and got[1].kept and got[1].distance is None and not got[3].kept


def brute_hits(docs, items, window=10):
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (g := wins.get(tuple(w[k : k + n]))) is not None:
                    found |= g
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination(spark, docs, nothing, block):
    sample = docs.select("doc_id", "text").collect()
    long = [r.text for r in sample if r.text and len(r.text.split()) > 25][:5]
    items = [(k, " ".join(t.split()[3:20])) for k, t in enumerate(long)] + [(50, "one two"), (51, ""), (52, None), (7, "a b " * 40), (8, "the house"), (8, "of water")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.matches(docs, bench, block_bytes=block)
    got = decontaminate.report(found).drop("longest").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_hits([(r.doc_id, r.text) for r in sample], items), key=str)
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not r.contaminated for r in got)
    assert decontaminate.matches(nothing, bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_longest_match(spark):
    text = " ".join(f"w{i}" for i in range(40))
    d = spark.createDataFrame([(1, "zz " + " ".join(f"w{i}" for i in range(5, 30)) + " yy w31 w32"), (2, text)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.matches(d, spark.createDataFrame([("i", text)], "item_id string, text string")).collect()}
    assert (got[1].longest, got[1].longest_at, got[1].longest_item) == (25, 1, "i") and got[2].longest == 40


def test_decontamination_of_repeated_words(spark):
    """Equal places stay a range: the work follows the words."""
    items = decontaminate.prepared(["i"], [" ".join(["a b"] * 100)], 10)
    data = np.frombuffer(("a b " * 30_000).encode(), np.uint8)
    began = time.time()
    x, where, end, _ = decontaminate.ids_of(items, data, np.array([0, len(data)]))
    place, _, _, once, longest, _ = decontaminate.shard_matches(items, x, end)
    assert len(place) == len(once) == 59_991 and longest.max() == 200 and time.time() - began < 3


def test_decontamination_of_long_texts_and_odd_columns(spark, docs):
    passage = " ".join(f"p{i}" for i in range(12))
    long = " ".join(f"w{i % 50_000}" for i in range(700_000))
    rows = [(1, f"{long} {passage} {long}", "u"), (2, long, "u"), (3, None, "u"), (4, passage, "u"), (4, passage, "u")]
    d = spark.createDataFrame(rows, "doc_id long, text string, key_ string")
    bench = spark.createDataFrame([("x", passage), ("y", "p3 p4"), ("z", passage.replace("p5", "q5"))], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.matches(d, bench).collect()}
    assert (got[1].n_hit, got[1].longest, got[1].longest_at, got[1].items, got[2].n_hit) == (12, 12, 700_000, ["x", "y"], 0)
    for block in (1 << 20, 10):
        left = decontaminate.clean(d, bench, block_bytes=block).collect()
        assert sorted((r.doc_id, r.key_) for r in left) == [(2, "u"), (3, "u")]
