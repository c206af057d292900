"""Secret scans: pattern spans, and candidates confirmed by the structure of what they decode to.

Patterns find assignments, access keys and long hex runs. Confirmation adds spans whose decoded content proves itself:
base64 or hex that decodes to a nested DER structure whose lengths all fit, to a length-prefixed SSH key blob, or a
signed token whose header decodes to JSON that names an algorithm; and armoured keys whose body decodes.
DER that nests deeper than MAX_DEPTH is none: keys nest a few levels, and the depth bounds the recursion.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns. Case is ignored in the names of an assignment only, in ASCII.
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "armour", "token", "der", "ssh")

_ARMOUR = re.compile(rb"-----BEGIN ([A-Z0-9 ]*KEY(?: BLOCK)?)-----")
_HEADER = re.compile(rb"(?m)^[A-Za-z][A-Za-z-]*:\x20.*$")
_BREAK = rb"(?:\\r|\\n|[\r\n])+[\x20\t]*"
#: A header is a JSON object: a brace, then a quote or white space, in the letters they become.
_HEADS = (b"eyJ", b"eyA", b"ewo", b"ewk", b"ew0")
_TOKEN = re.compile(rb"e(?:y[JA]|w[ok0])[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: Where base64 can hold a key: 0x30 and a length, or a field's length of three zero bytes, in the letters they become.
_START64 = re.compile(rb"M[A-I][A-Za-z0-9+/_-]|AAAA[A-Z]")
_RUN64 = re.compile(rb"[A-Za-z0-9+/_-]+(?:" + _BREAK + rb"[A-Za-z0-9+/_-]+)*")
_BREAKS = re.compile(_BREAK)
_HEX_RUN = re.compile(rb"(?i:[0-9a-f]{24,})")
_START_HEX = re.compile(rb"(?i:30|000000[0-9a-f]{2}(?:7373682d|6563647361|736b2d))")
_LEAST_KEY = 24
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_SSH = (b"ssh-", b"ecdsa-", b"sk-")
#: Fields of a key blob by the beginning of its type.
_FIELDS = ((b"ssh-rsa", 3), (b"ssh-dss", 5), (b"ssh-ed25519", 2), (b"ssh-ed448", 2), (b"ecdsa-", 3), (b"sk-ssh-", 3), (b"sk-ecdsa-", 4))
MAX_DEPTH = 16


def decoded64(raw: bytes) -> bytes | None:
    """The bytes of standard or URL-safe base64, padded or not; None if it is none."""
    body = raw.rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + b"=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """(length, first content byte) of the DER element whose length field starts at `at`."""
    if at >= len(data):
        return None
    n = data[at]
    if n < 0x80:
        return n, at + 1
    k = n & 0x7F
    if not 1 <= k <= 4 or at + 1 + k > len(data) or data[at + 1] == 0:
        return None
    n = int.from_bytes(data[at + 1 : at + 1 + k], "big")
    return (n, at + 1 + k) if n >= 0x80 else None


def der_fits(data: bytes, lo: int, hi: int, depth: int = 0) -> bool:
    """Whether lo:hi is a row of DER elements of known tags, with every nested length exact."""
    if depth > MAX_DEPTH:
        return False
    while lo < hi:
        tag, found = data[lo], der_length(data, lo + 1)
        if found is None or not (tag & 0xC0 == 0x80 or tag in (1, 2, 3, 4, 5, 6, 10, 12, 19, 20, 22, 23, 24, 0x30, 0x31)):
            return False
        n, body = found
        if body + n > hi or (tag in (0x30, 0x31) or tag & 0xE0 == 0xA0) and not der_fits(data, body, body + n, depth + 1):
            return False
        lo = body + n
    return lo == hi


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE that fills the data, holds an INTEGER, an OID or a SEQUENCE first, and nests exactly."""
    if len(data) < 12 or data[0] != 0x30:
        return False
    found = der_length(data, 1)
    return found is not None and found[1] + found[0] == len(data) and data[found[1]] in (0x02, 0x06, 0x30) and der_fits(data, 0, len(data))


def is_ssh_key(data: bytes) -> bool:
    """Length-prefixed fields that fill the data, the first a key type."""
    at, fields = 0, 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if fields == 0 and not data[4 : 4 + n].startswith(_SSH):
            return False
        at, fields = at + 4 + n, fields + 1
    return fields >= 2 and at == len(data)


def key_size(head: bytes) -> int:
    """How many bytes the DER key that starts here has by its own header; 0 if none can."""
    if head[:1] != b"0":
        return 0
    found = der_length(head, 1)
    return found[1] + found[0] if found and head[found[1] : found[1] + 1] in (b"\x02", b"\x06", b"0") else 0


def has_two(data: bytes) -> bool:
    """Whether a DER sequence has more than one element, as keys do."""
    inside = der_length(data, 1)[1]
    n, body = der_length(data, inside + 1)
    return body + n < len(data)


def ssh_size(data: bytes) -> int:
    """How many bytes the SSH key blob that starts here has by the fields of its type; 0 if it is none."""
    kind = data[4 : 4 + int.from_bytes(data[:4], "big")]
    fields = next((n for name, n in _FIELDS if kind.startswith(name)), 0)
    at = 0
    for _ in range(fields):
        if at + 4 > len(data):
            return 0
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at if at <= len(data) else 0


def key_at(at: int, whole: int, read) -> tuple[int, int] | None:
    """(kind, bytes) of the key at `at` of a run of `whole` bytes. read(n): at most n bytes from there."""
    size = key_size(read(8))
    if size and size <= whole:
        data = read(size)
        if is_der_key(data) and (at == 0 and size == whole or size >= _LEAST_KEY and has_two(data)):
            return 5, size
    head = read(64)
    if head[:3] == b"\0\0\0" and head[4:].startswith(_SSH):
        data = read(whole)
        size = len(data) if at == 0 and is_ssh_key(data) else ssh_size(data)
        if size >= _LEAST_KEY:
            return 6, size
    return None


def keys64(text: bytes) -> Iterator[tuple[int, int, int]]:
    """Keys in base64, from any start in a run, also over line breaks, real or escaped."""
    end, done = -1, -1
    for m in _START64.finditer(text):
        p = m.start()
        if p < done:
            continue
        if p >= end:
            run = _RUN64.match(text, p)
            end = run.end()
            gaps = np.array([g for b in _BREAKS.finditer(run[0]) for g in range(*b.span())], np.int64)
            body = np.delete(np.frombuffer(run[0], np.uint8), gaps).tobytes().translate(bytes.maketrans(b"-_", b"+/"))
            where = np.delete(np.arange(p, end), gaps)
        k = int(np.searchsorted(where, p))
        if len(body) - k < 32 or where[k] != p:
            continue

        def read(n: int, k: int = k, body: bytes = body) -> bytes:
            part = body[k : k + -(-n * 4 // 3)]
            part = part[: len(part) - (len(part) % 4 == 1)]
            return base64.b64decode(part + b"=" * (-len(part) % 4))[:n]

        found = key_at(k, (len(body) - k) * 3 // 4, read)
        if found:
            chars = -(-found[1] * 4 // 3)
            done = int(where[k + chars - 1]) + 1
            pad = -chars % 4
            while pad and text[done : done + 1] == b"=":
                done, pad = done + 1, pad - 1
            yield p, found[0], done


def keys16(text: bytes) -> Iterator[tuple[int, int, int]]:
    """Keys in hex, from any start in a run, at odd places and of odd lengths too."""
    for m in _HEX_RUN.finditer(text):
        raw, p = m[0], 0
        while start := _START_HEX.search(raw, p):
            k = start.start()
            found = key_at(k, (len(raw) - k) // 2, lambda n, k=k, raw=raw: bytes.fromhex(raw[k : k + min(2 * n, (len(raw) - k) // 2 * 2)].decode()))
            if found:
                yield m.start() + k, found[0], m.start() + k + 2 * found[1]
            p = k + 2 * found[1] if found else k + 1


def is_armoured(label: bytes, inside: bytes) -> bool:
    """Whether what stands between the lines of an armour is a key: DER, OpenSSH's, OpenPGP's, or one that headers call encrypted."""
    inside = inside.replace(b"\\r", b"\r").replace(b"\\n", b"\n").replace(b"\r", b"\n")
    headers = _HEADER.findall(inside)
    packed = re.sub(rb"\s+", b"", re.sub(rb"\n=[A-Za-z0-9+/]{4}\s*$", b"", _HEADER.sub(b"", inside)))
    body = decoded64(packed) if len(packed) >= 16 else None
    if not body:
        return False
    if label.endswith(b"BLOCK"):
        return body[0] >= 0x80
    return is_der_key(body) or body.startswith(b"openssh-key-v1\0") or any(h.startswith(b"DEK-Info:") for h in headers)


def is_signed_token(raw: bytes) -> bool:
    """Three base64url parts of which the first is a JSON header with an algorithm and the second is JSON."""
    head, body, _ = raw.split(b".")
    try:
        header, claims = (json.loads(decoded64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in bytes."""
    out = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def confirmed_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what decoding confirms, in bytes."""
    out = []
    if b"-----BEGIN " in text:
        for m in _ARMOUR.finditer(text):
            close, line = text.find(b"-----", m.end()), b"-----END " + m[1] + b"-----"
            if close >= 0 and text.startswith(line, close) and is_armoured(m[1], text[m.end() : close]):
                out.append((m.start(), 3, close + len(line)))
    if any(x in text for x in _HEADS):
        out += [(m.start(), 4, m.end()) for m in _TOKEN.finditer(text) if is_signed_token(m[0])]
    return [*out, *keys64(text), *keys16(text)]


def _run(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        rows: list[list] = [[], [], [], [], []]
        for value in batch.column(1):
            text = value.as_buffer().to_pybytes() if value.is_valid else b""
            base = base_spans(text)
            spans = sorted({*base, *confirmed_spans(text)})
            counts = [0, 0, 0]
            for _, k, _ in base:
                counts[k] += 1
            if not spans:
                for r, v in zip(rows, (0, 0, 0, nothing, ""), strict=True):
                    r.append(v)
                continue
            if text.isascii():
                point = lambda i: i
            else:
                heads = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                point = lambda i, heads=heads: int(heads[i])
            spell = lambda found, point=point: ",".join(f"{KINDS[k]}:{point(a)}:{point(b)}" for a, k, b in found)
            for r, v in zip(rows, (*counts, hashlib.sha256(spell(sorted(base)).encode()).hexdigest(), spell(spans)), strict=True):
                r.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, pa.int64()) for r in rows[:3]), *(pa.array(r, pa.string()) for r in rows[3:])], names=names)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans) and spans (all, kind:start:end in code points, by start and kind).

    Null and empty texts have no spans. Rows that repeat come back as often; other columns are ignored. One pass, no shuffle.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    zero = F.lit(0).cast("long")
    schema = src.select("doc_id", zero.alias("n_assign"), zero.alias("n_access"), zero.alias("n_hex"), F.lit("").alias("base_sha256"), F.lit("").alias("spans")).schema
    return src.mapInArrow(lambda batches, names=schema.names: _run(batches, names), schema)


def exploded(found: DataFrame) -> DataFrame:
    """A row for each span of scan(): doc_id, kind, start, end."""
    part = F.split("span", ":")
    rows = found.where("spans != ''").select("doc_id", F.explode(F.split("spans", ",")).alias("span"))
    return rows.select("doc_id", part[0].alias("kind"), part[1].cast("long").alias("start"), part[2].cast("long").alias("end"))
