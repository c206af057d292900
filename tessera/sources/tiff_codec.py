"""TIFF files as bytes: directories, strips and tiles, and the codecs that need no outside library.

Classic and big files in either byte order; uncompressed, DEFLATE, LZW and PackBits data; the horizontal predictor. JPEG kinds
raise an error that names them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

#: Tag numbers, field types (size, struct code), compressions.
TAGS = {256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression", 262: "PhotometricInterpretation", 270: "ImageDescription", 273: "StripOffsets", 277: "SamplesPerPixel", 278: "RowsPerStrip", 279: "StripByteCounts", 284: "PlanarConfiguration", 317: "Predictor", 322: "TileWidth", 323: "TileLength", 324: "TileOffsets", 325: "TileByteCounts", 339: "SampleFormat"}
NUMBER = {v: k for k, v in TAGS.items()}
TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q"), 17: (8, "q")}
NONE, LZW, JPEG_OLD, JPEG, DEFLATE, DEFLATE_OLD, PACK_BITS = 1, 5, 6, 7, 8, 32946, 32773
CODECS = {"NONE": NONE, "LZW": LZW, "DEFLATE": DEFLATE, "PACK_BITS": PACK_BITS}


class TiffError(ValueError):
    """The bytes aren't a TIFF file, or one that can't be decoded here."""


@dataclass
class Directory:
    order: str
    tags: dict[int, tuple] = field(default_factory=dict)

    def get(self, name: str, default=None):
        v = self.tags.get(NUMBER[name])
        return default if v is None else v[0] if len(v) == 1 else v

    def many(self, name: str) -> tuple:
        return self.tags.get(NUMBER[name], ())

    @property
    def width(self) -> int:
        return self.get("ImageWidth", 0)

    @property
    def height(self) -> int:
        return self.get("ImageLength", 0)

    @property
    def channels(self) -> int:
        return self.get("SamplesPerPixel", 1)

    @property
    def tiled(self) -> bool:
        return NUMBER["TileOffsets"] in self.tags

    @property
    def dtype(self) -> np.dtype:
        bits = set(self.many("BitsPerSample") or (1,))
        kind = (self.many("SampleFormat") or (1,))[0]
        if len(bits) != 1:
            raise TiffError("samples of different sizes")
        n = bits.pop()
        if n == 1:
            return np.dtype(bool)
        code = {1: "u", 2: "i", 3: "f"}.get(kind)
        if code is None or n not in (8, 16, 32, 64):
            raise TiffError(f"{n}-bit samples of format {kind}")
        return np.dtype(f"{self.order if n > 8 else '|'}{code}{n // 8}")

    @property
    def description(self) -> str:
        v = self.tags.get(NUMBER["ImageDescription"])
        return b"".join(v).rstrip(b"\0").decode("utf-8", "replace") if v else ""

    def block(self) -> tuple[int, int]:
        return (self.get("TileWidth"), self.get("TileLength")) if self.tiled else (self.width, min(self.get("RowsPerStrip", self.height) or self.height, self.height))

    def as_map(self) -> dict[str, str]:
        show = lambda v: b"".join(v).rstrip(b"\0").decode("utf-8", "replace") if v and isinstance(v[0], bytes) else str(v[0]) if len(v) == 1 else ",".join(map(str, v))
        return {TAGS.get(k, str(k)): show(v) for k, v in self.tags.items()}


def directories(data: bytes) -> list[Directory]:
    """All image directories of a file."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise TiffError("not a TIFF file")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    big = magic == 43
    if magic not in (42, 43):
        raise TiffError("not a TIFF file")
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    out, seen = [], set()
    try:
        while at:
            if at in seen:
                raise TiffError("directories form a loop")
            seen.add(at)
            n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
            at += 8 if big else 2
            d = Directory(order)
            for _ in range(n):
                tag, kind = struct.unpack_from(order + "HH", data, at)
                count = struct.unpack_from(order + ("Q" if big else "I"), data, at + 4)[0]
                size, code = TYPES.get(kind, (0, ""))
                inline = 8 if big else 4
                where = at + (12 if big else 8)
                if size * count > inline:
                    where = struct.unpack_from(order + ("Q" if big else "I"), data, where)[0]
                if size:
                    d.tags[tag] = struct.unpack_from(f"{order}{count * len(code)}{code[0]}", data, where)
                at += 20 if big else 12
            out.append(d)
            at = struct.unpack_from(order + ("Q" if big else "I"), data, at)[0]
    except struct.error as e:
        raise TiffError("the file is cut off") from e
    return out


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = 1
        while n < 128 and i + n < len(data) and data[i + n] == data[i]:
            n += 1
        if n > 2:
            out += bytes([257 - n, data[i]])
            i += n
            continue
        j = i + 1
        while j < len(data) and j - i < 128 and not (j + 2 < len(data) and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    out, table, width, hold, held, last = bytearray(), [], 9, 0, 0, None
    for byte in data:
        hold, held = hold << 8 | byte, held + 8
        while held >= width:
            code = hold >> (held - width)
            held -= width
            hold &= (1 << held) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
                continue
            if last is None:
                entry = table[code] if table else bytes([code])
                table = table or [bytes([i]) for i in range(256)] + [b"", b""]
            else:
                entry = table[code] if code < len(table) else last + last[:1]
                table.append(last + entry[:1])
            out += entry
            last = entry
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, hold, held = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal hold, held
        hold, held = hold << width | code, held + width
        while held >= 8:
            out.append(hold >> (held - 8) & 255)
            held -= 8
        hold &= (1 << held) - 1

    table, width, word = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, width)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = len(table) + 2
        if len(table) + 2 > (1 << width) - 1 and width < 12:
            width += 1
        if len(table) + 2 >= 4094:
            put(256, width)
            table, width = {bytes([k]): k for k in range(256)}, 9
        word = data[i : i + 1]
    if word:
        put(table[word], width)
        if len(table) + 3 > (1 << width) - 1 and width < 12:
            width += 1
    put(257, width)
    if held:
        out.append(hold << (8 - held) & 255)
    return bytes(out)


def _decode(d: Directory, raw: bytes, w: int, h: int, channels: int) -> np.ndarray:
    kind = d.get("Compression", NONE)
    if kind == LZW:
        raw = lzw_decode(raw)
    elif kind in (DEFLATE, DEFLATE_OLD):
        raw = zlib.decompress(raw)
    elif kind == PACK_BITS:
        raw = unpack_bits(raw)
    elif kind != NONE:
        raise TiffError(f"compression {kind} (JPEG kinds among them) can't be decoded here")
    if d.dtype == bool:
        line = -(-w * channels // 8)
        bits = np.unpackbits(np.frombuffer(raw[: line * h], np.uint8).reshape(-1, line), axis=1)[:, : w * channels]
        return bits.reshape(-1, w, channels).astype(bool)
    size = w * h * channels * d.dtype.itemsize
    out = np.frombuffer(raw[:size].ljust(size, b"\0"), d.dtype).reshape(h, w, channels)
    if d.get("Predictor", 1) == 2:
        out = np.cumsum(out.astype(d.dtype.newbyteorder("=")), axis=1, dtype=d.dtype.newbyteorder("="))
    return out


def blocks(d: Directory, area: tuple[int, int, int, int] | None = None) -> list[tuple[int, int, int, int, int, int]]:
    """(index, plane, x, y, w, h) of the tiles or strips that meet an area (x, y, w, h); all by default."""
    bw, bh = d.block()
    across, down = -(-d.width // bw), -(-d.height // bh)
    planes = d.channels if d.get("PlanarConfiguration", 1) == 2 else 1
    x0, y0, w, h = area or (0, 0, d.width, d.height)
    out = []
    for p in range(planes):
        for j in range(max(0, y0 // bh), min(down, -(-(y0 + h) // bh))):
            for i in range(max(0, x0 // bw), min(across, -(-(x0 + w) // bw))):
                out.append((p * across * down + j * across + i, p, i * bw, j * bh, bw, bh if d.tiled else min(bh, d.height - j * bh)))
    return out


def read(data: bytes, d: Directory, area: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """An area (x, y, w, h) as an array (h, w, channels), zero outside the image; only blocks that meet it are decoded."""
    x0, y0, w, h = area or (0, 0, d.width, d.height)
    out = np.zeros((h, w, d.channels), d.dtype.newbyteorder("=") if d.dtype != bool else bool)
    where, sizes = (d.many("TileOffsets"), d.many("TileByteCounts")) if d.tiled else (d.many("StripOffsets"), d.many("StripByteCounts"))
    planar = d.get("PlanarConfiguration", 1) == 2
    for index, p, bx, by, bw, bh in blocks(d, (x0, y0, w, h)):
        if not sizes[index]:
            continue
        part = _decode(d, data[where[index] : where[index] + sizes[index]], bw, bh, 1 if planar else d.channels)
        ax, ay, zx, zy = max(bx, x0, 0), max(by, y0, 0), min(bx + bw, x0 + w, d.width), min(by + bh, y0 + h, d.height)
        if ax < zx and ay < zy:
            seen = part[ay - by : zy - by, ax - bx : zx - bx]
            out[ay - y0 : zy - y0, ax - x0 : zx - x0, p : p + 1 if planar else d.channels] = seen
    return out


def encode_block(part: np.ndarray, compression: str = "DEFLATE", predictor: bool = False, order: str = "<") -> bytes:
    """The bytes of a tile or strip (h, w, channels) of whole size."""
    if compression not in CODECS:
        raise TiffError(f"compression {compression} can't be written here; {', '.join(CODECS)} can")
    kind = part.dtype.newbyteorder("=")
    if kind == bool:
        part, kind = part.astype(np.uint8) * 255, np.dtype(np.uint8)
    if predictor and kind.kind != "f":
        part = part.astype(kind)
        part[:, 1:] = np.diff(part, axis=1)
    raw = part.astype(kind.newbyteorder(order)).tobytes()
    return {"NONE": lambda r: r, "DEFLATE": zlib.compress, "LZW": lzw_encode, "PACK_BITS": pack_bits}[compression](raw)


def _started(order: str, big: bool, before: bytes) -> tuple[str, bool]:
    """The byte order and size kind, those of the file before if there is one."""
    return ("<" if before[:2] == b"II" else ">", struct.unpack_from(("<" if before[:2] == b"II" else ">") + "H", before, 2)[0] == 43) if before else (order, big)


def write(image: np.ndarray, compression: str = "DEFLATE", tile: int | None = 256, predictor: bool = False, description: str = "", order: str = "<", big: bool = False, before: bytes = b"") -> bytes:
    """A file with the image (h, w, channels), after the images of the file `before` if given (which sets order and size kind)."""
    order, big = _started(order, big, before)
    h, w, channels = image.shape
    bw, bh = (tile, tile) if tile else (w, max(1, min(h, (1 << 16) // max(1, w * channels * image.dtype.itemsize))))

    def encoded():
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                part = np.zeros((bh if tile else min(bh, h - y), bw, channels), image.dtype)
                seen = image[y : y + bh, x : x + bw]
                part[: seen.shape[0], : seen.shape[1]] = seen
                yield encode_block(part, compression, predictor, order)

    return assemble(encoded(), w, h, channels, image.dtype, compression, tile, predictor, description, order, big, before)


def assemble(encoded: Iterable[bytes], w: int, h: int, channels: int, dtype: np.dtype, compression: str = "DEFLATE", tile: int | None = 256, predictor: bool = False, description: str = "", order: str = "<", big: bool = False, before: bytes = b"") -> bytes:
    """The file of write() from its blocks' bytes, by rows."""
    if compression not in CODECS:
        raise TiffError(f"compression {compression} can't be written here; {', '.join(CODECS)} can")
    order, big = _started(order, big, before)
    kind = np.dtype(np.uint8) if dtype == bool else np.dtype(dtype).newbyteorder("=")
    code = {"u": 1, "i": 2, "f": 3}[kind.kind]
    predictor = predictor and kind.kind != "f"
    bw, bh = (tile, tile) if tile else (w, max(1, min(h, (1 << 16) // max(1, w * channels * kind.itemsize))))
    word, word_type, count_code, entry = ("Q", 16, "Q", 20) if big else ("I", 4, "H", 12)
    body = bytearray(before or ((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0))))
    where, sizes = [], []
    for raw in encoded:
        where.append(len(body))
        sizes.append(len(raw))
        body += raw + b"\0" * (len(raw) % 2)
    tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [kind.itemsize * 8] * channels), 259: (3, [CODECS[compression]]), 262: (3, [2 if channels >= 3 else 1]), 277: (3, [channels]), 284: (3, [1]), 339: (3, [code] * channels)}
    tags |= {322: (4, [bw]), 323: (4, [bh]), 324: (word_type, where), 325: (word_type, sizes)} if tile else {273: (word_type, where), 278: (4, [bh]), 279: (word_type, sizes)}
    if predictor:
        tags[317] = (3, [2])
    if description:
        tags[270] = (2, list(description.encode() + b"\0"))
    start = len(body) + len(body) % 2
    body += b"\0" * (start - len(body))
    extra = start + struct.calcsize(order + count_code) + entry * len(tags) + struct.calcsize(order + word)
    ifd, tail = bytearray(struct.pack(order + count_code, len(tags))), bytearray()
    for tag in sorted(tags):
        t, values = tags[tag]
        packed = bytes(values) if t == 2 else struct.pack(f"{order}{len(values)}{TYPES[t][1]}", *values)
        inline = struct.calcsize(order + word)
        if len(packed) > inline:
            place = struct.pack(order + word, extra + len(tail))
            tail += packed + b"\0" * (len(packed) % 2)
        else:
            place = packed.ljust(inline, b"\0")
        ifd += struct.pack(order + "HH" + word, tag, t, len(values)) + place
    body += ifd + struct.pack(order + word, 0) + tail
    link = 8 if big else 4
    at = struct.unpack_from(order + word, body, link)[0]
    while at:
        n = struct.unpack_from(order + count_code, body, at)[0]
        link = at + struct.calcsize(order + count_code) + entry * n
        at = struct.unpack_from(order + word, body, link)[0]
    struct.pack_into(order + word, body, link, start)
    return bytes(body)
