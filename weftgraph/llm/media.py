"""Media columns: payloads in progressive JPEG, decoded to coefficients and full-resolution RGB tensors.

The unit that holds a payload losslessly is the quantised DCT coefficient: 64 bytes fill a block of
a 4:2:0 image, each as a coefficient of magnitude 2 to 129. The image is coded progressively: DC,
then two spectral bands of AC, all without their lowest bit, then that bit for DC and AC by
successive approximation. The Huffman tables give every coefficient the same number of bits, code and
value together, so that the coder and its decoder work on whole arrays. The decoder reads any
Huffman-coded progressive JPEG of 8 bits with one or three components; scans of other tables go through the
standard's procedures symbol by symbol. Decoding accumulates all scans into coefficient arrays,
inverse-transforms in numpy, repeats chroma samples to full resolution and converts to RGB.

Defined cases: null or empty text is one unit of 576 bytes of 255; equal texts give equal media and
features; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import bounded_batches, cut, tidy, two_columns

UNIT = 576
#: Bytes of media that are read into one Arrow batch of tensors, which take twice as much; a larger one has a batch of its own.
READ_BYTES = 1 << 20
BANDS = ((1, 5), (6, 63))
_BYTES = np.arange(256)
#: The coefficient of each byte: -2..-129 for the lower half, 2..129 for the upper.
VALUE = np.where(_BYTES < 128, -(_BYTES + 2), _BYTES - 126)


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order: diagonals, alternately up and down."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


# ---- tables of equal width: symbol of size s has a code of width - s bits ----


def _table(sizes: list[int], width: int, extra: list[tuple[int, int]] = ()) -> tuple[bytes, bytes]:
    """Counts by length and symbols, as in a DHT segment."""
    pairs = sorted([(width - s, s) for s in sizes] + list(extra))
    counts = bytes(sum(1 for n, _ in pairs if n == k) for k in range(1, 17))
    return counts, bytes(s for _, s in pairs)


DC_TABLE = _table(list(range(9)), 9)
AC_TABLE = _table(list(range(1, 8)), 8, [(8, 0)])
REFINE_TABLE = _table([], 0, [(1, 0)])


def huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """Symbol by (length, code), codes in canonical order."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _coded(table: tuple[bytes, bytes], width: int, values: range) -> dict[int, int]:
    """Code and value bits of each value, as one number of width bits."""
    codes = {s: (n, c) for (n, c), s in huffman(*table).items()}
    out = {}
    for v in values:
        s = abs(v).bit_length()
        if s in codes and codes[s][0] + s == width:
            out[v] = codes[s][1] << s | (v if v >= 0 else v + (1 << s) - 1)
    return out


@functools.cache
def _luts() -> dict[str, np.ndarray]:
    ac = _coded(AC_TABLE, 8, [v for v in range(-127, 128) if v])
    dc = _coded(DC_TABLE, 9, range(-255, 256))
    out = {"ac_code": np.array([ac[int(np.sign(v)) * (abs(v) >> 1)] for v in VALUE.tolist()], np.uint8), "ac_low": (np.abs(VALUE) & 1).astype(np.uint8)}
    back = np.full(256, 0, np.int16)
    back[list(ac.values())] = list(ac)
    dc_code, dc_back = np.zeros(511, np.uint16), np.full(512, 999, np.int16)
    dc_code[np.array(list(dc)) + 255] = list(dc.values())
    dc_back[list(dc.values())] = list(dc)
    byte = np.zeros(260, np.uint8)
    byte[VALUE + 130] = _BYTES
    return out | {"ac_back": back, "dc_code": dc_code, "dc_back": dc_back, "byte": byte}


def _packed(bits: np.ndarray) -> bytes:
    """Bits as bytes, the last filled with ones."""
    return np.packbits(np.append(bits.ravel(), np.ones(-bits.size % 8, np.uint8))).tobytes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan(component: int, tables: int, first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([1, component, tables, first, last, high << 4 | low])) + data.replace(b"\xff", b"\xff\x00")


def _head(mw: int, mh: int, n_bytes: int) -> bytes:
    dht = b"".join(bytes([kind]) + t[0] + t[1] for kind, t in ((0x00, DC_TABLE), (0x10, AC_TABLE), (0x11, REFINE_TABLE)))
    frame = struct.pack(">BHHB", 8, 16 * mh, 16 * mw, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + _segment(0xFE, b"payload %d" % n_bytes) + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC2, frame) + _segment(0xC4, dht)


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload's bytes (a multiple of 64)."""
    lut, n = _luts(), len(payload) // 64
    mcus = math.ceil(n / 6)
    mw = math.ceil(math.sqrt(mcus))
    mh = math.ceil(mcus / mw)
    if max(mw, mh) > 4095:
        raise ValueError("payload exceeds what one JPEG can hold")
    blocks = np.full((6 * mw * mh, 64), 255, np.uint8)
    blocks[:n] = np.frombuffer(payload, np.uint8).reshape(n, 64)
    ends = np.array([0, 4, 5, 6]) * (mw * mh)
    dc = VALUE[blocks[:, 0]]
    codes, low = lut["ac_code"][blocks], lut["ac_low"][blocks]
    low[:, 0] = 0  # the code of a run of one block that only corrects
    corrections = np.packbits(low, axis=1)
    out = [_head(mw, mh, len(payload))]
    parts = [(c, slice(ends[c - 1], ends[c])) for c in (1, 2, 3)]
    for c, own in parts:
        diff = np.diff(dc[own] >> 1, prepend=0)
        bits = lut["dc_code"][diff + 255][:, None] >> np.arange(8, -1, -1, dtype=np.uint16) & 1
        out.append(_scan(c, 0x00, 0, 0, 0, 1, _packed(bits.astype(np.uint8))))
    for a, b in BANDS:
        out += [_scan(c, 0x00, a, b, 0, 1, codes[own, a : b + 1].tobytes()) for c, own in parts]
    for c, own in parts:
        out.append(_scan(c, 0x00, 0, 0, 1, 0, _packed((dc[own] & 1).astype(np.uint8))))
        out.append(_scan(c, 0x01, 1, 63, 1, 0, corrections[own].tobytes()))
    return b"".join(out) + b"\xff\xd9"


# ---- decoding ----


@dataclass
class Component:
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks of the padded plane
    high: int = 0
    own_wide: int = 0  # blocks that a scan of this component alone has
    own_high: int = 0
    coef: np.ndarray | None = None


@dataclass
class Image:
    width: int = 0
    height: int = 0
    note: bytes = b""
    components: dict[int, Component] = field(default_factory=dict)
    quants: dict[int, np.ndarray] = field(default_factory=dict)


_NEXT = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def decode(data: bytes) -> Image:
    """Coefficient arrays (zigzag order) of a progressive JPEG."""
    image, tables, at, restart = Image(), {}, 2, 0
    while at < len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            break
        if marker == 0xFF:
            at += 1
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            image.note = body
        elif marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                image.quants[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.float32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xC2:
            _frame(image, body)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only Huffman-coded progressive JPEG is read")
        elif marker == 0xDA:
            found = _NEXT.search(data, at)
            end = found.start() if found else len(data)
            pieces = _RESTART.split(data[at:end]) if restart else [data[at:end]]
            _read_scan(image, tables, body, [p.replace(b"\xff\x00", b"\xff") for p in pieces], restart)
            at = end
    return image


def _frame(image: Image, body: bytes) -> None:
    _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
    for k in range(n):
        ident, hv, quant = body[6 + 3 * k : 9 + 3 * k]
        image.components[ident] = Component(hv >> 4, hv & 15, quant)
    h, v = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
    mw, mh = math.ceil(image.width / (8 * h)), math.ceil(image.height / (8 * v))
    for c in image.components.values():
        c.wide, c.high = mw * c.h, mh * c.v
        c.own_wide, c.own_high = math.ceil(image.width * c.h / h / 8), math.ceil(image.height * c.v / v / 8)
        c.coef = np.zeros((c.wide * c.high, 64), np.int16)


def _read_scan(image: Image, tables: dict, body: bytes, pieces: list[bytes], restart: int) -> None:
    n = body[0]
    parts = [(image.components[body[1 + 2 * k]], body[2 + 2 * k]) for k in range(n)]
    first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
    c, ids = parts[0]
    if n == 1 and not restart and (c.own_wide, c.own_high) == (c.wide, c.high) and _whole_scan(c, tables, ids, pieces[0], first, last, high, low):
        return
    _slow_scan(image, tables, parts, pieces, restart, first, last, high, low)


def _whole_scan(c: Component, tables: dict, ids: int, data: bytes, first: int, last: int, high: int, low: int) -> bool:
    """Decode a scan of equal-width codes as an array; False if it isn't one."""
    lut, n, k = _luts(), len(c.coef), last - first + 1
    if first == 0 and high:
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n)
        c.coef[:, 0] |= bits.astype(np.int16) << low
    elif first == 0:
        if tables.get(ids >> 4) != DC_TABLE:
            return False
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=9 * n).reshape(n, 9)
        diff = lut["dc_back"][bits @ (1 << np.arange(8, -1, -1))]
        if (diff == 999).any():
            return False
        c.coef[:, 0] = np.cumsum(diff) << low
    elif high:
        if tables.get(0x10 | ids & 15) != REFINE_TABLE or (first, last) != (1, 63) or len(data) != 8 * n or not c.coef[:, 1:].all():
            return False
        bits = np.unpackbits(np.frombuffer(data, np.uint8).reshape(n, 8), axis=1)[:, 1:]
        ac = c.coef[:, 1:]
        ac += np.sign(ac) * (bits.astype(np.int16) << low)
    else:
        if tables.get(0x10 | ids & 15) != AC_TABLE or len(data) != n * k:
            return False
        values = lut["ac_back"][np.frombuffer(data, np.uint8).reshape(n, k)]
        if not values.all():
            return False
        c.coef[:, first : last + 1] = values << low
    return True


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0

    def get(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | (self.bits[self.at] if self.at < len(self.bits) else 1)
            self.at += 1
        return out

    def symbol(self, table: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.get(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such code")

    def value(self, size: int) -> int:
        v = self.get(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _slow_scan(image, tables, parts, pieces, restart, first, last, high, low) -> None:
    order: list[list[tuple[int, int]]] = []  # by unit: (part, block)
    if len(parts) == 1:
        c = parts[0][0]
        order = [[(0, y * c.wide + x)] for y in range(c.own_high) for x in range(c.own_wide)]
    else:
        c = parts[0][0]
        for y in range(c.high // c.v):
            for x in range(c.wide // c.h):
                order.append([(k, (y * p.v + dy) * p.wide + x * p.h + dx) for k, (p, _) in enumerate(parts) for dy in range(p.v) for dx in range(p.h)])
    codes = [(huffman(*tables[i >> 4]) if first == 0 and not high else None, huffman(*tables[0x10 | i & 15]) if first else None) for _, i in parts]
    step = restart or len(order)
    for piece, begin in zip(pieces, range(0, len(order), step)):
        bits, before, run = _Bits(piece), [0] * len(parts), 0
        for unit in order[begin : begin + step]:
            for k, at in unit:
                block = parts[k][0].coef[at]
                if first == 0 and high:
                    block[0] |= bits.get(1) << low
                elif first == 0:
                    before[k] += bits.value(bits.symbol(codes[k][0]))
                    block[0] = before[k] << low
                elif high:
                    run = _refine(bits, codes[k][1], block, first, last, low, run)
                else:
                    run = _first(bits, codes[k][1], block, first, last, low, run)


def _first(bits: _Bits, table: dict, block: np.ndarray, first: int, last: int, low: int, run: int) -> int:
    if run:
        return run - 1
    k = first
    while k <= last:
        r, s = divmod(bits.symbol(table), 16)
        if s:
            k += r
            value = bits.value(s)
            block[k] = abs(value) << low if value > 0 else -(abs(value) << low)
            k += 1
        elif r == 15:
            k += 16
        else:
            return (1 << r) + bits.get(r) - 1
    return 0


def _refine(bits: _Bits, table: dict, block: np.ndarray, first: int, last: int, low: int, run: int) -> int:
    def correct(k: int) -> None:
        if bits.get(1):
            block[k] += (1 if block[k] > 0 else -1) << low

    k = first
    while k <= last and not run:
        r, s = divmod(bits.symbol(table), 16)
        fresh = 0
        if s:
            fresh = (1 if bits.get(1) else -1) << low
        elif r < 15:
            run = (1 << r) + bits.get(r)
            break
        while k <= last:  # past r zeros, correcting what isn't zero
            if block[k]:
                correct(k)
            elif r == 0:
                break
            else:
                r -= 1
            k += 1
        if fresh and k <= last:
            block[k] = fresh
        k += 1
    if not run:
        return 0
    for j in range(k, last + 1):
        if block[j]:
            correct(j)
    return run - 1


@functools.cache
def _inverse() -> np.ndarray:
    """From 64 coefficients in zigzag order to 64 samples."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, math.sqrt(1 / 8), 0.5)
    return np.einsum("yv,xu->vuyx", one, one).reshape(64, 64)[ZIGZAG].astype(np.float32)


def tensor(image: Image) -> np.ndarray:
    """Height x width x 3 RGB samples at full resolution."""
    h, v = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
    planes = []
    for c in image.components.values():
        samples = (c.coef * image.quants[c.quant]) @ _inverse() + np.float32(128)
        np.clip(np.rint(samples, out=samples), 0, 255, out=samples)
        plane = samples.reshape(c.high, c.wide, 8, 8).swapaxes(1, 2).reshape(8 * c.high, 8 * c.wide)
        if (c.h, c.v) != (h, v):
            plane = plane.repeat(v // c.v, axis=0).repeat(h // c.h, axis=1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        planes *= 3
        return np.stack(planes, axis=2).astype(np.uint8)
    y, cb, cr = planes
    cb, cr = cb - np.float32(128), cr - np.float32(128)
    out = np.empty((*y.shape, 3), np.uint8)
    for k, plane in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
        np.clip(np.rint(plane, out=plane), 0, 255, out=plane)
        out[:, :, k] = plane
    return out


def payload_of(image: Image) -> bytes:
    """The payload that encode() put into the coefficients."""
    blocks = np.concatenate([c.coef for c in image.components.values()])
    n = int(image.note.rpartition(b" ")[2])
    return _luts()["byte"][blocks.ravel()[:n] + 130].tobytes()


def feature(rgb: np.ndarray) -> str:
    """Size, checksum and channel means of an RGB tensor."""
    means = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (rgb.shape[0] * rgb.shape[1])
    return f"{rgb.shape[0]}x{rgb.shape[1]};crc={zlib.crc32(rgb):08x};mean={','.join(f'{m:.3f}' for m in means)}"


# ---- columns ----


def _encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for col in batches:
        data = [x.as_py().encode() for x in col]
        yield pa.StructArray.from_arrays([pa.array([len(x) for x in data], pa.int64()), pa.array([encode(pad(x)) for x in data], pa.binary())], ["n_bytes", "media"])


_READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, height int, width int, rgb binary"


def _read_media(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = [x.split()[0] for x in _READ.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
    made = lambda out: pa.StructArray.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)
    for col in batches:
        out, size = [], 0
        for x in col:
            media = x.as_py()
            if out and size + len(media) > READ_BYTES:
                yield made(out)
                out, size = [], 0
            size += len(media)
            image = decode(media)
            payload, rgb = payload_of(image), tensor(image)
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), *rgb.shape[:2], rgb.tobytes()))
        yield made(out)


def _describe(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for high, wide, rgb in batches:
        shapes = zip(high.to_pylist(), wide.to_pylist(), rgb, strict=True)
        yield pa.array([feature(np.frombuffer(x.as_buffer(), np.uint8).reshape(h, w, 3)) for h, w, x in shapes], pa.string())


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: the stored form of every text."""
    bounded_batches(df.sparkSession)
    made = F.arrow_udf(tidy(_encode), "n_bytes long, media binary").asNondeterministic()
    return two_columns(df, id_col, text_col).select("doc_id", made("text").alias("m")).select("doc_id", "m.*")


def tensor_column(media: DataFrame) -> DataFrame:
    """The other columns of media, what its payloads decode to, and height, width and rgb (row-major bytes of every image)."""
    bounded_batches(media.sparkSession)
    read = F.arrow_udf(tidy(_read_media), _READ).asNondeterministic()
    rest = [c for c in media.columns if c != "media"]
    return media.select(*rest, read("media").alias("f")).select(*rest, "f.*")


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media in a table, read it back to tensors, and describe these; the tensors are columns of the result."""
    stored = cut(media_column(df, id_col, text_col), "media")
    tensors = tensor_column(stored)
    return tensors.withColumn("feature", F.arrow_udf(tidy(_describe), "string")("height", "width", "rgb"))
