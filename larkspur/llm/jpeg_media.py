"""Media columns: a Baseline JPEG codec whose DC coefficients hold bytes without loss.

An image stores one byte in each 8 by 8 block. With a DC quantiser of 8, the block's quantised DC coefficient is
``byte - 128``; all AC coefficients are zero. Any Baseline decoder shows the bytes as flat grey squares, and the
DC-only luminance thumbnail *is* the payload. Payloads of more than ``ROWS_MAX`` block rows become several images,
one after the other, as in a motion-JPEG stream.

Reading parses the markers, decodes the entropy-coded scan with the tables that the image itself carries, and
rebuilds the DC-only thumbnail in numpy. Scans in which every block takes the same number of bits are decoded for
all blocks at once, after a check that this holds; all other scans (several components, AC coefficients, restart
intervals) go through the sequential Huffman decoder.

Defined results: null text counts as empty; an empty text becomes 64 zero bytes; equal texts give equal values;
columns other than the identifier and the text are not read. There is no upper limit on a text's length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import in_batches, text_bytes

#: Blocks in a row, and the most rows of blocks that a frame's 16-bit height allows.
ROW_BLOCKS = 64
ROWS_MAX = 8191


class MediaError(ValueError):
    """The bytes are not a Baseline JPEG image that this module reads."""


def pad(payload: bytes) -> bytes:
    """Zero bytes are appended up to a positive multiple of 64."""
    return payload + bytes(-len(payload) % ROW_BLOCKS or (0 if payload else ROW_BLOCKS))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _difference_codes() -> np.ndarray:
    """Ten bits for each DC difference from -255 to 255: prefix code, magnitude bits, end of block.

    Category k (k magnitude bits) has the prefix code of 8 - k ones and a zero, so that code and magnitude are
    nine bits for every category; the end of block is the single bit 0.
    """
    codes = []
    for d in range(-255, 256):
        k = abs(d).bit_length()
        prefix = (1 << (9 - k)) - 2
        codes.append((prefix << k | (d if d >= 0 else d + (1 << k) - 1)) << 1)
    return np.array(codes, dtype=np.uint64)


_CODES = _difference_codes()
_DQT = _segment(0xDB, bytes([0, 8] + [1] * 63))
_DHT = _segment(0xC4, bytes([0x00] + [1] * 9 + [0] * 7 + list(range(8, -1, -1)))) + _segment(
    0xC4, bytes([0x10, 1] + [0] * 15 + [0])
)
_SOS = _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _encode_frame(samples: np.ndarray) -> bytes:
    level = samples.astype(np.int16) - 128
    bits = _CODES[np.diff(level, prepend=np.int16(0)) + 255].reshape(-1, 4)
    word = bits[:, 0] << np.uint64(30) | bits[:, 1] << np.uint64(20) | bits[:, 2] << np.uint64(10) | bits[:, 3]
    scan = np.ascontiguousarray(word.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes()
    height, width = len(samples) // ROW_BLOCKS * 8, ROW_BLOCKS * 8
    frame = _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))
    return b"\xff\xd8" + _DQT + frame + _DHT + _SOS + scan.replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def encode(payload: bytes) -> bytes:
    """The JPEG image (or images) holding ``payload``, whose length is a positive multiple of 64."""
    if not payload or len(payload) % ROW_BLOCKS:
        raise MediaError("the payload's length must be a positive multiple of 64")
    samples, most = np.frombuffer(payload, dtype=np.uint8), ROWS_MAX * ROW_BLOCKS
    return b"".join(_encode_frame(samples[at : at + most]) for at in range(0, len(samples), most))


def _huffman_lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For every 16-bit window: the symbol at its start and the length of its code (0: no such code)."""
    symbol, length = np.zeros(65536, dtype=np.uint8), np.zeros(65536, dtype=np.uint8)
    code, k = 0, 0
    for size in range(1, 17):
        for _ in range(counts[size - 1]):
            low = code << (16 - size)
            symbol[low : low + (1 << (16 - size))] = symbols[k]
            length[low : low + (1 << (16 - size))] = size
            code, k = code + 1, k + 1
        code <<= 1
    return symbol, length


class _Image:
    """One parsed image: frame, tables and the entropy-coded bytes of its scan, and where the next one starts."""

    def __init__(self, data: bytes, at: int, tables: dict):
        if data[at : at + 2] != b"\xff\xd8":
            raise MediaError("no start of image")
        self.quant: dict[int, list[int]] = {}
        self.huffman: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.restart = 0
        at += 2
        while True:
            while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
                at += 1
            if len(data) < at + 4 or data[at] != 0xFF:
                raise MediaError("a marker is missing")
            marker, (size,) = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xC4:
                self._codes(body, tables)
            elif marker in (0xC0, 0xC1):
                self._frame(body)
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
                raise MediaError("only Baseline (sequential, Huffman) frames are read")
            elif marker == 0xDD:
                (self.restart,) = struct.unpack(">H", body)
            elif marker == 0xDA:
                self._scan(body)
                break
        end = at
        while True:
            end = data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(data):
                raise MediaError("the scan has no end")
            if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                end += 2
                continue
            break
        if data[end + 1] != 0xD9:
            raise MediaError("one scan an image is read")
        self.scan, self.end = data[at:end], end + 2

    def _quantisers(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, k = body[at] >> 4, body[at] & 15
            self.quant[k] = list(struct.unpack_from(">64H" if wide else ">64B", body, at + 1))
            at += 129 if wide else 65

    def _codes(self, body: bytes, tables: dict) -> None:
        at = 0
        while at < len(body):
            n = sum(body[at + 1 : at + 17])
            key = body[at + 1 : at + 17 + n]
            if key not in tables:
                tables[key] = _huffman_lookup(key[:16], key[16:])
            self.huffman[body[at]] = tables[key]
            at += 17 + n

    def _frame(self, body: bytes) -> None:
        depth, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if depth != 8 or not self.height or not self.width:
            raise MediaError("8-bit samples and a stated size are expected")
        self.parts = [
            (body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)
        ]

    def _scan(self, body: bytes) -> None:
        chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
        if set(chosen) != {p[0] for p in self.parts}:
            raise MediaError("one interleaved scan is expected")
        self.coders = [(self.huffman[chosen[p[0]] >> 4], self.huffman[0x10 | chosen[p[0]] & 15]) for p in self.parts]

    def _grey(self, dc: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(dc * self.quant[self.parts[0][3]][0] / 8) + 128, 0, 255).astype(np.uint8)

    def thumbnail(self) -> np.ndarray:
        """The luminance plane at an eighth of the size, from DC coefficients alone."""
        if len(self.parts) == 1 and not self.restart:
            rows, columns = -(-self.height // 8), -(-self.width // 8)
            dc = self._even_scan(rows * columns)
            if dc is None:
                dc = np.array(self._any_scan([(1, 1)], rows * columns), dtype=np.int64)
            return self._grey(dc).reshape(rows, columns)
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        across, down = -(-self.width // (8 * h)), -(-self.height // (8 * v))
        shape = [(p[1], p[2]) for p in self.parts] if len(self.parts) > 1 else [(1, 1)]
        if len(self.parts) == 1:
            across, down = -(-self.width // 8), -(-self.height // 8)
        dc = np.array(self._any_scan(shape, across * down), dtype=np.int64)
        h, v = shape[0]
        plane = self._grey(dc).reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        top_h, top_v = (max(s[k] for s in shape) for k in (0, 1))
        return plane[: -(-self.height * v // (8 * top_v)), : -(-self.width * h // (8 * top_h))]

    def _even_scan(self, blocks: int) -> np.ndarray | None:
        """All DC values at once if each block is a DC difference and an end of block in equally many bits."""
        (dc_symbol, dc_length), (ac_symbol, ac_length) = self.coders[0]
        raw = np.frombuffer(self.scan.replace(b"\xff\x00", b"\xff") + bytes(8), dtype=np.uint8)
        first = int(raw[0]) << 8 | int(raw[1])
        head = int(dc_length[first]) + int(dc_symbol[first])
        tail = (int.from_bytes(raw[:6].tobytes(), "big") >> (32 - head)) & 0xFFFF
        step = head + int(ac_length[tail])
        if not dc_length[first] or not ac_length[tail] or head > 16 or step > 24 or blocks * step > 8 * (len(raw) - 8):
            return None
        at = np.arange(blocks, dtype=np.int64) * step
        byte, shift = at >> 3, (at & 7).astype(np.uint64)
        window = raw[byte].astype(np.uint64)
        for k in range(1, 6):
            window = window << np.uint64(8) | raw[byte + k]
        window = (window << shift) & np.uint64((1 << 48) - 1)
        top = (window >> np.uint64(32)).astype(np.int64)
        size, code = dc_symbol[top].astype(np.int64), dc_length[top].astype(np.int64)
        head = (code + size).astype(np.uint64)
        after = ((window >> (np.uint64(32) - head)) & np.uint64(0xFFFF)).astype(np.int64)
        even = (code > 0) & (size <= 11) & (ac_symbol[after] == 0) & (head.astype(np.int64) + ac_length[after] == step)
        if not even.all():
            return None
        value = ((window >> (np.uint64(48) - head)).astype(np.int64)) & ((1 << size) - 1)
        low = (size > 0) & (value < (1 << np.maximum(size - 1, 0)))
        return np.cumsum(np.where(low, value - (1 << size) + 1, value))

    def _any_scan(self, shape: list[tuple[int, int]], units: int) -> list[int]:
        """DC values of the first component, block by block in scan order; AC coefficients are decoded and dropped."""
        found: list[int] = []
        parts: list[bytes] = []
        at = begin = 0
        while (at := self.scan.find(b"\xff", at)) >= 0:
            if 0xD0 <= self.scan[at + 1] <= 0xD7:
                parts.append(self.scan[begin:at])
                begin = at + 2
            at += 2
        parts.append(self.scan[begin:])
        each, done = self.restart or units, 0
        for part in parts:
            data = part.replace(b"\xff\x00", b"\xff") + b"\xff" * 8
            bit, last = 0, [0] * len(shape)

            def look(n: int, bit: int, data: bytes = data) -> int:
                return int.from_bytes(data[bit >> 3 : (bit >> 3) + 5], "big") >> (40 - (bit & 7) - n) & ((1 << n) - 1)

            for _ in range(min(each, units - done)):
                for c, (h, v) in enumerate(shape):
                    (dc_symbol, dc_length), (ac_symbol, ac_length) = self.coders[c]
                    for _ in range(h * v):
                        top = look(16, bit)
                        size = int(dc_symbol[top])
                        bit += int(dc_length[top])
                        if not dc_length[top] or bit > 8 * len(data):
                            raise MediaError("a code is not in the table")
                        value = look(size, bit) if size else 0
                        bit += size
                        last[c] += value if not size or value >> (size - 1) else value - (1 << size) + 1
                        if c == 0:
                            found.append(last[0])
                        k = 1
                        while k < 64:
                            top = look(16, bit)
                            if not ac_length[top]:
                                raise MediaError("a code is not in the table")
                            bit += int(ac_length[top])
                            run, size = int(ac_symbol[top]) >> 4, int(ac_symbol[top]) & 15
                            if not size and run < 15:
                                break
                            k += run + 1
                            bit += size
            done += min(each, units - done)
        return found


def images(media: bytes, tables: dict | None = None) -> list[_Image]:
    at, found, tables = 0, [], {} if tables is None else tables
    while at < len(media):
        found.append(_Image(media, at, tables))
        at = found[-1].end
    return found


def thumbnail_hash(plane: np.ndarray) -> int:
    """64 bits: is each of 8 by 8 cell means of the thumbnail larger than its right neighbour (9 cells a row)?"""
    rows, columns = plane.shape
    sums = np.add.reduceat(plane.astype(np.int64), np.arange(8) * rows // 8, axis=0)
    across = np.arange(9) * columns // 9
    cells = np.add.reduceat(sums, across, axis=1) / np.maximum(np.diff(across, append=columns), 1)
    return int.from_bytes(np.packbits(cells[:, :-1] > cells[:, 1:]).tobytes(), "big")


def decode(media: bytes, tables: dict | None = None) -> tuple[bytes, str]:
    """The payload that the thumbnails hold, and ``widthxheight:hash`` of every image, with plus signs between them and
    their number before them where there are several."""
    found = images(media, tables)
    planes = [x.thumbnail() for x in found]
    feature = "+".join(f"{x.width}x{x.height}:{thumbnail_hash(p):016x}" for x, p in zip(found, planes, strict=True))
    return b"".join(p.tobytes() for p in planes), f"{len(found)}*{feature}" if len(found) > 1 else feature


def media_column(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes`` and ``media``: each text as JPEG bytes."""
    kind = dict(docs.dtypes)[key]

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = text_bytes(batch.column(1))
            media = pa.array([encode(pad(x)) for x in raw], pa.binary())
            return pa.record_batch([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), media], ["key", "n_bytes", "media"])

        return work

    pairs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return pairs.mapInArrow(in_batches(make), f"key {kind}, n_bytes bigint, media binary").withColumnRenamed("key", key)


def media_features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads the ``media`` column back: one row of digests and features for each row of ``media_column``."""
    kind = dict(media.dtypes)[key]
    schema = (
        f"key {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
        "media_bytes bigint, media_sha256 string, feature string"
    )

    def make():
        tables: dict = {}

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for stored in batch.column(2).to_pylist():
                payload, feature = decode(stored, tables)
                rows.append(
                    (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)
                )
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            return pa.record_batch([batch.column(0), batch.column(1), *columns], ["key", "n_bytes", *names])

        return work

    pairs = media.select(F.col(key).alias("key"), "n_bytes", "media")
    return pairs.mapInArrow(in_batches(make), schema).withColumnRenamed("key", key)
