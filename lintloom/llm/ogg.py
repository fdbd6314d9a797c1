"""Operator 3: Ogg media columns.

A payload is stored as two logical streams in one Ogg file: its bytes are 8-bit samples in blocks of BLOCK bytes, dealt
alternately to the streams. Each stream starts with a header packet on a page of its own; the other packets are blocks,
laced into pages. The granule position of a page is the number of the stream's samples up to the end of the last packet
that ends on it. Reading verifies each page's checksum and sequence number, reassembles packets from lacing values
across pages, separates the streams by serial number and derives timestamps from granule positions.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintloom.llm.common import map_texts, table

#: Payloads are padded with PAD to a positive multiple of UNIT bytes.
UNIT, PAD = 192, b" "
#: Bytes of a packet: not a multiple of 255, so that lacing values vary.
BLOCK = 4800
#: Samples a second.
RATE = 8000
SERIALS = (0x4C4F4F31, 0x4C4F4F32)
MAGIC = b"\x01Lloom8\x00"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = 2**64 - 1
_HEAD = struct.Struct("<4sBBQIIIB")

#: Each byte with its bits in reverse order, for bytes.translate.
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, start and end 0.

    zlib's CRC-32 takes the same polynomial least significant bit first; it gives the same when the bits of each
    byte and of the result are mirrored, and its start and end complements are undone.
    """
    raw = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_MIRROR), "big")


class OggError(ValueError):
    pass


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    whole = head + body
    return whole[:22] + page_checksum(whole).to_bytes(4, "little") + whole[26:]


def _lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


class _StreamWriter:
    def __init__(self, serial: int):
        self.serial, self.number, self.granule = serial, 0, 0
        self.lacing, self.body, self.ended, self.open = b"", b"", False, False

    def page(self, flags: int = 0) -> bytes:
        """The segments gathered so far, 255 at most, as one page."""
        lacing, rest = self.lacing[:255], self.lacing[255:]
        size = sum(lacing)
        out = _page(flags | CONTINUED * self.open, self.granule if self.ended else NO_GRANULE, self.serial, self.number, lacing, self.body[:size])
        self.open = bool(lacing) and lacing[-1] == 255
        self.lacing, self.body, self.ended, self.number = rest, self.body[size:], False, self.number + 1
        return out

    def add(self, packet: bytes, samples: int) -> list[bytes]:
        pages = []
        if len(self.lacing) + len(packet) // 255 + 1 > 255 and self.lacing:
            pages.append(self.page())
        self.lacing += _lacing(len(packet))
        self.body += packet
        while len(self.lacing) > 255:
            pages.append(self.page())
        self.granule += samples
        self.ended = True
        return pages


def mux(payload: bytes, rate: int = RATE, block: int = BLOCK) -> bytes:
    streams = [_StreamWriter(s) for s in SERIALS]
    out = []
    for n, stream in enumerate(streams):
        stream.add(MAGIC + struct.pack("<IIQ", n, rate, len(payload)), 0)
        out.append(stream.page(FIRST))
    for k, at in enumerate(range(0, len(payload), block)):
        packet = payload[at : at + block]
        out += streams[k % 2].add(packet, len(packet))
    return b"".join(out + [s.page(LAST) for s in streams])


@dataclass
class Logical:
    """One logical stream as read: its packets, and (page number, granule, packets ended) of its pages."""

    packets: list[bytes] = field(default_factory=list)
    pages: list[tuple[int, int, int]] = field(default_factory=list)
    part: bytes | None = None
    ended: bool = False


def demux(data: bytes) -> dict[int, Logical]:
    """The logical streams of a file by serial number. OggError where a page is damaged, missing or out of order."""
    streams: dict[int, Logical] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise OggError("cut short")
        magic, version, flags, granule, serial, number, crc, segments = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at {at}")
        lacing = data[at + 27 : at + 27 + segments]
        body = at + 27 + segments
        end = body + sum(lacing)
        if end > len(data) or len(lacing) < segments:
            raise OggError("cut short")
        if page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"checksum of page {number} of stream {serial:x}")
        if bool(flags & FIRST) != (serial not in streams):
            raise OggError(f"start of stream {serial:x}")
        s = streams.setdefault(serial, Logical())
        if number != len(s.pages) or s.ended:
            raise OggError(f"page {number} of stream {serial:x}")
        if bool(flags & CONTINUED) != (s.part is not None):
            raise OggError(f"continuation of page {number} of stream {serial:x}")
        packet, done, run = s.part or b"", 0, body
        size = 0
        for value in lacing:
            size += value
            if value < 255:
                s.packets.append(packet + data[run : run + size])
                packet, run, size, done = b"", run + size, 0, done + 1
        s.part = packet + data[run:end] if lacing and lacing[-1] == 255 else None
        if (granule == NO_GRANULE) != (not done):
            raise OggError(f"granule position of page {number} of stream {serial:x}")
        s.pages.append((number, granule, done))
        s.ended = bool(flags & LAST)
        at = end
    for serial, s in streams.items():
        if s.part is not None or not s.ended:
            raise OggError(f"stream {serial:x} isn't complete")
    return streams


def read(data: bytes) -> tuple[bytes, dict]:
    """The payload, and the features: of each stream packets, pages, seconds and page timestamps' mean step; of all samples mean, deviation and range."""
    streams = demux(data)
    by_number = {}
    for s in streams.values():
        head = s.packets[0]
        if not head.startswith(MAGIC):
            raise OggError("unknown codec")
        number, rate, total = struct.unpack_from("<IIQ", head, len(MAGIC))
        by_number[number] = (s, rate, total)
    bodies = [by_number[n][0].packets[1:] for n in sorted(by_number)]
    payload = b"".join(packets[k] for k in range(max(map(len, bodies))) for packets in bodies if k < len(packets))
    told = []
    for n in sorted(by_number):
        s, rate, total = by_number[n]
        granules = [granule for _, granule, done in s.pages if done]
        if granules != sorted(granules) or total != len(payload) or granules[-1] != sum(map(len, s.packets[1:])):
            raise OggError("granule positions don't match the samples")
        told.append({"packets": len(s.packets) - 1, "pages": len(s.pages), "seconds": round(granules[-1] / rate, 6)})
    return payload, {"streams": told, "seconds": round(len(payload) / RATE, 6)} | signal(payload)


#: Samples that statistics are taken of at a time.
CHUNK = 1 << 20


def signal(payload: bytes) -> dict:
    """Mean, deviation from zero, range and crossings of the mean, from counts of the 256 values, a chunk at a time."""
    x = np.frombuffer(payload, np.uint8)
    counts = sum(np.bincount(x[at : at + CHUNK], minlength=256) for at in range(0, len(x), CHUNK))
    value = np.arange(256)
    mean = int(counts @ value) / len(x)
    # a chunk begins with the last sample of the one before
    crossings = sum(int(np.count_nonzero(np.diff(x[max(0, at - 1) : at + CHUNK] > mean))) for at in range(0, len(x), CHUNK))
    held = np.flatnonzero(counts)
    return {"mean": round(mean, 4), "rms": round(float(np.sqrt(int(counts @ (value * value)) / len(x))), 4), "low": int(held[0]), "high": int(held[-1]), "zero_crossings": crossings}


def media(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Each text as an Ogg file, read back: sizes, digests and features; the file itself as ``media`` if kept.

    A null or empty text is one unit of padding; a null id stays null. Equal texts give equal files. Repeated rows give
    repeated rows, an empty table none; other columns are not read, so their names don't matter.
    """

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                stored = mux(raw + PAD * (UNIT - len(raw) if not raw else -len(raw) % UNIT))
                payload, told = read(stored)
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), json.dumps(told, separators=(",", ":")), stored))
            columns = list(zip(*rows, strict=True))
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))]
            if keep_media:
                arrays.append(pa.array(columns[-1], pa.binary()))
                names.append("media")
            return pa.RecordBatch.from_arrays(arrays, names=[id_col, *names])

        return work

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media
    return map_texts(df.select(id_col, F.col(text_col).alias("text")), schema, make)


def op3_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(table(spark, sf_dir, "documents"), keep_media=False)
