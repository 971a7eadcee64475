"""Media columns: signature sniffing with an Aho-Corasick automaton and format validators.

An automaton of magic bytes finds where a known format may begin, anywhere in a blob; the
format's validator then confirms structure and lengths from the bytes themselves.  What is
confirmed at the start corrects a declared type; what lies deeper is embedded media and can be
carved out.  Four lossless 8-bit containers are read and written: WAV, AU, BMP and PGM; PNG,
GIF, JPEG and ZIP are recognised.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import spread

#: Magic bytes and the media type that each announces.
MAGIC = {
    b"RIFF": "audio/wav",
    b".snd": "audio/basic",
    b"BM": "image/bmp",
    b"P5": "image/x-portable-graymap",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"PK\x03\x04": "application/zip",
}
UNKNOWN = "application/octet-stream"
#: Payloads are whole rows of so many samples.
ROW = 192


@dataclass(frozen=True)
class Found:
    """Confirmed media: bytes [start, end) of a blob, and its samples [data, data_end)."""

    kind: str
    start: int
    end: int
    data: int
    data_end: int


# --- containers -----------------------------------------------------------------------------


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """A RIFF WAVE file of 8-bit mono PCM samples; payloads are of even length."""
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload))
    return b"RIFF" + struct.pack("<I", len(head) + len(payload)) + head + payload


def au(payload: bytes, rate: int = 8000) -> bytes:
    """A Sun audio file of 8-bit linear samples, encoding 2, mono."""
    return b".snd" + struct.pack(">IIIII", 24, len(payload), 2, rate, 1) + payload


def bmp(payload: bytes) -> bytes:
    """A bitmap of 24 bits a pixel and 64 pixels a row, stored top row first."""
    rows = len(payload) // ROW
    info = struct.pack("<IiiHHIIiiII", 40, ROW // 3, -rows, 1, 24, 0, len(payload), 2835, 2835, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(payload), 0, 0, 54) + info + payload


def pgm(payload: bytes) -> bytes:
    """A portable graymap of 192 pixels a row, 8 bits each."""
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


WRITERS = {"audio/wav": wav, "audio/basic": au, "image/bmp": bmp, "image/x-portable-graymap": pgm}


# --- validators: the media that begins at ``at``, or None -------------------------------------


def _riff(b: bytes, at: int) -> Found | None:
    if b[at + 8 : at + 12] != b"WAVE" or len(b) < at + 44:
        return None
    end, pos, bits = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little"), at + 12, 0
    if end > len(b):
        return None
    while pos + 8 <= end:
        size = int.from_bytes(b[pos + 4 : pos + 8], "little")
        if pos + 8 + size > end:
            return None
        if b[pos : pos + 4] == b"fmt " and size >= 16:
            bits = int.from_bytes(b[pos + 22 : pos + 24], "little")
        if b[pos : pos + 4] == b"data":
            return Found("audio/wav", at, end, pos + 8, pos + 8 + size) if bits else None
        pos += 8 + size + size % 2
    return None


def _snd(b: bytes, at: int) -> Found | None:
    if len(b) < at + 24:
        return None
    head, size, encoding, rate, channels = struct.unpack(">IIIII", b[at + 4 : at + 24])
    data = at + head
    if head < 24 or encoding != 2 or not rate or not 0 < channels <= 16 or data + size > len(b):
        return None
    return Found("audio/basic", at, data + size, data, data + size)


def _bm(b: bytes, at: int) -> Found | None:
    if len(b) < at + 54:
        return None
    size, zero, zero2, data = struct.unpack("<IHHI", b[at + 2 : at + 14])
    head, width, height, planes, bits, packed, held = struct.unpack("<IiiHHII", b[at + 14 : at + 38])
    if zero or zero2 or head != 40 or planes != 1 or bits not in (8, 24) or packed or width <= 0:
        return None
    stride = (width * bits + 31) // 32 * 4
    if data < 54 or size != data + stride * abs(height) or at + size > len(b) or held not in (0, stride * abs(height)):
        return None
    return Found("image/bmp", at, at + size, at + data, at + size)


def _p5(b: bytes, at: int) -> Found | None:
    fields, pos = [], at + 2
    while len(fields) < 3:
        first = pos
        while pos < len(b) and b[pos : pos + 1].isspace():
            pos += 1
        if pos == first or pos - first > 64:
            return None
        digits = pos
        while pos < len(b) and 48 <= b[pos] <= 57 and pos - digits < 10:
            pos += 1
        if pos == digits:
            return None
        fields.append(int(b[digits:pos]))
    width, height, top = fields
    data = pos + 1
    if not b[pos : pos + 1].isspace() or not width or not 0 < top < 256 or data + width * height > len(b):
        return None
    return Found("image/x-portable-graymap", at, data + width * height, data, data + width * height)


def _png(b: bytes, at: int) -> Found | None:
    pos = at + 8
    while pos + 12 <= len(b):
        size = int.from_bytes(b[pos : pos + 4], "big")
        end = pos + 12 + size
        if end > len(b) or zlib.crc32(b[pos + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return None
        if (pos == at + 8) != (b[pos + 4 : pos + 8] == b"IHDR"):
            return None
        if b[pos + 4 : pos + 8] == b"IEND":
            return Found("image/png", at, end, at, end)
        pos = end
    return None


def _gif(b: bytes, at: int) -> Found | None:
    if len(b) < at + 14:
        return None
    flags, pos = b[at + 10], at + 13
    pos += 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    while pos < len(b):
        kind = b[pos]
        if kind == 0x3B:
            return Found("image/gif", at, pos + 1, at, pos + 1)
        if kind == 0x2C and pos + 10 <= len(b):
            local = b[pos + 9]
            pos += 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0)
        elif kind == 0x21:
            pos += 2
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        pos += 1
    return None


def _jpeg(b: bytes, at: int) -> Found | None:
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        mark, size = b[pos + 1], int.from_bytes(b[pos + 2 : pos + 4], "big")
        if size < 2:
            return None
        pos += 2 + size
        if mark == 0xDA:
            while (pos := b.find(b"\xff", pos)) >= 0:
                if b[pos + 1 : pos + 2] == b"\xd9":
                    return Found("image/jpeg", at, pos + 2, at, pos + 2)
                if pos + 1 < len(b) and b[pos + 1] not in (0, *range(0xD0, 0xD8)):
                    break
                pos += 2
            if pos < 0:
                return None
    return None


def _zip(b: bytes, at: int) -> Found | None:
    end = b.find(b"PK\x05\x06", at)
    while end >= 0 and end + 22 <= len(b):
        size, first, note = struct.unpack("<IIH", b[end + 12 : end + 22])
        if at + first + size == end and (b[at + first : at + first + 4] == b"PK\x01\x02" or not size) and end + 22 + note <= len(b):
            return Found("application/zip", at, end + 22 + note, at, end + 22 + note)
        end = b.find(b"PK\x05\x06", end + 4)
    return None


_CHECKS = {"audio/wav": _riff, "audio/basic": _snd, "image/bmp": _bm, "image/x-portable-graymap": _p5, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "application/zip": _zip}


@functools.lru_cache(maxsize=1)
def automaton():
    """The Aho-Corasick automaton of all magic bytes, over Latin-1 characters."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def sniff(blob: bytes) -> list[Found]:
    """All confirmed media of a blob by where it begins, media within other media too; what begins
    within another and ends beyond it is none."""
    out: list[Found] = []
    open_ends: list[int] = []
    for last, (size, kind) in automaton().iter(blob.decode("latin-1")):
        at = last - size + 1
        while open_ends and at >= open_ends[-1]:
            open_ends.pop()
        if (found := _CHECKS[kind](blob, at)) and (not open_ends or found.end <= open_ends[-1]):
            out.append(found)
            open_ends.append(found.end)
    return out


# --- Spark operators --------------------------------------------------------------------------


def payload_of(text: bytes) -> bytes:
    """The text's bytes with spaces up to a positive multiple of 192."""
    return text + b" " * (max(1, -(-len(text) // ROW)) * ROW - len(text))


def store(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, declared, media): each whole text as 8-bit samples in a container.

    The container is chosen by the payload's crc32, so equal texts give equal media.  The
    declared type is ``application/octet-stream``, as servers send it; ``inspect`` corrects it.
    A null text counts as empty and is stored as one row of spaces.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("declared", T.StringType()), T.StructField("media", T.BinaryType())])
    kinds = sorted(WRITERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raws = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
                payloads = [payload_of(x) for x in raws]
                media = [WRITERS[kinds[zlib.crc32(p) % len(kinds)]](p) for p in payloads]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in raws], pa.int64()), pa.array([UNKNOWN] * len(raws)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, schema)


INSPECTED = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("corrected", T.BooleanType()),
        T.StructField("embedded", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
    ]
)


def inspect(table: DataFrame, carve: bool = False) -> DataFrame:
    """``table`` without ``media`` but with what its bytes are (columns of ``INSPECTED``).

    ``kind`` is the confirmed type of media that begins at byte 0 and takes up all bytes, else
    ``application/octet-stream``; ``corrected`` says that ``declared`` was another (null is).
    The payload is read back from the stored bytes: the samples of such media, else all bytes;
    tail_crc32 is of its last 16.  ``embedded`` lists confirmed media that lies anywhere else;
    with ``carve`` a column ``carved`` holds their bytes.  Null media counts as no bytes.
    """
    rest = [c for c in table.columns if c not in ("media", "carved", *INSPECTED.names)]
    extra = [T.StructField("carved", T.ArrayType(T.BinaryType()))] if carve else []
    schema = T.StructType([*table.select(*rest).schema.fields, *INSPECTED.fields, *extra])
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    types = [pa.string(), pa.bool_(), spans, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            declared = batch.column("declared").to_pylist()
            for was, blob in zip(declared, batch.column("media").to_pylist(), strict=True):
                blob = blob or b""
                found = sniff(blob)
                own = found[0] if found and found[0].start == 0 and found[0].end == len(blob) else None
                kind = own.kind if own else UNKNOWN
                payload = blob[own.data : own.data_end] if own else blob
                inner = [f for f in found if f is not own]
                rows.append(
                    (kind, was != kind, [{"kind": f.kind, "start": f.start, "end": f.end} for f in inner], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), [blob[f.start : f.end] for f in inner])
                )
            cols = list(zip(*rows, strict=True)) or [()] * 9
            made = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            names = [*rest, *INSPECTED.names, *(["carved"] if carve else [])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made[: len(names) - len(rest)]], names=names)

    return table.select(*rest, "media").mapInArrow(run, schema)
