"""Media columns: signature sniffing of stored bytes.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a blob. Validators of each
format then confirm structure and lengths; what they confirm at the start corrects the declared type, what they
confirm further on is carved as embedded media. Texts are stored losslessly as 8-bit samples of a WAV, PGM or BMP by
their number of 64-byte blocks, read back through the sniffer, and features are computed from the bytes read.

Defined cases: null and empty texts are a payload of 64 zero bytes; null blobs have no type and nothing to carve;
blobs that are cut off or damaged fail validation and have no type; equal texts give equal values; an empty table
gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, staged_small
from .packing import chunks, raw_texts

ROW = 64


class Found(NamedTuple):
    """Media of a type at [offset, offset + length), its samples at [data, data + size)."""

    kind: str
    offset: int
    length: int
    data: int
    size: int


def _wav(b: bytes, at: int) -> Found | None:
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    length = struct.unpack_from("<I", b, at + 4)[0] + 8
    p, end, fmt = at + 12, at + length, False
    if end > len(b):
        return None
    while p + 8 <= end:
        name, n = b[p : p + 4], struct.unpack_from("<I", b, p + 4)[0]
        if p + 8 + n > end:
            return None
        fmt |= name == b"fmt " and n >= 16
        if name == b"data":
            return Found("audio/wav", at, length, p + 8, n) if fmt else None
        p += 8 + n + n % 2
    return None


def _pgm(b: bytes, at: int) -> Found | None:
    head = b[at : at + 64].split(b"\n", 3)
    size = head[1].split(b" ") if len(head) == 4 else []
    if head[0] != b"P5" or len(size) != 2 or head[2] != b"255" or not all(x.isdigit() and len(x) < 10 for x in size):
        return None
    data = at + sum(len(x) + 1 for x in head[:3])
    n = int(size[0]) * int(size[1])
    return Found("image/x-portable-graymap", at, data - at + n, data, n) if n and data + n <= len(b) else None


def _bmp(b: bytes, at: int) -> Found | None:
    if len(b) < at + 54:
        return None
    length, zero, data = struct.unpack_from("<III", b, at + 2)
    head, width, height, planes, bits, packing = struct.unpack_from("<IiiHHI", b, at + 14)
    if zero or planes != 1 or head < 40 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height or packing > 6:
        return None
    n = (width * bits + 31) // 32 * 4 * abs(height)
    if data < 14 + head or length < data + (n if not packing else 0) or at + length > len(b):
        return None
    return Found("image/bmp", at, length, at + data, n if not packing else length - data)


def _png(b: bytes, at: int) -> Found | None:
    p = at + 8
    while p + 12 <= len(b):
        n = struct.unpack_from(">I", b, p)[0]
        if p + 12 + n > len(b) or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0] or (p == at + 8 and b[p + 4 : p + 8] != b"IHDR"):
            return None
        p += 12 + n
        if b[p - 8 - n : p - 4 - n] == b"IEND":
            return Found("image/png", at, p - at, at, p - at)
    return None


def _gif(b: bytes, at: int) -> Found | None:
    if len(b) < at + 14:
        return None
    p = at + 13 + (3 * 2 ** ((b[at + 10] & 7) + 1) if b[at + 10] & 128 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return Found("image/gif", at, p + 1 - at, at, p + 1 - at)
        if b[p] == 0x21:
            p += 2
        elif b[p] == 0x2C and p + 10 < len(b):
            p += 11 + (3 * 2 ** ((b[p + 9] & 7) + 1) if b[p + 9] & 128 else 0)
        else:
            return None
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return None


def _jpeg(b: bytes, at: int) -> Found | None:
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        p += 2 + struct.unpack_from(">H", b, p + 2)[0]
        frame |= kind in (0xC0, 0xC1, 0xC2)
        if kind == 0xDA:  # entropy-coded data up to the next marker that is no restart
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0:
                return None
            if frame and b[p + 1 : p + 2] == b"\xd9":
                return Found("image/jpeg", at, p + 2 - at, at, p + 2 - at)
    return None


def _ogg(b: bytes, at: int) -> Found | None:
    p, pages = at, 0
    while b[p : p + 5] == b"OggS\x00" and p + 27 <= len(b):
        n = b[p + 26]
        size = 27 + n + sum(b[p + 27 : p + 27 + n])
        if p + size > len(b):
            break
        last = b[p + 5] & 4
        p, pages = p + size, pages + 1
        if last:
            break
    return Found("audio/ogg", at, p - at, at, p - at) if pages else None


def _pdf(b: bytes, at: int) -> Found | None:
    """To the last end mark of the file: revisions after the first bring a cross-reference and an end mark each."""
    end = b.find(b"%%EOF", at)
    if end < 0 or b.find(b"startxref", at, end) < 0:
        return None
    while (later := b.find(b"%%EOF", end + 5)) >= 0 and b.find(b"startxref", end, later) >= 0 and b.find(b"%PDF-", end, later) < 0:
        end = later
    return Found("application/pdf", at, end + 5 - at, at, end + 5 - at)


def _zip(b: bytes, at: int) -> Found | None:
    """To the end record whose directory lies where it says; an archive stored inside has end records of its own."""
    end = b.find(b"PK\x05\x06", at)
    while 0 <= end <= len(b) - 22:
        size, offset, note = struct.unpack_from("<IIH", b, end + 12)
        if at + offset + size == end and end + 22 + note <= len(b):
            return Found("application/zip", at, end + 22 + note - at, at, end + 22 + note - at)
        end = b.find(b"PK\x05\x06", end + 1)
    return None


#: Validators that look for an end mark: where a blob has none after a position, its kind isn't tried there.
END_MARKS = {_pdf: b"%%EOF", _zip: b"PK\x05\x06"}
MAGIC = {b"RIFF": _wav, b"P5\n": _pgm, b"BM": _bmp, b"\x89PNG\r\n\x1a\n": _png, b"GIF87a": _gif, b"GIF89a": _gif, b"\xff\xd8\xff": _jpeg, b"OggS": _ogg, b"%PDF-": _pdf, b"PK\x03\x04": _zip}
_AUTOMATON: list = []


def sniff(blob: bytes | None) -> list[Found]:
    """Validated media of a blob by offset; what lies inside other media of the list isn't listed again."""
    if not blob:
        return []
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for m, f in MAGIC.items():
            a.add_word(m.decode("latin-1"), (len(m), f))
        a.make_automaton()
        _AUTOMATON.append(a)
    out, free, ends = [], 0, {}
    for end, (n, check) in _AUTOMATON[0].iter(blob.decode("latin-1")):
        at = end + 1 - n
        if check in END_MARKS and check not in ends:
            ends[check] = blob.rfind(END_MARKS[check])
        if at >= free and at <= ends.get(check, at) and (x := check(blob, at)):
            out.append(x)
            free = at + x.length
    return out


def store(text: bytes) -> tuple[bytes, bytes]:
    """The padded payload of a text, and its stored form."""
    payload = text + bytes(-len(text) % ROW or (ROW if not text else 0))
    n = len(payload)
    rows = n // ROW
    if rows % 3 == 0:
        return payload, b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + payload
    if rows % 3 == 1:
        return payload, b"P5\n%d %d\n255\n" % (ROW, rows) + payload
    gray = b"".join(bytes((i, i, i, 0)) for i in range(256))
    head = 54 + len(gray)
    return payload, b"BM" + struct.pack("<III", head + n, 0, head) + struct.pack("<IiiHHIIiiII", 40, ROW, -rows, 1, 8, 0, n, 2835, 2835, 256, 0) + gray + payload


def _features(kind: str, data: bytes, inside: int) -> str:
    x = np.frombuffer(data, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    return f"{kind};samples={len(x)};mean={float(np.arange(256) @ n) / len(x):.4f};entropy={-float((p * np.log2(p)).sum()):.4f};distinct={len(p)};embedded={inside}"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in chunks(batches):
        rows = []
        for doc_id, text in zip(t["doc_id"].to_pylist(), raw_texts(t)):
            blob = store(text)[1]
            main = next((x for x in sniff(blob) if x.offset == 0 and x.length == len(blob)), None)
            if main is None:
                raise ValueError("stored media could not be read back")
            data = blob[main.data : main.data + main.size]
            rows.append((doc_id, len(text), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-ROW:]), len(blob), hashlib.sha256(blob).hexdigest(), main.kind, _features(main.kind, data, len(sniff(data)))))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "media_type", "feature"])


def text_media(docs: DataFrame) -> DataFrame:
    """Each text as media, stored, read back and described."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, media_type string, feature string"
    return staged_small(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(_describe), schema), "media")


def correct_types(df: DataFrame, blob: str, declared: str) -> DataFrame:
    """df's columns as the struct `row`, with media_type (validated; null if none), type_ok (the declared one agrees)
    and carved: array of embedded media (type, offset, length, bytes)."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(blob).alias("blob"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, media_type string, carved array<struct<type: string, offset: long, length: long, bytes: binary>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("bytes", pa.binary())]))
        for b in (b.slice(i, 32) for b in batches for i in range(0, b.num_rows, 32)):
            kinds, carved = [], []
            for x in b["blob"].to_pylist():
                found = sniff(x)
                main = next((f for f in found if f.offset == 0), None)
                kinds.append(main.kind if main else None)
                # a wrapper's samples may hold media too
                inner = [f._replace(offset=f.offset + main.data) for f in sniff(x[main.data : main.data + main.size])] if main and main.data > main.offset else []
                carved.append([{"type": f.kind, "offset": f.offset, "length": f.length, "bytes": x[f.offset : f.offset + f.length]} for f in sorted([f for f in found if f.offset] + inner, key=lambda f: f.offset)])
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(kinds, pa.string()), pa.array(carved, kind)], names=["row", "media_type", "carved"])

    return rows.mapInArrow(released(run), schema).withColumn("type_ok", F.col("row").getField(declared).eqNullSafe(F.col("media_type")))
