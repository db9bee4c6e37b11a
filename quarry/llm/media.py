"""Media columns: find, confirm and carve media by their bytes.

An Aho-Corasick automaton finds every magic number of a binary value in one
pass; for each hit a validator walks the format's own structure (chunk lengths,
checksums, end markers) and returns the exact length or rejects the hit. The
type found at offset 0 corrects the declared one; the others are carved.

Defined cases: null or empty bytes give no type, `valid` false and no embedded
media; a hit inside a confirmed medium belongs to that medium and is not carved
again; truncated media are not valid and are not carved. An empty table gives an
empty one. Values are what a binary column holds, so under 2 GB, each whole in its
task; time grows in proportion to them.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Magic numbers of the public formats, and the media type each starts.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"\xff\xd8\xff": "image/jpeg",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"BM": "image/bmp",
    b"RIFF": "riff",
    b"OggS": "audio/ogg",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
    b"\x1f\x8b\x08": "application/gzip",
}
#: Form type of a RIFF file to media type.
RIFF_FORMS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
BLOCK = 1 << 20
SPAN = "array<struct<start:long,length:long,type:string>>"
SNIFF_TYPE = f"struct<type:string,valid:boolean,length:long,data_start:long,data_length:long,embedded:{SPAN}>"


def _png(b: bytes, at: int) -> int:
    p = at + 8
    while p + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        end = p + 12 + size
        if end > len(b) or zlib.crc32(b[p + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return 0
        if kind == b"IEND":
            return end - at
        p = end
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        marker = b[p + 1]
        if marker == 0xFF:
            p += 1
            continue
        if 0xD0 <= marker <= 0xD7 or marker == 0x01:
            p += 2
            continue
        size = struct.unpack_from(">H", b, p + 2)[0]
        if size < 2:
            return 0
        p += 2 + size
        while marker == 0xDA:  # entropy-coded data run to the next real marker
            p = b.find(b"\xff", p)
            if p < 0 or p + 1 >= len(b):
                return 0
            if b[p + 1] == 0xD9:
                return p + 2 - at
            if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                p += 2
            else:
                break
    return 0


def _gif_blocks(b: bytes, p: int) -> int:
    while p < len(b) and b[p]:
        p += 1 + b[p]
    return p + 1


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = _gif_blocks(b, p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            flags = b[p + 9]
            p = _gif_blocks(b, p + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
        else:
            return 0
    return 0


def _bmp(b: bytes, at: int) -> int:
    if at + 26 > len(b):
        return 0
    size, reserved, pixels, header = struct.unpack_from("<IIII", b, at + 2)
    fits = reserved == 0 and header in (12, 40, 52, 56, 108, 124) and 14 + header <= pixels <= size
    return size if fits and at + size <= len(b) else 0


def riff_chunks(b: bytes, at: int, end: int):
    """(id, start, length) of each chunk; stops at the first that does not fit."""
    p = at + 12
    while p + 8 <= end:
        kind, size = struct.unpack_from("<4sI", b, p)
        if p + 8 + size > end:
            return
        yield kind, p + 8, size
        p += 8 + size + (size & 1)


def _riff(b: bytes, at: int) -> int:
    if at + 12 > len(b) or b[at + 8 : at + 12] not in RIFF_FORMS:
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    chunks = list(riff_chunks(b, at, end))
    whole = chunks and chunks[-1][1] + chunks[-1][2] + (chunks[-1][2] & 1) >= end
    if b[at + 8 : at + 12] == b"WAVE":
        kinds = {c[0] for c in chunks}
        whole = whole and b"fmt " in kinds and b"data" in kinds
    return end - at if whole else 0


def _ogg(b: bytes, at: int) -> int:
    p = at
    while p + 27 <= len(b) and b[p : p + 4] == b"OggS":
        end = p + 27 + b[p + 26]
        if end > len(b):
            return 0
        end += sum(b[p + 27 : end])
        if end > len(b):
            return 0
        if b[p + 5] & 4:
            return end - at
        p = end
    return 0


PDF_END = re.compile(rb"startxref\s+(\d{1,12})\s*%%EOF")
PDF_XREF = re.compile(rb"\s*(?:xref|\d+\s+\d+\s+obj)")


#: How many headers back from an end mark its file's is looked for, so deep may files without end marks of their own be nested.
PDF_DEPTH = 16


@lru_cache(1)
def _pdf_ends(b: bytes) -> dict[int, int]:
    """Header to the end of its last revision, for all of a value at once: an end mark is that of the nearest header from which its offset leads to a cross-reference. A header that none leads to is no file."""
    headers, ends = [m.start() for m in re.finditer(rb"%PDF-\d\.\d", b)], {}
    for mark in PDF_END.finditer(b) if headers else ():
        near = bisect_left(headers, mark.start())
        for header in reversed(headers[max(0, near - PDF_DEPTH) : near]):
            if PDF_XREF.match(b, header + int(mark[1]), mark.start()):
                ends[header] = mark.end()
                break
    return ends


def _pdf(b: bytes, at: int) -> int:
    return _pdf_ends(b).get(at, at) - at


@lru_cache(1)
def _zip_ends(b: bytes) -> dict[int, int]:
    """Start of an archive to its end, by the first end record whose directory lies where that start says; those of stored archives inside say their own."""
    out: dict[int, int] = {}
    for mark in re.finditer(rb"PK\x05\x06", b):
        end = mark.start()
        if end > len(b) - 22:
            break
        size, start, note = struct.unpack_from("<IIH", b, end + 12)
        at = end - size - start
        if at >= 0 and b[at + start : at + start + 4] in (b"PK\x01\x02", b"PK\x05\x06") and end + 22 + note <= len(b):
            out.setdefault(at, end + 22 + note)
    return out


def _zip(b: bytes, at: int) -> int:
    return max(0, _zip_ends(b).get(at, 0) - at)


def _gzip(b: bytes, at: int) -> int:
    inflate, p = zlib.decompressobj(31), at
    try:
        while p < len(b) and not inflate.eof:
            inflate.decompress(b[p : p + BLOCK])
            p += BLOCK
    except zlib.error:
        return 0
    return min(p, len(b)) - len(inflate.unused_data) - at if inflate.eof else 0


VALIDATE = {
    "image/png": _png,
    "image/jpeg": _jpeg,
    "image/gif": _gif,
    "image/bmp": _bmp,
    "riff": _riff,
    "audio/ogg": _ogg,
    "application/pdf": _pdf,
    "application/zip": _zip,
    "application/gzip": _gzip,
}


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def hits(data: bytes):
    """(start, kind) of every magic number, in order of start; looked at in blocks that overlap by the longest magic."""
    lap = max(map(len, MAGIC)) - 1
    for base in range(0, len(data), BLOCK):
        part = data[base : base + BLOCK + lap].decode("latin-1")
        found = sorted((end + 1 - size, kind) for end, (size, kind) in automaton().iter(part))
        for start, kind in found:
            if start < BLOCK:
                yield base + start, kind


def sniff_bytes(data: bytes | None) -> dict:
    """Type, validity and length of the medium at offset 0, its sample data if it is WAVE, and the spans of all media further in."""
    out = {"type": None, "valid": False, "length": 0, "data_start": 0, "data_length": 0, "embedded": []}
    past = 0
    for start, kind in hits(data or b""):
        if start < past:
            continue
        length = VALIDATE[kind](data, start)
        if not length:
            if start == 0 and out["type"] is None:
                out["type"] = RIFF_FORMS.get(data[8:12]) if kind == "riff" else kind
            continue
        past = start + length
        kind = RIFF_FORMS[data[start + 8 : start + 12]] if kind == "riff" else kind
        if start:
            out["embedded"].append({"start": start, "length": length, "type": kind})
            continue
        out |= {"type": kind, "valid": True, "length": length}
        if kind == "audio/wav":
            # samples may hold media of their own: these are looked for as well
            out["data_start"], out["data_length"] = next((s, n) for k, s, n in riff_chunks(data, 0, length) if k == b"data")
            past = out["data_start"]
    return out


def _sniff(data: pa.Array) -> pa.Array:
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string())])
    kind = pa.struct([("type", pa.string()), ("valid", pa.bool_()), ("length", pa.int64()), ("data_start", pa.int64()), ("data_length", pa.int64()), ("embedded", pa.list_(span))])
    return pa.array([sniff_bytes(x.as_py()) for x in data], kind)


def sniff(df: DataFrame, media: str, declared: str, into: str = "sniffed") -> DataFrame:
    """Adds struct `into` (see SNIFF_TYPE) and `corrected_type`: what the bytes prove, else what was declared. Columns of these names give way."""
    found = F.arrow_udf(_sniff, SNIFF_TYPE)
    return df.withColumn(into, found(F.col(media))).withColumn(
        "corrected_type", F.when(F.col(f"{into}.valid"), F.col(f"{into}.type")).otherwise(F.col(declared))
    )


def carve(df: DataFrame, media: str, into: str = "sniffed") -> DataFrame:
    """One row for each embedded medium of each row: `carved_start`, `carved_type`, `carved` (its bytes); sliced in the JVM. Columns of these names give way; _quarry_span is the operator's own."""
    span = F.col("_quarry_span")
    spread = df.select("*", F.explode(f"{into}.embedded").alias("_quarry_span"))
    cut = F.substring(F.col(media), (span["start"] + 1).cast("int"), span["length"].cast("int"))
    return spread.withColumns({"carved_start": span["start"], "carved_type": span["type"], "carved": cut}).drop("_quarry_span")


def _sample_features(samples: pa.Array) -> pa.Array:
    """Of 8-bit samples: the mean, rounded down, how often they cross the middle (128), and how many lie in each of eight bands."""
    out = []
    for x in samples:
        v = np.frombuffer(x.as_buffer() or b"", np.uint8) if x.is_valid else np.zeros(0, np.uint8)
        above = v >= 128
        bands = np.bincount(v >> 5, minlength=8)
        out.append(f"level={int(v.sum(dtype=np.int64)) // max(1, len(v))};crossings={int(np.count_nonzero(above[1:] != above[:-1]))};bands={','.join(map(str, bands.tolist()))}")
    return pa.array(out, pa.string())


def sample_features(samples: Column) -> Column:
    return F.arrow_udf(_sample_features, "string")(samples)


def padded(data: Column, to: int = 64) -> Column:
    """`data` with bytes 0 appended up to a positive multiple of `to`."""
    size = F.octet_length(data)
    lack = F.when(size == 0, F.lit(to)).otherwise(F.pmod(-size, F.lit(to)))
    return F.concat(data, F.substring(F.lit(b"\0" * to), F.lit(1), lack))


def _little(value: Column, width: int) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(value, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(width)]))


def as_wave(samples: Column, rate: int = 8000) -> Column:
    """A canonical mono WAVE file with `samples` as unsigned 8-bit PCM; a pad byte follows an odd length, as RIFF wants."""
    size = F.octet_length(samples).cast("long")
    odd = size % 2
    number = lambda v, w: _little(F.lit(v).cast("long"), w)
    return F.concat(
        F.lit(b"RIFF"), _little(size + odd + 36, 4), F.lit(b"WAVEfmt "), number(16, 4), number(1, 2), number(1, 2),
        number(rate, 4), number(rate, 4), number(1, 2), number(8, 2), F.lit(b"data"), _little(size, 4), samples,
        F.substring(F.lit(b"\0"), F.lit(1), odd.cast("int")),
    )
