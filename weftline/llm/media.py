"""Media columns: sniff what bytes are, correct declared types, carve embedded media.

Aho-Corasick finds magic bytes anywhere in a value; the validator of the format they announce
checks structure and lengths, and says where the medium ends. A magic that its validator rejects
counts for nothing. The medium at the start gives the value's type, whatever type was declared;
media that start later, inside or after it, are carved with their place and length.

Validators look up what lies ahead (end marks, markers, block ends, checksums) in indexes that are
made once for a value, so a value full of magic bytes costs its length and not its square; chains of
RIFF chunks are followed once, with pointers that jump along them. Compressed data alone are walked
anew for each magic whose header is right.

`store_text` keeps any text losslessly as a WAV file of 8-bit samples.

Cases: null bytes have no type and no media; empty bytes likewise; a null text is stored as an
empty one; texts may hold magic bytes themselves, which are rejected unless they are whole media.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import io
import re
import struct
import wave
import zlib

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.llm.common import map_columns

UNIT = 64  #: payloads are padded to a multiple of this many bytes
RATE = 8000


class Value:
    """Bytes with indexes that are made when first asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self._places: dict[bytes, list[int]] = {}
        self._ends: dict[int, int] = {}
        self._sums: list[int] | None = None
        self._chunks: dict[int, tuple[int, int, int, int]] = {}

    def places(self, pattern: bytes) -> list[int]:
        """Where a regular expression matches, in order."""
        if pattern not in self._places:
            self._places[pattern] = [m.start() for m in re.finditer(pattern, self.raw, re.DOTALL)]
        return self._places[pattern]

    def next(self, pattern: bytes, at: int) -> int:
        """The first match from `at` on, -1 for none."""
        found = self.places(pattern)
        k = bisect.bisect_left(found, at)
        return found[k] if k < len(found) else -1

    def blocks_end(self, at: int) -> int:
        """Where a run of length-prefixed blocks ends, after its empty block; beyond the value if it doesn't."""
        way = []
        while at not in self._ends and at < len(self.raw) and self.raw[at]:
            way.append(at)
            at += 1 + self.raw[at]
        end = self._ends.get(at, at + 1)
        self._ends.update(dict.fromkeys(way, end))
        return end

    def chunk(self, at: int) -> tuple[int, int, int, int]:
        """Of the chain of RIFF chunks from a place on: its length, a place further on to jump to, where fmt and data are next.

        A chain ends where a chunk's header doesn't fit; a jump leads twice as far as the last two, so any
        place of a chain is found in few steps.
        """
        way, none = [], len(self.raw) + 1
        while at not in self._chunks and at + 8 <= len(self.raw):
            way.append(at)
            n = int.from_bytes(self.raw[at + 4 : at + 8], "little")
            at += 8 + n + n % 2
        if at not in self._chunks:
            self._chunks[at] = (0, at, none, none)
        for p in reversed(way):
            depth, jump, fmt, data = self._chunks[at]
            far, further = self._chunks[jump][:2]
            kind = self.raw[p : p + 4]
            onwards = further if depth - far == far - self._chunks[further][0] else at
            self._chunks[p] = (depth + 1, onwards, p if kind == b"fmt " else fmt, p if kind == b"data" else data)
            at = p
        return self._chunks[at]

    def chain_end(self, at: int, end: int) -> int:
        """The first place of the chain of chunks from `at` on where no header fits before `end`."""
        while at + 8 <= end:
            jump = self.chunk(at)[1]
            if jump + 8 <= end:
                at = jump
            else:
                n = int.from_bytes(self.raw[at + 4 : at + 8], "little")
                at += 8 + n + n % 2
        return at

    def crc(self, a: int, b: int) -> int:
        """CRC-32 of the bytes from a to b, from checksums of the value up to places every few kilobytes."""
        if b - a < 2 * STRIDE:
            return zlib.crc32(self.raw[a:b])
        if self._sums is None:
            sums = [0]
            for at in range(0, len(self.raw) - STRIDE + 1, STRIDE):
                sums.append(zlib.crc32(self.raw[at : at + STRIDE], sums[-1]))
            self._sums = sums
        first, last = -(-a // STRIDE), b // STRIDE
        middle = self._sums[last] ^ _shifted(self._sums[first], (last - first) * STRIDE)
        head = zlib.crc32(self.raw[a : first * STRIDE])
        both = _shifted(head, (last - first) * STRIDE) ^ middle
        return zlib.crc32(self.raw[last * STRIDE : b], both)


STRIDE = 4096
_POLYNOMIAL = 0xEDB88320  #: fixed value: CRC-32, bits in reverse


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo the CRC's, bits in reverse."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


@functools.lru_cache(4096)
def _power(n: int) -> int:
    """x to the 8 n."""
    out, square = 1 << 31, 1 << 23
    while n:
        if n & 1:
            out = _times(square, out)
        square, n = _times(square, square), n >> 1
    return out


def _shifted(crc: int, n: int) -> int:
    """What a checksum adds to that of the bytes with n more after them."""
    return _times(_power(n), crc)


def _png(v: Value, at: int) -> int | None:
    """Chunks with right checksums from IHDR to IEND."""
    b, p = v.raw, at + 8
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or (p == at + 8) != (kind == b"IHDR") or not kind.isalpha() or kind == b"IHDR" and n != 13:
            return None
        if v.crc(p + 4, p + 8 + n) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p += 12 + n
        if kind == b"IEND":
            return p
    return None


def _gif(v: Value, at: int) -> int | None:
    """Blocks up to the trailer, with at least one image."""
    b = v.raw
    if len(b) < at + 13:
        return None
    p, images = at + 13, 0
    if b[at + 10] & 0x80:
        p += 3 << ((b[at + 10] & 7) + 1)
    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1 if images else None
        if kind == 0x2C and p + 10 < len(b):
            images += 1
            p += 10 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0) + 1
        elif kind == 0x21:
            p += 2
        else:
            return None
        p = v.blocks_end(p)
    return None


def _jpeg(v: Value, at: int) -> int | None:
    """Marker segments with a frame and a scan, up to the end marker."""
    b, p, frame = v.raw, at + 2, False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return None
        kind = b[p + 1]
        if kind == 0xFF:
            p += 1
            continue
        n = int.from_bytes(b[p + 2 : p + 4], "big")
        if n < 2 or p + 2 + n > len(b):
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if kind == 0xDA:  # coded data: up to a marker that is neither stuffing nor a restart
            p = v.next(b"\xff(?=[^\x00\xd0-\xd7])", p)
            if p < 0:
                return None
            if b[p + 1] == 0xD9:
                return p + 2 if frame else None
    return None


def _riff(v: Value, at: int) -> int | None:
    """Chunks that fill the declared size exactly; a WAVE has fmt before data, a WEBP an image chunk."""
    b = v.raw
    if len(b) < at + 12:
        return None
    end, form = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little"), b[at + 8 : at + 12]
    if end > len(b) or form not in (b"WAVE", b"WEBP"):
        return None
    if v.chain_end(at + 12, end) not in (end, end + 1):
        return None
    if form == b"WAVE":
        _, _, fmt, data = v.chunk(at + 12)
        good = fmt < data <= end - 8
    else:
        good = at + 20 <= end and b[at + 12 : at + 16] in (b"VP8 ", b"VP8L", b"VP8X")
    return end if good else None


def _bmp(v: Value, at: int) -> int | None:
    """Declared size, data offset, header size, planes and depth must agree."""
    b = v.raw
    if len(b) < at + 54:
        return None
    size, _, offset, header, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or header not in (40, 52, 56, 108, 124) or width <= 0 or not height:
        return None
    if offset < 14 + header or at + size > len(b):
        return None
    return at + size if size >= offset + (width * depth + 31) // 32 * 4 * abs(height) else None


def _gzip_data(v: Value, at: int) -> int | None:
    """Where the compressed data of a member starts."""
    b, p = v.raw, at + 10
    flags = b[at + 3] if p <= len(b) else 0xE0
    if flags & 0xE0:
        return None
    if flags & 4:
        p += 2 + int.from_bytes(b[p : p + 2], "little")
    for text in (8, 16):  # a name and a comment, each up to a zero byte
        if flags & text:
            end = v.next(b"\x00", p)
            if end < 0:
                return None
            p = end + 1
    return p + 2 if flags & 2 else p


def _gzip(v: Value, at: int) -> int | None:
    """The member must inflate to its end, where its checksum and length are. A magic inside a confirmed member is its data."""
    b, p = v.raw, _gzip_data(v, at)
    if p is None or p >= len(b):
        return None
    z, crc, size, step = zlib.decompressobj(-15), 0, 0, 256
    try:
        while not z.eof and (p < len(b) or z.unconsumed_tail):
            # little at first, as bytes that only look like a member soon fail
            held = z.unconsumed_tail or b[p : p + step]
            p, step = (p if z.unconsumed_tail else p + len(held)), min(2 * step, 65536)
            out = z.decompress(held, 1 << 20)
            crc, size = zlib.crc32(out, crc), size + len(out)
    except zlib.error:
        return None
    end = p - len(z.unused_data) + 8
    if not z.eof or end > len(b):
        return None
    return end if struct.unpack_from("<II", b, end - 8) == (crc, size & 0xFFFFFFFF) else None


def _pdf(v: Value, at: int) -> int | None:
    """A header with version, a cross-reference pointer and the end mark."""
    end, pointer = v.next(b"%%EOF", at), v.next(b"startxref", at)
    return end + 5 if 0 <= pointer < end and v.raw[at + 5 : at + 6].isdigit() else None


def _zip(v: Value, at: int) -> int | None:
    """An end record must point to a central directory that starts where it says, counted from the first member."""
    for p in _zip_ends(v).get(at, ()):
        size, offset, comment = struct.unpack_from("<IIH", v.raw, p + 12)
        if not size or v.raw[at + offset : at + offset + 4] == b"PK\x01\x02":
            return min(p + 22 + comment, len(v.raw))
    return None


def _zip_ends(v: Value) -> dict[int, list[int]]:
    """End records by the start of the archive that they tell of."""
    if not hasattr(v, "zip_ends"):
        v.zip_ends = {}
        for p in v.places(b"PK\x05\x06"):
            if p + 22 <= len(v.raw):
                size, offset = struct.unpack_from("<II", v.raw, p + 12)
                v.zip_ends.setdefault(p - size - offset, []).append(p)
    return v.zip_ends


def _flac(v: Value, at: int) -> int | None:
    """Metadata blocks, STREAMINFO first, then a frame header with its checksum. A stream has no declared end, so it ends with the value."""
    b, p, first = v.raw, at + 4, True
    while p + 4 <= len(b):
        last, kind, n = b[p] >> 7, b[p] & 127, int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (kind or n != 34) or p + 4 + n > len(b):
            return None
        p, first = p + 4 + n, False
        if last:
            return len(b) if _flac_header(b, p) else None
    return None


def _flac_header(b: bytes, p: int) -> bool:
    """A frame header with its CRC-8."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8 or b[p + 3] & 1:
        return False
    lead = b[p + 4]
    n = 4 + (1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length())
    n += {6: 1, 7: 2}.get(b[p + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(b[p + 2] & 15, 0)
    crc = 0
    for x in b[p : p + n]:
        crc ^= x
        for _ in range(8):
            crc = (crc << 1 ^ (0x07 if crc & 0x80 else 0)) & 0xFF
    return p + n < len(b) and crc == b[p + n]


#: Magic bytes, media types and validators.
FORMATS = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"RIFF", "riff", _riff),
    (b"BM", "image/bmp", _bmp),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"fLaC", "audio/flac", _flac),
)


@functools.cache
def _machine() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for magic, kind, check in FORMATS:
        machine.add_word(magic.decode("latin-1"), (len(magic), kind, check))
    machine.make_automaton()
    return machine


def sniff(b: bytes | None) -> list[tuple[str, int, int]]:
    """All confirmed media as (type, start, length), by start."""
    v, found, packed = Value(b or b""), [], 0
    for last, (n, kind, check) in _machine().iter(v.raw.decode("latin-1")):
        at = last + 1 - n
        if kind == "application/gzip" and at < packed:
            continue
        end = check(v, at)
        if end is not None:
            if kind == "riff":
                kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp"}[v.raw[at + 8 : at + 12]]
            if kind == "application/gzip":
                packed = end
            found.append((kind, at, end - at))
    return sorted(found, key=lambda x: (x[1], -x[2]))


def corrected(media: list[tuple[str, int, int]], declared: str | None) -> tuple[str | None, bool, list[dict]]:
    """The type of what starts a value (null: nothing known), whether that corrects the declared one, and carved media."""
    top = media[0][0] if media and media[0][1] == 0 else None
    carved = [dict(zip(("type", "start", "length"), m, strict=True)) for m in media if m[1]]
    return top, top is not None and top != declared, carved


CARVED = "carved array<struct<type: string, start: long, length: long>>"


def sniff_column(df: DataFrame, content_col: str, declared_col: str, id_col: str) -> DataFrame:
    """id, declared type, found type (null: none at the start), whether it was corrected, media carved."""
    schema = f"id long, declared string, found string, corrected boolean, {CARVED}"

    def run(columns: dict[str, list]) -> dict[str, list]:
        rows = [corrected(sniff(c), d) for c, d in zip(columns["content"], columns["declared"], strict=True)]
        out = {"id": columns["id"], "declared": columns["declared"]}
        return out | {name: [r[k] for r in rows] for k, name in enumerate(("found", "corrected", "carved"))}

    named = df.select(
        F.col(id_col).alias("id"), F.col(declared_col).alias("declared"), F.col(content_col).alias("content")
    )
    return map_columns(named, run, schema, 256)


def store_text(text: str | None) -> bytes:
    """The text as a WAV file: UTF-8 bytes, padded with 0 to a positive multiple of 64, as 8-bit samples."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    raw += bytes(-len(raw) % UNIT if raw else UNIT)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(raw)
    return out.getvalue()


def audio_feature(samples: bytes) -> str:
    """Length, mean, deviation and sign changes of the samples, in integers so that they print alike anywhere."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    mean = int(x.sum() * 1000 // len(x))
    var = int((x * x).sum() * 1000 // len(x) - (int(x.sum()) * int(x.sum()) * 1000) // (len(x) * len(x)))
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"wav;rate={RATE};n={len(x)};mean_milli={mean};var_milli={var};crossings={crossings}"


MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary, declared string"
FEATURE_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    f"media_sha256 string, feature string, declared string, media_type string, corrected boolean, n_carved int, {CARVED}"
)
CLAIMS = ("application/octet-stream", "audio/wav", "text/plain", None)  #: types that a careless source declares in turn


def texts_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A media column: doc_id, n_bytes, media, declared (what a careless source claims, by the text's length)."""

    def run(columns: dict[str, list]) -> dict[str, list]:
        texts = columns["text"]
        return {
            "doc_id": columns["doc_id"],
            "n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in texts],
            "media": [store_text(t) for t in texts],
            "declared": [CLAIMS[len(t or "") % len(CLAIMS)] for t in texts],
        }

    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_columns(named, run, MEDIA_SCHEMA, 256)


def media_features(media: DataFrame) -> DataFrame:
    """Features of a media column, computed from the samples read back, with its types corrected and media carved."""
    names = [f.name for f in StructType.fromDDL(FEATURE_SCHEMA)]

    def run(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name in names}
        for doc_id, n, stored, declared in zip(*(columns[c] for c in ("doc_id", "n_bytes", "media", "declared")), strict=True):
            found = sniff(stored)
            length = found[0][2]
            kind, wrong, carved = corrected(found, declared)
            with wave.open(io.BytesIO(stored[:length])) as w:
                payload = w.readframes(w.getnframes())
            for name, value in (
                ("doc_id", doc_id),
                ("n_bytes", n),
                ("payload_bytes", len(payload)),
                ("payload_sha256", hashlib.sha256(payload).hexdigest()),
                ("tail_crc32", zlib.crc32(payload[-UNIT:])),
                ("media_bytes", len(stored)),
                ("media_sha256", hashlib.sha256(stored).hexdigest()),
                ("feature", audio_feature(payload)),
                ("declared", declared),
                ("media_type", kind),
                ("corrected", wrong),
                ("n_carved", len(carved)),
                ("carved", carved),
            ):
                out[name].append(value)
        return out

    return map_columns(media, run, FEATURE_SCHEMA, 256)
