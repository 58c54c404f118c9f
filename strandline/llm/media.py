"""Signature sniffing of media columns.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over
a value.  Each hit is only a candidate: a validator walks the format's
structure (chunk lengths, checksums, header fields) and says where the media
ends, or that it is none.  What stands at offset 0 corrects the declared type;
what is found further in is embedded media, which is carved out.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandline.llm.common import bounded_batches, durable

# The magic bytes of each format and how far before them the file begins.
MAGIC = {
    b"RIFF": ("wav", 0),
    b".snd": ("au", 0),
    b"BM": ("bmp", 0),
    b"P5": ("pgm", 0),
    b"\x89PNG\r\n\x1a\n": ("png", 0),
    b"GIF87a": ("gif", 0),
    b"GIF89a": ("gif", 0),
    b"\xff\xd8\xff": ("jpeg", 0),
    b"\x1f\x8b\x08": ("gzip", 0),
    b"%PDF-": ("pdf", 0),
    b"PK\x03\x04": ("zip", 0),
}
#: Bytes of a row of stored samples.
WIDTH = 64
RATE = 8000


class Value:
    """The bytes of one value with what its validators share.

    Many hits may lead to the same end marks and the same chains of blocks;
    each mark is searched and each block walked once, so a value takes steps in
    proportion to its length however many false hits it holds.
    """

    def __init__(self, raw: bytes):
        self.raw = raw
        self._marks: dict[bytes, list[int]] = {}
        self._chains: dict[str, dict[int, int]] = {}

    def mark(self, mark: bytes, past: int) -> int:
        """The first place of ``mark`` at ``past`` or later, or -1."""
        if mark not in self._marks:
            found, at = [], self.raw.find(mark)
            while at >= 0:
                found.append(at)
                at = self.raw.find(mark, at + 1)
            self._marks[mark] = found
        own = self._marks[mark]
        i = bisect.bisect_left(own, past)
        return own[i] if i < len(own) else -1

    def chain(self, name: str, at: int, step: Callable[[int], tuple[int, bool]]) -> int:
        """Where the chain of blocks from ``at`` ends; ``step`` gives the next place and whether the chain ends there (-1: broken)."""
        known, path = self._chains.setdefault(name, {}), []
        end = known.get(at)
        while end is None:
            path.append(at)
            at, last = step(at)
            end = at if last or at < 0 else known.get(at)
        known.update(dict.fromkeys(path, end))
        return end


# Validators: the length of the media that begins at ``at``, or 0.


def _wav(b: bytes, at: int, value: Value) -> int:
    if b[at + 8 : at + 12] != b"WAVE" or len(b) < at + 12:
        return 0
    end, p = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little"), at + 12
    seen = set()
    while p + 8 <= min(end, len(b)):
        seen.add(b[p : p + 4])
        size = int.from_bytes(b[p + 4 : p + 8], "little")
        p += 8 + size + size % 2
    return end - at if p == end <= len(b) and {b"fmt ", b"data"} <= seen else 0


def _au(b: bytes, at: int, value: Value) -> int:
    if len(b) < at + 24:
        return 0
    head, size, kind, rate, channels = struct.unpack_from(">5I", b, at + 4)
    ok = 24 <= head <= 4096 and 1 <= kind <= 27 and 1 <= channels <= 64 and 0 < rate < 1_000_000
    return head + size if ok and at + head + size <= len(b) else 0


def _bmp(b: bytes, at: int, value: Value) -> int:
    if len(b) < at + 54:
        return 0
    size, spare, start, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    row = (width * bits + 31) // 32 * 4
    ok = spare == 0 and head in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0
    return size if ok and start >= 14 + head and size == start + row * abs(height) and at + size <= len(b) else 0


def _pgm(b: bytes, at: int, value: Value) -> int:
    fields = b[at : at + 40].split(maxsplit=4)
    if len(fields) < 4 or fields[0] != b"P5" or not all(f.isdigit() for f in fields[1:4]) or fields[3] != b"255":
        return 0
    head = len(b"P5\n%s %s\n255\n" % (fields[1], fields[2]))
    size = head + int(fields[1]) * int(fields[2])
    return size if b[at + head - 5 : at + head] == b"\n255\n" and at + size <= len(b) else 0


def _png(b: bytes, at: int, value: Value) -> int:
    def chunk(p: int) -> tuple[int, bool]:
        end = p + 12 + int.from_bytes(b[p : p + 4])
        if p + 12 > len(b) or end > len(b) or zlib.crc32(memoryview(b)[p + 4 : end - 4]) != int.from_bytes(b[end - 4 : end]):
            return -1, True
        return end, b[p + 4 : p + 8] == b"IEND"

    def later(p: int) -> tuple[int, bool]:
        return (-1, True) if b[p + 4 : p + 8] == b"IHDR" else chunk(p)

    if b[at + 12 : at + 16] != b"IHDR":
        return 0
    first, _ = chunk(at + 8)
    end = value.chain("png", first, later) if first > 0 else -1
    return end - at if end > 0 else 0


def _gif(b: bytes, at: int, value: Value) -> int:
    def blocks(p: int) -> tuple[int, bool]:
        return (p + 1, True) if p >= len(b) or b[p] == 0 else (p + 1 + b[p], False)

    def part(p: int) -> tuple[int, bool]:
        if p >= len(b):
            return -1, True
        if b[p] == 0x3B:
            return p + 1, True
        if b[p] == 0x21:
            return value.chain("gif blocks", p + 2, blocks), False
        if b[p] == 0x2C and p + 10 <= len(b):
            return value.chain("gif blocks", p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 128 else 0), blocks), False
        return -1, True

    if len(b) < at + 14:
        return 0
    end = value.chain("gif", at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0), part)
    return end - at if end > 0 else 0


def _jpeg(b: bytes, at: int, value: Value) -> int:
    def segment(p: int) -> tuple[int, bool]:
        size = int.from_bytes(b[p + 2 : p + 4])
        if p + 4 > len(b) or b[p] != 0xFF or size < 2:
            return -1, True
        if b[p + 1] == 0xDA:
            end = value.mark(b"\xff\xd9", p + 2 + size)
            return (end + 2, True) if end >= 0 else (-1, True)
        return p + 2 + size, False

    end = value.chain("jpeg", at + 2, segment)
    return end - at if end > 0 else 0


def _gzip(b: bytes, at: int, value: Value) -> int:
    inflate, rest, p = zlib.decompressobj(31), memoryview(b), at
    try:
        while p < len(b) and not inflate.eof:
            inflate.decompress(rest[p : p + (1 << 14)])
            p += 1 << 14
    except zlib.error:
        return 0
    return min(p, len(b)) - at - len(inflate.unused_data) if inflate.eof else 0


def _pdf(b: bytes, at: int, value: Value) -> int:
    end = value.mark(b"%%EOF", at) if b[at + 5 : at + 6].isdigit() else -1
    return end + 5 - at if end >= 0 else 0


def _zip(b: bytes, at: int, value: Value) -> int:
    end = value.mark(b"PK\x05\x06", at)
    if end < 0 or len(b) < end + 22:
        return 0
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + note - at if start + size == end - at and end + 22 + note <= len(b) else 0


VALIDATORS = {"wav": _wav, "au": _au, "bmp": _bmp, "pgm": _pgm, "png": _png, "gif": _gif, "jpeg": _jpeg, "gzip": _gzip, "pdf": _pdf, "zip": _zip}


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, (kind, before) in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic) + before))
    found.make_automaton()
    return found


def sniff(value: bytes) -> list[tuple[str, int, int]]:
    """(type, start, length) of all media in ``value`` that aren't inside others of the list."""
    found: list[tuple[str, int, int]] = []
    past, whole = 0, Value(value)
    for last, (kind, back) in _automaton().iter(value.decode("latin-1")):
        at = last + 1 - back
        if at >= past and (size := VALIDATORS[kind](value, at, whole)):
            found.append((kind, at, size))
            past = at + size
    return found


SNIFFED = "type string, valid boolean, corrected boolean, length long, embedded array<struct<type: string, start: long, length: long, media: binary>>"


def sniff_media(table: DataFrame, *, key: str, media: str, declared: str) -> DataFrame:
    """Type, length and embedded media of the binary column ``media``.

    Returns ``key`` with ``type`` (what stands at offset 0, else ``unknown``),
    ``valid``, ``corrected`` (the declared type was another), ``length`` of
    that media, and the embedded media found after it, with their bytes.  Null
    and empty values are ``unknown``; a null declared type counts as wrong.
    """
    bounded_batches(table.sparkSession)
    rows = table.select(table[key].alias("k"), table[media].alias("m"), table[declared].alias("d"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for value, said in zip(batch.column("m"), batch.column("d"), strict=True):
                value = value.as_py() or b""
                found = sniff(value)
                own = found.pop(0) if found and found[0][1] == 0 else ("unknown", 0, 0)
                for column, x in zip(out, (own[0], own[2] > 0, own[0] != said.as_py(), own[2], [{"type": t, "start": s, "length": n, "media": value[s : s + n]} for t, s, n in found]), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("k"), *(pa.array(c, t) for c, t in zip(out, (pa.string(), pa.bool_(), pa.bool_(), pa.int64(), _EMBEDDED), strict=True))], names=["k", "type", "valid", "corrected", "length", "embedded"])

    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), *T._parse_datatype_string(SNIFFED).fields])
    return rows.mapInArrow(scan, schema).withColumnRenamed("k", key)


_EMBEDDED = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("media", pa.binary())]))


# Lossless carriers of 8-bit samples: payload to stored bytes and back.


def _to_wav(p: bytes) -> bytes:
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(p))
    return b"RIFF" + struct.pack("<I", len(head) + len(p)) + head + p


def _to_au(p: bytes) -> bytes:
    return b".snd" + struct.pack(">5I", 24, len(p), 2, RATE, 1) + p


def _to_bmp(p: bytes) -> bytes:
    start = 54 + 1024
    head = struct.pack("<IIIIiiHHIIiiII", start + len(p), 0, start, 40, WIDTH, -(len(p) // WIDTH), 1, 8, 0, len(p), 2835, 2835, 256, 256)
    return b"BM" + head + b"".join(bytes((i, i, i, 0)) for i in range(256)) + p


def _to_pgm(p: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(p) // WIDTH) + p


def _to_png(p: bytes) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + p[i : i + WIDTH] for i in range(0, len(p), WIDTH))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(p) // WIDTH, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")


def _from_wav(b: bytes) -> bytes:
    p = 12
    while b[p : p + 4] != b"data":
        size = int.from_bytes(b[p + 4 : p + 8], "little")
        p += 8 + size + size % 2
    return b[p + 8 : p + 8 + int.from_bytes(b[p + 4 : p + 8], "little")]


def _from_png(b: bytes) -> bytes:
    p, packed = 8, []
    while p < len(b):
        size = int.from_bytes(b[p : p + 4])
        if b[p + 4 : p + 8] == b"IDAT":
            packed.append(b[p + 8 : p + 8 + size])
        p += 12 + size
    rows = zlib.decompress(b"".join(packed))
    return b"".join(rows[i + 1 : i + 1 + WIDTH] for i in range(0, len(rows), WIDTH + 1))


ENCODE = {"wav": _to_wav, "au": _to_au, "bmp": _to_bmp, "pgm": _to_pgm, "png": _to_png}
DECODE = {
    "wav": _from_wav,
    "au": lambda b: b[int.from_bytes(b[4:8]) :][: int.from_bytes(b[8:12])],
    "bmp": lambda b: b[int.from_bytes(b[10:14], "little") :],
    "pgm": lambda b: b[b.index(b"\n255\n") + 5 :],
    "png": _from_png,
}
KINDS = sorted(ENCODE)


def payload(text: bytes) -> bytes:
    """``text`` with zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 if text else 64)


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, declared, media): each text stored as samples of a media format.

    Format and declared type depend on the text alone; the declared type is
    wrong for a fifth of the texts.  A null text is empty.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, said, media = [], [], []
            for text in batch.column("text"):
                raw = (text.as_py() or "").encode()
                code = zlib.crc32(raw)
                sizes.append(len(raw))
                said.append(KINDS[code // 5 % 5] if code % 5 == 0 else KINDS[code % 5])
                media.append(ENCODE[KINDS[code % 5]](payload(raw)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(said, pa.string()), pa.array(media, pa.large_binary()).cast(pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(store, f"doc_id {kind}, n_bytes long, declared string, media binary")


def media_digest(docs: DataFrame) -> DataFrame:
    """The registered query: store every text in a table, sniff the bytes read from it, decode the samples.

    The carrier is chosen by the type that sniffing finds, never by the
    declared one.  ``feature`` says type, declared type, samples, mean sample
    and the embedded media (type and start) that were carved.
    """
    stored = durable(store_texts(docs), "media-stored")
    kind = stored.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for value, said in zip(batch.column("media"), batch.column("declared"), strict=True):
                media = value.as_py()
                found = sniff(media)
                name, _, length = found[0]
                samples = DECODE[name](media[:length])
                inner = sniff(samples)
                out["payload_bytes"].append(len(samples))
                out["payload_sha256"].append(hashlib.sha256(samples).hexdigest())
                out["tail_crc32"].append(zlib.crc32(samples[-64:]))
                out["media_bytes"].append(length)
                out["media_sha256"].append(hashlib.sha256(media[:length]).hexdigest())
                carved = ",".join(f"{t}@{s}+{n}" for t, s, n in inner)
                out["feature"].append(f"type={name};declared={said.as_py()};samples={len(samples)};mean={sum(samples) / len(samples):.3f};embedded={carved}")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(v, pa.int64() if c.endswith(("bytes", "crc32")) else pa.string()) for c, v in out.items())], names=["doc_id", "n_bytes", *out])

    return stored.mapInArrow(digest, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
