"""Operator 8: secrets in texts, and in what the texts encode.

A document is the first layer of a worklist. Each layer is searched, and what it encodes becomes new
layers: lines with percent escapes, lines with Unicode escapes, and runs of base64, whose bytes may be
compressed. A text that was seen before is not searched again, so the list ends even where decoding
goes in a circle. Every character of a layer knows the code points of the text around it that it comes
from, and the secrets of a text are carried to every place that it was found at, up to the document.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitlekit.llm.common import slices, text_buffer

# The kinds of secrets, in order, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE = 8
MASK = "[SECRET]"

PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{16,})*(?:\r?\n[A-Za-z0-9+/_-]+(?==))?={0,2}")
LEAST_RUN = 16
CHUNK = 4 << 20  # bytes that are inflated at once
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda\x20\x3f\x7d\xbb\xf9]", re.S)
#: Bytes without any of these hold no secret, nothing encoded and no text of two-byte characters.
PROMISING = re.compile(rb"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{32}|%[0-9A-Fa-f]{2}|\\[uUx]|&#|[A-Za-z0-9+/_-]{16}|(?:[\x01-\x7f]\x00){8}")
WIDE = re.compile(rb"\x00?(?:[\x01-\x7f]\x00){7,}[\x01-\x7f]?")  # ASCII in UTF-16 of either order
#: Places that no pattern reaches across, in bytes or in two-byte characters.
GAP = re.compile(rb"[^A-Za-z0-9+/_=\r\n\x00-](?:\r?\n)(?!\x00)|\n(?=[^A-Za-z0-9+/_\r\n\x00-])|\x00\x00(?=\x00)|[\x80-\xff](?=[\x80-\xff])")
PLAIN = str.maketrans("-_", "+/", "\r\n=")
KEYWORDS = (b"passw", b"secret", b"token", b"key")

SPANS = "array<struct<kind: string, start: int, end: int>>"
SCHEMA = f"doc_id long, text string, base {SPANS}, spans {SPANS}"


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets written in ``text``, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@dataclass(frozen=True)
class Layer:
    """A text, and where in the text around it each of its characters comes from."""

    text: str
    starts: np.ndarray
    ends: np.ndarray


def _lines(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """The lines in which the pattern occurs, each once."""
    done = 0
    for m in pattern.finditer(text):
        if m.start() >= done:
            lo, hi = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
            done = hi if hi >= 0 else len(text)
            yield lo, done


def _characters(data: bytes, lo: np.ndarray, hi: np.ndarray):
    """(text, lo, hi) of UTF-8 bytes whose sources are [lo, hi); bytes that aren't UTF-8 are replaced."""
    text = data.decode("utf-8", "replace")
    sizes = np.array([len(c.encode()) for c in text], np.int64)
    if sizes.sum() != len(data):  # replaced bytes: each stands for one
        text = data.decode("latin-1")
        sizes = np.ones(len(data), np.int64)
    ends = np.cumsum(sizes)
    return text, lo[ends - sizes], hi[ends - 1]


def _decoder(head: bytes):
    """A decompressor for what begins with ``head``, if that is a compressed form."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _feed(decoder, data: bytes) -> Iterator[bytes]:
    while not decoder.eof:
        out = decoder.decompress(data, CHUNK)
        data = getattr(decoder, "unconsumed_tail", b"")
        if out:
            yield out
        elif not data:
            return


def _inflate(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of all members of a compressed stream; what follows them comes as it is."""
    decoder, data, some, plain = None, b"", False, False
    for part in parts:
        data += part
        while data:
            if plain:
                yield data
                data = b""
                break
            if decoder is None:
                if len(data) < 6:
                    break
                decoder = _decoder(data)
                if decoder is None:
                    plain = True
                    continue
            try:
                for out in _feed(decoder, data):
                    some = True
                    yield out
            except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
                if not some:
                    return
                plain = True  # damaged
                continue
            data = b""
            if decoder.eof:
                data, decoder = decoder.unused_data, None
    if data:
        yield data


def _unpacked(data: bytes):
    """A reader of what ``data`` is when decompressed, as often as it is compressed; None if it isn't."""
    read, seen = (lambda: iter((data,))), set()
    packed = False
    while True:
        head = b""
        for part in read():
            head += part
            if len(head) >= 6:
                break
        if _decoder(head) is None or next(_inflate(read()), None) is None:
            break
        inner, digest = partial(lambda outer: _inflate(outer()), read), hashlib.blake2b(digest_size=16)
        for part in inner():
            digest.update(part)
        if digest.digest() in seen:  # it inflates to itself
            break
        seen.add(digest.digest())
        read, packed = inner, True
    return read if packed else None


def _pieces(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The stream cut at places that no pattern reaches across; a piece grows until there is one."""
    data, known = b"", 0
    for part in parts:
        data += part
        cut, least = 0, max(0, known - 3)
        for begin in (max(least, len(data) - 4096), least):  # the last one is mostly near the end
            for m in GAP.finditer(data, begin):
                cut = m.end()
            if cut:
                break
        if cut and cut < len(data):
            yield data[:cut]
            data = data[cut:]
        known = len(data)
    if data:
        yield data


def _text(data: bytes) -> str:
    """UTF-8, or a character for each byte: the patterns are ASCII."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _wide(data: bytes) -> Iterator[tuple[str, int]]:
    """(text, place) of ASCII in two-byte characters; each stands at 2 bytes from the place on."""
    if b"\x00" in data:
        for m in WIDE.finditer(data):
            first = m.start() + (data[m.start()] == 0)
            yield data[first : m.end() : 2].decode("ascii"), first


def _bytes_layers(data: bytes, lo: np.ndarray, hi: np.ndarray) -> Iterator[Layer]:
    """The texts of decoded bytes; what was compressed comes from all bytes from its beginning on."""
    if PROMISING.search(data):
        yield Layer(*_characters(data, lo, hi))
        for text, first in _wide(data):
            at = first + 2 * np.arange(len(text))
            yield Layer(text, lo[at], hi[at])
    yield from _packed_layers(data, lo, hi)


def _packed_layers(data: bytes, lo: np.ndarray, hi: np.ndarray) -> Iterator[Layer]:
    starts = {m.start() for m in MAGIC.finditer(data)}
    if _decoder(data) is not None:
        starts.add(0)
    for start in sorted(starts):
        if (read := _unpacked(data[start:] if start else data)) is None:
            continue
        for piece in _pieces(read()):
            if PROMISING.search(piece):
                for text in (_text(piece), *(t for t, _ in _wide(piece))):
                    yield Layer(text, np.broadcast_to(lo[start], len(text)), np.broadcast_to(hi[-1], len(text)))


def percent_layers(whole: str) -> Iterator[Layer]:
    for a, b in _lines(whole, PERCENT):
        data, lo, hi, at = bytearray(), [], [], a
        for m in PERCENT.finditer(whole, a, b):
            _plain(whole, at, m.start(), data, lo, hi)
            data.append(int(whole[m.start() + 1 : m.end()], 16))
            lo.append(m.start())
            hi.append(m.end())
            at = m.end()
        _plain(whole, at, b, data, lo, hi)
        lo, hi = np.array(lo), np.array(hi)
        yield Layer(*_characters(bytes(data), lo, hi))
        for text, first in _wide(bytes(data)):
            at = first + 2 * np.arange(len(text))
            yield Layer(text, lo[at], hi[at])
        for m in re.finditer(r"(?:%[0-9A-Fa-f]{2}){6,}", whole[a:b]):  # bytes that are no text may be compressed
            first = np.arange(a + m.start(), a + m.end(), 3)
            yield from _packed_layers(bytes.fromhex(m[0].replace("%", "")), first, first + 3)


def _plain(text: str, a: int, b: int, data: bytearray, lo: list, hi: list) -> None:
    for i in range(a, b):
        raw = text[i].encode("utf-8", "surrogatepass")
        data += raw
        lo += [i] * len(raw)
        hi += [i + 1] * len(raw)


def escape_layers(whole: str) -> Iterator[Layer]:
    for a, b in _lines(whole, ESCAPE):
        out, lo, hi, at = [], [], [], a
        for m in ESCAPE.finditer(whole, a, b):
            code = int(m[6]) if m[6] else int(next(g for g in m.groups() if g), 16)
            if code > 0x10FFFF:
                continue
            out += whole[at : m.start()]
            lo += range(at, m.start())
            hi += range(at + 1, m.start() + 1)
            char = chr(code)
            if 0xDC00 <= code < 0xE000 and out and 0xD800 <= ord(out[-1]) < 0xDC00:  # the second of a pair
                out[-1] = chr(0x10000 + ((ord(out[-1]) - 0xD800) << 10) + code - 0xDC00)
                hi[-1] = m.end()
            else:
                out.append(char)
                lo.append(m.start())
                hi.append(m.end())
            at = m.end()
        out += whole[at:b]
        lo += range(at, b)
        hi += range(at + 1, b + 1)
        if out:
            yield Layer("".join(out), np.array(lo), np.array(hi))


def base64_layers(whole: str) -> Iterator[Layer]:
    """A run may begin or go on with characters that only look like it, so it is decoded at each alignment."""
    for m in BASE64.finditer(whole):
        run, places = m[0].translate(PLAIN), None
        for shift in range(4):
            size = len(run) - shift
            size -= size % 4 == 1
            data = binascii.a2b_base64(run[shift : shift + size] + "=" * (-size % 4))
            if PROMISING.search(data) or MAGIC.search(data) or _decoder(data) is not None:
                if places is None:
                    places = np.array([m.start() + i for i, c in enumerate(m[0]) if c not in "\r\n="])
                byte = np.arange(len(data))
                lo = places[shift + byte * 8 // 6]
                hi = places[shift + np.minimum((byte * 8 + 7) // 6, size - 1)] + 1
                yield from _bytes_layers(data, lo, hi)


def scan(text: str) -> tuple[list, list]:
    """(secrets written in the text, all secrets), each (start, kind, end) and sorted."""
    base = find_secrets(text)
    number, found, places = {_name(text): 0}, [set(base)], [[]]
    work = [(0, _layers(text))]
    while work:
        around, layers = work[-1]
        layer = next(layers, None)
        if layer is None:
            work.pop()
            continue
        inner = number.setdefault(_name(layer.text), len(found))
        if inner == len(found):
            found.append(set(find_secrets(layer.text)))
            places.append([])
            work.append((inner, _layers(layer.text)))
        places[inner].append((around, layer.starts, layer.ends))
    carry = {i for i, secrets in enumerate(found) if secrets}
    while carry:
        inner = carry.pop()
        for around, starts, ends in places[inner]:
            more = {(int(starts[a]), kind, int(ends[b - 1])) for a, kind, b in found[inner]} - found[around]
            if more:
                found[around] |= more
                carry.add(around)
    return base, sorted(found[0])


def _layers(text: str) -> Iterator[Layer]:
    for layers in (percent_layers, escape_layers, base64_layers):
        yield from layers(text)


def _name(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def redact(text: str, spans: list) -> str:
    """``text`` with each maximal covered stretch replaced by ``MASK``."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if end <= at:
            continue
        if start > at or not out:
            out += [text[at:start], MASK]
        at = end
    return "".join([*out, text[at:]])


def rows_with_run(data: np.ndarray, offsets: np.ndarray, members: np.ndarray, length: int) -> np.ndarray:
    """Rows that may hold ``length`` consecutive bytes of a set."""
    inside = np.concatenate([[False], members[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edges[::2], edges[1::2]
    long = ends - begins >= length
    rows = np.zeros(len(offsets) - 1, bool)
    first = np.searchsorted(offsets, begins[long], "right") - 1
    last = np.searchsorted(offsets, ends[long] - 1, "right") - 1
    for a, b in zip(first, last):
        rows[a : b + 1] = True
    return rows


def _set(characters: bytes) -> np.ndarray:
    members = np.zeros(256, bool)
    members[list(characters)] = True
    return members


HEX_SET = _set(b"0123456789abcdef")
RUN_SET = _set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
ESCAPE_SET = _set(b"%\\&")


def _escaped(raw: bytes) -> bool:
    return bool(re.search(rb"%[0-9A-Fa-f]{2}|\\[uUx]|&#", raw))


def _scan_rows(batch: pa.RecordBatch) -> Iterator[tuple[str, list, list]]:
    """(text, secrets written in it, all secrets) of each row."""
    data, offsets = text_buffer(batch, "text")
    maybe = rows_with_run(data, offsets, HEX_SET, 32) | rows_with_run(data, offsets, RUN_SET, LEAST_RUN)
    escaped = rows_with_run(data, offsets, ESCAPE_SET, 1)
    raw = data.tobytes()
    for i in range(batch.num_rows):
        own = raw[offsets[i] : offsets[i + 1]]
        text = own.decode("utf-8", "replace")
        if maybe[i] or (escaped[i] and _escaped(own)) or any(k in (low := own.lower()) for k in KEYWORDS):
            yield text, *scan(text)
        else:
            yield text, [], []


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    struct = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]
    for batch in batches:
        texts, base, spans = [], [], []
        for text, first, every in _scan_rows(batch):
            texts.append(redact(text, every) if every else text)
            base.append(struct(first))
            spans.append(struct(every))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(base, kind), pa.array(spans, kind)], names=["doc_id", "text", "base", "spans"])


def mask_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for batch in batches for part in slices(batch, "text")):
        masked = {i: redact(text, every) for i, (text, _, every) in enumerate(_scan_rows(batch)) if every}
        if masked:
            for name in {"text", "n_chars"}.intersection(batch.schema.names):
                k = batch.schema.get_field_index(name)
                values = batch.column(k).to_pylist()
                for i, text in masked.items():
                    values[i] = text if name == "text" else len(text)
                batch = batch.set_column(k, batch.schema.field(k), pa.array(values, batch.schema.field(k).type))
        yield batch


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in its texts masked, and n_chars, if it has it, counted anew for those.

    Only the column text is needed. A null text stays null and an empty one empty; rows that repeat are
    masked each; other columns are kept as they are; an empty table gives an empty table.
    """
    return docs.mapInArrow(mask_batches, docs.schema)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every document: a row per row of ``docs``, with doc_id, text (secrets masked), base (the
    spans of secrets that stand in the text) and spans (those and the places of encoded ones).

    Spans are in code points, the end exclusive, by start and kind. ``docs`` has doc_id and text; other
    columns are ignored. A null or empty text has no secret; repeated rows are searched each; an empty
    table gives an empty table.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(scan_batches, SCHEMA)
