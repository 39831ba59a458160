"""Secret scans with a recursive decoding worklist.

Base findings, leftmost and non-overlapping per kind, on the text itself: `assign` (a name such
as password or api_key, an optional quote, = or :, and a value of 6 or more characters),
`access` (AKIA and capitals or digits, 20 or more) and `hex` (24 or more of 0-9a-f).

The text is the first layer of a worklist. Each layer is scanned for the three kinds and for
encodings: runs of %XX and backslash escapes are decoded in place; base64 runs of 16 characters or
more (no shorter one holds a finding), also such as lines break, are decoded from each of their first
four characters, as what stands before may be glued to them, and give layers of their own; so does
gzip, zlib, bzip2 or xz data at any place of decoded bytes, member after member, and UTF-16. Decoded
bytes are read one character each, which loses nothing: all that is sought is ASCII. Layers without
anything that could be found or decoded are left at once.

Every character of a layer knows the span of the document it came from, so a finding in any layer is
reported where it stands in the document. Layers already seen are not taken up again, so decoding
cycles end; in place each decoding shortens its layer. Unpacked data is scanned in pieces of 4 MiB
that overlap by 64 KiB and by the run that is open at a piece's end, so an archive of any expansion
takes bounded memory; only a run of over 1 MiB of unpacked data is cut.

Null and empty texts have no findings. Repeated rows are scanned each. Texts of any length are
scanned whole. An empty table gives no rows; other columns are ignored. Findings of the base scan
are always among the spans.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})+")
ESCAPED = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\U([0-9A-Fa-f]{8})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
CODED = re.compile(r"[A-Za-z0-9+/_-]{16,}")
WRAPPED = re.compile(r"(?:[A-Za-z0-9+/_-]{16,}[\x20\t]*(?:\r\n|\n|\r)[\x20\t]*)+[A-Za-z0-9+/_-]+")
BREAKS = re.compile(r"[^A-Za-z0-9+/_-]+")
ENCODED = re.compile(rb"%[0-9A-Fa-f]{2}|\\[uUx]")
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY|\xfd7zXZ\x00", re.S)
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
TO_HEX = bytes(0x68 if b in b"0123456789abcdef" else 0x20 for b in range(256))
TO_CODED = bytes(0x62 if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_-") else 0x20 for b in range(256))
TO_OPEN = bytes(0x62 if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_.=%\\{}-") else 0x20 for b in range(256))
PIECE, OVERLAP, LONGEST = 4 << 20, 1 << 16, 1 << 20


def base_findings(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of one layer; raw is its UTF-8, which tells at once what can't be there."""
    found = []
    low = raw.lower()
    if any(n in low for n in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in raw.translate(TO_HEX):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A decoded text and, for each character, the span of the document that it came from; None: the document itself; one span for all, where `begin` is a number."""

    def __init__(self, text: str, begin=None, end=None):
        self.text, self.begin, self.end = text, begin, end

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.begin is None:
            return a, b
        return (self.begin, self.end) if isinstance(self.begin, int) else (int(self.begin[a]), int(self.end[b - 1]))

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        if self.begin is None:
            return np.arange(len(self.text)), np.arange(1, len(self.text) + 1)
        return self.begin, self.end

    def replaced(self, parts: list[tuple[int, int, str]]) -> Layer:
        """The layer with [a, b) replaced by a decoded text, for each part in order."""
        texts, begins, ends, at = [], [], [], 0
        lone = isinstance(self.begin, int)
        begin, end = (None, None) if lone else self.places()
        for a, b, new in parts:
            texts += [self.text[at:a], new]
            if not lone:
                lo, hi = self.span(a, b)
                # characters of the decoded text share out the encoded ones evenly, which is exact for %XX
                own = np.linspace(a, b, len(new) + 1).astype(np.int64)
                exact = len(new) and (b - a) % len(new) == 0
                begins += [begin[at:a], begin[own[:-1]] if exact else np.full(len(new), lo)]
                ends += [end[at:a], end[own[1:] - 1] if exact else np.full(len(new), hi)]
            at = b
        text = "".join([*texts, self.text[at:]])
        return Layer(text, self.begin, self.end) if lone else Layer(text, np.concatenate([*begins, begin[at:]]), np.concatenate([*ends, end[at:]]))

    def picked(self, text: str, first: np.ndarray, last: np.ndarray) -> Layer:
        """A text whose characters come from these characters of the layer, first and last of each."""
        if isinstance(self.begin, int):
            return Layer(text, self.begin, self.end)
        begin, end = self.places()
        return Layer(text, begin[first], end[last])

    def whole(self, text: str, a: int, b: int) -> Layer:
        """A text all of whose characters come from [a, b)."""
        return Layer(text, *self.span(a, b))


def unescaped(run: str) -> str | None:
    try:
        out = "".join(chr(int(next(x for x in m.groups() if x), 16)) for m in ESCAPED.finditer(run))
        return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    except (ValueError, OverflowError, UnicodeError):
        return None


def unquoted(run: str) -> str:
    return bytes.fromhex(run.replace("%", "")).decode("latin-1")


def opened(data: bytes):
    """A decompressor for data that begins with the mark of one, or None."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78":
        return zlib.decompressobj(15)
    return bz2.BZ2Decompressor() if data[:3] == b"BZh" else lzma.LZMADecompressor() if data[:6] == b"\xfd7zXZ\x00" else None


def unpacked(data: bytes):
    """Compressed data in overlapping pieces, as far as it goes; nothing if it isn't compressed."""
    tail = b""
    while (machine := opened(data)) is not None:
        rest = data
        try:
            while not machine.eof:
                out = machine.decompress(rest, PIECE)
                rest = getattr(machine, "unconsumed_tail", b"")
                if out:
                    piece = tail + out
                    yield piece
                    keep = max(OVERLAP, min(LONGEST, len(piece) - 1 - piece.translate(TO_OPEN).rfind(b" ")))
                    tail = piece[-keep:]
                elif not rest and getattr(machine, "needs_input", True):
                    return
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            return
        data = machine.unused_data.lstrip(b"\0")


def promising(data: bytes) -> bool:
    """Whether anything could be found in these bytes or decoded from them."""
    low = data.lower()
    return any(n in low for n in NAMES) or b"AKIA" in data or b"h" * 24 in data.translate(TO_HEX) or b"b" * 16 in data.translate(TO_CODED) or ENCODED.search(data) is not None


def layers_of(layer: Layer, data: bytes, first: np.ndarray, last: np.ndarray):
    """Layers of decoded bytes, each of which comes from these characters of the layer."""
    if promising(data):
        yield layer.picked(data.decode("latin-1"), first, last)
    if 3 * data.count(0) > len(data):
        for at in (0, 1):
            text = data[at::2]
            if promising(text):
                yield layer.picked(text.decode("latin-1"), first[at::2], last[at::2])
    for m in MAGIC.finditer(data):
        for piece in unpacked(data[m.start() :]):
            if promising(piece):
                yield layer.whole(piece.decode("latin-1"), int(first[m.start()]), int(last[-1]) + 1)


def decoded(layer: Layer, run: str, places: np.ndarray):
    """Layers of a base64 run whose characters stand at these places, from each of its first four characters on."""
    if run == run[0] * len(run):
        return  # one character over and over holds nothing
    plain = run.replace("-", "+").replace("_", "/")
    for shift in range(4):
        n = len(plain) - shift
        n -= n % 4 == 1
        if n < 15:
            continue
        data = base64.b64decode(plain[shift : shift + n] + "=" * (-n % 4))
        k = np.arange(len(data))
        yield from layers_of(layer, data, places[shift + k * 4 // 3], places[shift + np.minimum((k * 8 + 13) // 6, n) - 1])


def next_layers(layer: Layer, raw: bytes):
    """The layers one decoding further in."""
    for sign, pattern, decode in ((b"%", PERCENT, unquoted), (b"\\", ESCAPE, unescaped)):
        if sign not in raw:
            continue
        parts = [(m.start(), m.end(), new) for m in pattern.finditer(layer.text) if (new := decode(m[0])) is not None]
        if parts:
            yield layer.replaced(parts)
        for a, b, new in parts:
            if len(new) >= 8 and max(new) < "\u0100" and MAGIC.search(data := new.encode("latin-1")):
                places = np.linspace(a, b, len(new) + 1).astype(np.int64)
                yield from layers_of(layer, data, places[:-1], np.maximum(places[1:] - 1, places[:-1]))
    if b"b" * 16 in raw.translate(TO_CODED):
        for m in CODED.finditer(layer.text):
            yield from decoded(layer, m[0], np.arange(m.start(), m.end()))
        if b"\n" in raw or b"\r" in raw:
            for m in WRAPPED.finditer(layer.text):
                run = BREAKS.sub("", m[0])
                places = np.array([i for i in range(m.start(), m.end()) if not layer.text[i].isspace()], np.int64)
                yield from decoded(layer, run, places)


def scan(raw: bytes | None) -> tuple[list, list]:
    """Base findings and all findings of a document: (start, kind, end), sorted."""
    if not raw:
        return [], []
    text = raw.decode("utf-8", "surrogatepass")
    base = sorted(base_findings(text, raw))
    every, seen, work = set(base), set(), [next_layers(Layer(text), raw)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        own = layer.text.encode("utf-8", "surrogatepass")
        place = repr(layer.span(0, len(layer.text)) if layer.text else None).encode()
        mark = hashlib.blake2b(own + place, digest_size=16).digest()
        if mark in seen or not layer.text or layer.text == text:
            continue
        seen.add(mark)
        for a, kind, b in base_findings(layer.text, own):
            lo, hi = layer.span(a, b)
            every.add((lo, kind, hi))
        work.append(next_layers(layer, own))
    return base, sorted(every)


def listed(found: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scanned(documents: DataFrame) -> DataFrame:
    """One row per row of documents: counts, digest of the base findings, all spans."""
    small_batches(documents.sparkSession)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def find(batches):
        for batch in batches:
            rows = []
            for t in batch.column(1).cast(pa.binary()):
                base, every = scan(t.as_py())
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            columns = [pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(find, schema)


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
