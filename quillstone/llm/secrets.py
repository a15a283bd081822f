"""Secret scans over a recursive decoding worklist.

``scan(text)`` finds the base kinds in a text, then unwraps what is nested in
it: percent escapes, ``\\uXXXX`` and ``\\xXX`` escapes, base64 runs, and gzip or
zlib streams (all members, one in another) inside base64, which may be wrapped over lines, also
by written-out ``\\n``, and may begin behind up to three letters that are not part of it. A
decoded layer is scanned if it is UTF-8, whatever its characters, or else if it
holds ``LEAST_VALUE`` readable ASCII characters in a row, as UTF-16 or among other bytes. Each new layer goes on a worklist, is scanned again
and unwrapped again until nothing new appears; a set of the layers already seen
ends cycles. Every layer knows from which places of the layer before its pieces come, so that a find in any layer is reported as a
span of the original.

Escapes are undone to the end in one pass: no escape overlaps another, so the order does not
matter, and what a decoded character completes with those before it is decoded at once. Time is in proportion to the
text however deep they are nested. Escaped bytes that are no UTF-8 become replacement characters.

Defined cases: a null text is the empty text and has no finds; repeated rows
stay repeated; an empty table gives an empty table; ties (several finds of one
kind with the same span) count once; only the id and text columns are read. A
compressed stream is read whole unless it grows beyond ``MAX_LAYER`` bytes; then
the run that holds it is itself reported, as kind ``opaque``, instead of being
passed over.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, map_batches, row_slices, text_buffers

KINDS = ("assign", "access", "hex", "opaque")
RANK = {k: i for i, k in enumerate(KINDS)}
MAX_LAYER = 64 << 20  #: bytes to which one compressed layer may grow

# Fixed values of the contract: the patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.A)
HEX = re.compile(r"[0-9a-f]{16,}", re.A)
LEAST_VALUE, LEAST_ACCESS = 12, 18
WORDS = ("passw", "secret", "token", "apikey", "api_key")

#: A percent escape; one of a percent sign's own escapes over and over counts as one.
PERCENT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
ESCAPED = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
BEGUN = re.compile(r"(?:%[0-9A-Fa-f]?|\\(?:x[0-9A-Fa-f]?|u[0-9A-Fa-f]{0,3})?)\Z")
ENDED = re.compile(r"(?:%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4}))\Z")
SIGN = re.compile(r"[%\\]")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}", re.A)
BREAK = re.compile(r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*", re.A)
WRAPPED = re.compile(rf"""[A-Za-z0-9+/_-]{{16,}}(?:{BREAK.pattern}[A-Za-z0-9+/_-]+)+(?:={{1,2}}|(?=[^A-Za-z0-9+/_-]|$))""", re.A)
STRETCH = re.compile(rb"[\x20-\x7e]{%d,}" % LEAST_VALUE)
WIDE = re.compile(rb"(?:[\x20-\x7e]\x00){%d,}|(?:\x00[\x20-\x7e]){%d,}" % (LEAST_VALUE, LEAST_VALUE))
SHIFTS = 4  #: places at which a run's base64 may begin, as letters before it may look like part of it
LETTERS_ONLY = re.compile(r"[a-z]+|[A-Z]?[a-z]+|[0-9a-f]+", re.A)

Span = tuple[int, int]


def base_finds(text: str) -> list[tuple[str, int, int]]:
    """Finds of the base kinds, leftmost and without overlap within a kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


class Layer:
    """A decoded text: all of it comes from the span ``whole`` of the original, or its pieces come from places of ``parent``.

    Piece k begins at ``at[k]``. It is a copy of what begins at ``start[k]`` if ``end[k]`` is -1, else each of its characters comes from start[k] to end[k].
    """

    __slots__ = ("text", "parent", "at", "start", "end", "whole", "known")

    def __init__(self, text: str, parent: Layer | None = None, whole: Span | None = None, known=frozenset()):
        self.text, self.parent, self.whole, self.known = text, parent, whole, known
        self.at, self.start, self.end = array("q"), array("q"), array("q")

    def _piece(self, i: int) -> Span:
        k = bisect_right(self.at, i) - 1
        if self.end[k] >= 0:
            return self.start[k], self.end[k]
        return self.start[k] + i - self.at[k], self.start[k] + i - self.at[k] + 1

    def span(self, i: int, j: int) -> Span:
        layer = self
        while not layer.whole and layer.parent is not None:
            i, j, layer = layer._piece(i)[0], layer._piece(j - 1)[1], layer.parent
        return layer.whole or (i, j)


class _Unescaping:
    """The pieces of a text whose escapes are undone: copies, decoded characters, and bytes of 0x80 and more, which come together at the end."""

    def __init__(self):
        self.out: list[str] = []
        self.start, self.end = array("q"), array("q")
        self.tail = ""  #: the single characters at the end that may begin an escape
        self.changed = False

    def copy(self, text: str, i: int, j: int) -> None:
        if i < j:
            self.out.append(text[i:j])
            self.start.append(i)
            self.end.append(-1)
            self.tail = ""

    def push(self, ch: str, i: int, j: int) -> None:
        """One character; while it ends an escape, this is decoded in turn."""
        while True:
            self.out.append(ch)
            self.start.append(i)
            self.end.append(j)
            self.tail = (self.tail + ch)[-6:]
            m = ENDED.search(self.tail)
            if not m:
                return
            n = len(m[0])
            i, j = self.start[-n], self.end[-1]
            del self.out[-n:], self.start[-n:], self.end[-n:]
            self.tail = self.tail[:-n]
            if not BEGUN.search(self.tail):
                self.tail = "".join(x if len(x) == 1 else " " for x in self.out[-6:])
            ch = _character(m[1] or m[2] or m[3], m[1] is not None)
            self.changed = True

    def layer(self, parent: Layer) -> Layer:
        made, parts, k, n = Layer("", parent), [], 0, 0
        while k < len(self.out):
            last = k + 1
            if "\udc80" <= self.out[k] <= "\udcff" and len(self.out[k]) == 1:
                while last < len(self.out) and len(self.out[last]) == 1 and "\udc80" <= self.out[last] <= "\udcff":
                    last += 1
                pieces = _characters([ord(x) - 0xDC00 for x in self.out[k:last]])
            elif len(self.out[k]) == 1 and "\ud800" <= self.out[k] < "\udc00" and last < len(self.out) and len(self.out[last]) == 1 and "\udc00" <= self.out[last] <= "\udfff" and self.end[k] >= 0:
                last += 1
                pieces = [((self.out[k] + self.out[last - 1]).encode("utf-16", "surrogatepass").decode("utf-16"), 0, 2)]
            else:
                pieces = [(self.out[k] if len(self.out[k]) > 1 or not "\ud800" <= self.out[k] <= "\udfff" else "\ufffd", 0, 1)]
            for text, i, j in pieces:
                parts.append(text)
                made.at.append(n)
                made.start.append(self.start[k + i])
                made.end.append(-1 if self.end[k + i] < 0 else self.end[k + j - 1])
                n += len(text)
            k = last
        made.text = "".join(parts)
        return made


def _character(digits: str, is_byte: bool) -> str:
    """What an escape stands for; a byte beyond ASCII is kept as a lone surrogate until its neighbours are known."""
    code = int(digits, 16)
    return chr(0xDC00 + code) if is_byte and code >= 0x80 else chr(code)


def _characters(raw: list[int]) -> list[tuple[str, int, int]]:
    """Characters of UTF-8 bytes and the places of these; a byte that fits nowhere becomes a replacement character."""
    out, k = [], 0
    data = bytes(raw)
    while k < len(data):
        for n in (2, 3, 4):
            try:
                out.append((data[k : k + n].decode(), k, k + n))
            except UnicodeDecodeError:
                continue
            if k + n <= len(data):
                k += n
                break
            out.pop()
        else:
            out.append(("\ufffd", k, k + 1))
            k += 1
    return out


def unescape(layer: Layer) -> Layer | None:
    """The layer with all escapes undone, those that others hid included; None if it has none."""
    text, u, p = layer.text, _Unescaping(), 0
    while p < len(text):
        if u.tail and BEGUN.search(u.tail):
            m = PERCENT.match(text, p) if text[p] == "%" else None
            if not m:
                u.push(text[p], p, p + 1)
                p += 1
                continue
        q = SIGN.search(text, p)
        if not q:
            break
        u.copy(text, p, q.start())
        p = q.start()
        m = PERCENT.match(text, p) or ESCAPED.match(text, p)
        if m:
            u.changed = True
            u.push(_character(m[1] or m[2], m.re is PERCENT), p, m.end())
            p = m.end()
        else:
            u.push(text[p], p, p + 1)
            p += 1
    if not u.changed:
        return None
    u.copy(text, p, len(text))
    return u.layer(layer)


def inflate(raw: bytes) -> bytes | None:
    """What a gzip or zlib stream holds, all members; None if it is none; OverflowError beyond MAX_LAYER."""
    out = b""
    while raw[:2] == b"\x1f\x8b" or (len(raw) > 2 and raw[0] & 0x0F == 8 and (raw[0] << 8 | raw[1]) % 31 == 0):
        if len(out) >= MAX_LAYER:
            raise OverflowError
        d = zlib.decompressobj(47)
        try:
            out += d.decompress(raw, MAX_LAYER - len(out))
        except zlib.error:
            break
        if d.unconsumed_tail:
            raise OverflowError
        raw = d.unused_data
    return out or None


def _readable(raw: bytes) -> str | None:
    if m := WIDE.search(raw):
        first = m.start() % 2
        return raw[first:].decode("utf-16-be" if raw[m.start()] == 0 else "utf-16-le", errors="replace")
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode(errors="replace") if STRETCH.search(raw) else None


def _wrapped(t: str) -> Iterator[list[Span]]:
    """The runs of base64 that may go on over line breaks, as the places of their lines.

    Of a block of lines these are all of it and, from each change of width on,
    the lines of one width with and without the shorter one that follows them.
    """
    for m in WRAPPED.finditer(t):
        breaks = [b.span() for b in BREAK.finditer(t, *m.span())]
        lines = list(zip([m.start(), *(j for _, j in breaks)], [*(i for i, _ in breaks), m.end()], strict=True))
        width = [j - i for i, j in lines]
        seen = {(0, len(lines))}
        k = 0
        while k + 1 < len(lines):
            # the first line may begin within its line, so the second one's width counts too
            end = k + 1
            while end < len(lines) and width[end] == width[k + 1]:
                end += 1
            seen |= {(k, end), (k, min(end + 1, len(lines)))}
            if width[k] != width[k + 1]:
                seen |= {(k + 1, end), (k + 1, min(end + 1, len(lines)))}
            k = max(end - 1, k + 1)
        for i, j in sorted(seen):
            if j - i > 1:
                yield lines[i:j]


def _base64(run: str) -> str | None:
    """The text inside a base64 run, unpacked as often as it is compressed; it may begin up to three letters into the run."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    for shift in range(SHIFTS):
        part = body[shift:]
        if len(part) % 4 == 1:
            continue
        try:
            raw = base64.b64decode(part + "=" * (-len(part) % 4), validate=True)
        except binascii.Error:
            continue
        packed, seen = inflate(raw), set()
        while packed is not None and (name := hashlib.sha1(packed).digest()) not in seen:
            seen.add(name)
            raw, packed = packed, inflate(packed)
        if (text := _readable(raw)) is not None:
            return text
    return None


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base finds, all finds) as (kind, start, end), ordered by start, then by kind, then by end."""
    base = base_finds(text)
    found = set(base)
    seen = {text if len(text) < 64 else hashlib.sha1(text.encode("utf-8", "surrogatepass")).digest()}
    work = [Layer(text)]
    while work:
        layer = work.pop()
        new: list[Layer] = []
        t = layer.text
        if ("%" in t or "\\" in t) and (x := unescape(layer)):
            new.append(x)
        for m in BASE64.finditer(t):
            if LETTERS_ONLY.fullmatch(m[0]):
                continue
            span = layer.span(*m.span())
            try:
                inner = _base64(m[0])
            except OverflowError:
                found.add(("opaque", *span))
                continue
            if inner is not None:
                new.append(Layer(inner, whole=span))
        for lines in _wrapped(t) if "\n" in t or "\\n" in t else ():
            span = layer.span(lines[0][0], lines[-1][1])
            try:
                inner = _base64("".join(t[i:j] for i, j in lines))
                if inner is not None:
                    # what a line holds by itself has been found there, with a closer span
                    alone = [x for i, j in lines if j - i >= 16 and (x := _base64(t[i:j])) is not None]
                    new.append(Layer(inner, whole=span, known={(k, x[i:j]) for x in alone for k, i, j in base_finds(x)}))
            except OverflowError:
                found.add(("opaque", *span))
        for x in new:
            key = (x.whole, x.text if len(x.text) < 64 else hashlib.sha1(x.text.encode("utf-8", "surrogatepass")).digest())
            if key in seen:
                continue
            seen.add(key)
            work.append(x)
            for kind, i, j in base_finds(x.text):
                if (kind, x.text[i:j]) not in x.known:
                    found.add((kind, *x.span(i, j)))
    order = lambda f: (f[1], RANK[f[0]], f[2])
    return sorted(base, key=order), sorted(found, key=order)


def _scan_batch(batch: pa.RecordBatch) -> Iterator[dict]:
    data, ends = text_buffers(batch.column(1))
    for lo, hi in row_slices(ends):
        base, every = [], []
        for i in range(lo, hi):
            b, e = scan(data[ends[i] : ends[i + 1]].tobytes().decode())
            base.append([{"kind": k, "start": s, "stop": t} for k, s, t in b])
            every.append([{"kind": k, "start": s, "stop": t} for k, s, t in e])
        yield {"id": batch.column(0).slice(lo, hi - lo), "base": base, "spans": every}


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): arrays of (kind, start, stop) in code points of the text, stop exclusive."""
    kind = df.schema[id_col].dataType.simpleString()
    span = "array<struct<kind:string,start:int,stop:int>>"
    return map_batches(df.select(F.col(id_col), F.col(text_col).cast("string")), _scan_batch, f"`{id_col}` {kind}, base {span}, spans {span}")


def _joined(column: str):
    return F.concat_ws(",", F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])))


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    x = find_secrets(load(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return x.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


QUERIES = {"op9_secrets": op9_secrets}
ORACLES: dict[str, str] = {}
