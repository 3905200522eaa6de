"""Secrets in texts and in what is encoded in them.

A worklist starts with the text. Each layer is scanned, then unwrapped: URL
and Unicode escapes, runs of base64 on one line or wrapped over lines of one
width, and compressed bytes inside those. What comes out is a new layer, until
none does. A layer that repeats one of those it came from ends there. Findings
in a layer are mapped to the span of the text that encodes them; an escape
maps to itself, a base64 run as a whole.

Of a layer of escapes only the stretches around what changed go on, up to the
next letter that is in no run and no secret. Layers of escapes are looked at
one by one until these hold Limits.letters letters and Limits.times times those
of the text; the rest of such layers are resolved in one pass to where none is
left, so that deep nesting takes time in proportion to the text. So texts of up
to 5,000 letters, which hold 8,000,000 in all their layers at most, are always
looked at layer by layer, and None for letters does so with any text. The map
of a layer names places of the text itself, at any depth.

A base64 run whose bytes are no UTF-8 is read where LEGIBLE of them in a row
are printable: fewer hold no secret and no layer with one. Hexadecimal digits
that an escape takes are no secret of a layer; what is left of them is looked
at in the next.

Null text: as empty. Null doc_id: stays null. Texts are scanned whole. Other
columns, whatever their names, are not read by scan_secrets and pass through
redact_secrets. Repeated rows are rows of their own, ties don't arise, and an
empty table gives no rows.

Compressed layers are read to their end, all members of them, and scanned in
windows that bound memory; a window is a layer of its own. Only in a stretch of
over Limits.longest letters of those that runs and secrets consist of can a
window's end fall inside one: a base64 run of over half of that is not decoded
whole, unless the limit is raised, at the cost of so much memory. The largest
dictionary that xz writes is read; of it, memory holds what the stream fills.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import contextlib
import hashlib
import lzma
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from dataclasses import dataclass, field
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

PIECE, WINDOW = 1 << 16, 4 << 20
#: xz writes dictionaries of up to 1.5 GiB; its decoder needs some more.
MOST_DICTIONARY = 1700 << 20
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Printable bytes in a row that can hold a secret or a layer with one.
LEGIBLE = re.compile(rb"[\t\n\r\x20-\x7e]{14,}")
#: What an escape's digits follow.
OPENING = re.compile(r"(?:%|\\x|\\u\{?)$")
ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\})+")
ONE_UNICODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}")
#: The standard alphabet, the URL-safe one, and both: in "a-" + standard base64 only the first begins in phase.
BASE64 = tuple(re.compile(rf"[A-Za-z0-9{more}]{{12,}}={{0,2}}") for more in ("+/", "_-", "+/_-"))
LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t]*+(?:\r\n?|\n)[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: A letter that is in no run and no secret.
APART = re.compile(r"""[^A-Za-z0-9+/_.=%\\{}:"'\x20\t\r\n-]""")
LAST_APART = re.compile(f"(?s).*{APART.pattern}")
#: What base64 may follow without being told from it: paths, options, names.
JOINTS = re.compile("[/_+-]")
PACKED = re.compile("H4sI|e[ANFJ]|Qlpo|/Td6")

Span = tuple[str, int, int]
Part = tuple[str, int, int]
Large = tuple[bytes, int, int]


@dataclass(frozen=True)
class Limits:
    """letters, times: of layers of escapes in a row that are looked at one by one (None: all); longest: letters of a window without an end."""

    letters: int | None = 8_000_000
    times: int = 32
    longest: int = 64 << 20

    def looked_at(self, layers: int, text: int) -> bool:
        return self.letters is not None and layers > max(self.letters, self.times * text)


#: What tables are scanned with: a text's size decides nothing.
EVERY_LAYER = Limits(letters=None)
LIMITS: ContextVar[Limits] = ContextVar("limits", default=Limits())


@dataclass
class Map:
    """Where the pieces of a layer begin, what they are in another text, and whether they are that letter by letter."""

    at: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    plain: list[bool] = field(default_factory=list)
    size: int = 0

    def add(self, length: int, start: int, end: int, plain: bool) -> None:
        if length:
            self.at.append(self.size)
            self.start.append(start)
            self.end.append(end)
            self.plain.append(plain)
            self.size += length

    def back(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        a = self.start[i] + (start - self.at[i]) * self.plain[i]
        b = self.start[j] + (end - self.at[j]) if self.plain[j] else self.end[j]
        return a, b

    def through(self, outer: Map) -> Map:
        """The map to what outer maps to."""
        out = Map()
        for k, at in enumerate(self.at):
            length = (self.at[k + 1] if k + 1 < len(self.at) else self.size) - at
            start, end = self.start[k], self.end[k]
            if not self.plain[k]:
                out.add(length, *outer.back(start, end), False)
                continue
            i = bisect_right(outer.at, start) - 1
            while start < end:
                stop = min(end, outer.at[i + 1] if i + 1 < len(outer.at) else outer.size)
                if outer.plain[i]:
                    first = outer.start[i] + start - outer.at[i]
                    out.add(stop - start, first, first + stop - start, True)
                else:
                    out.add(stop - start, outer.start[i], outer.end[i], False)
                start, i = stop, i + 1
        return out


def _whole(length: int, start: int, end: int, plain: bool = False) -> Map:
    out = Map()
    out.add(length, start, end, plain)
    return out


@dataclass
class Layer:
    text: str
    path: str
    map: Map
    above: frozenset[bytes]
    letters: int = 0  # of layers of escapes in a row


def scan(text: str) -> list[Span]:
    """kind, start, end, sorted by start and kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(s: Span) -> tuple[int, int, int]:
    return s[1], KINDS.index(s[0]), s[2]


class _Zlib:
    """A zlib or gzip member with the attributes of the other decompressors."""

    def __init__(self) -> None:
        self.of, self.tail = zlib.decompressobj(47), b""

    def decompress(self, data: bytes, most: int) -> bytes:
        out = self.of.decompress(self.tail + data, most)
        self.tail = self.of.unconsumed_tail
        return out

    eof = property(lambda self: self.of.eof)
    unused_data = property(lambda self: self.of.unused_data)
    needs_input = property(lambda self: not self.tail)


def _codec(head: bytes) -> Callable | None:
    if head[:2] == b"\x1f\x8b" or (len(head) > 5 and head[0] == 0x78 and int.from_bytes(head[:2], "big") % 31 == 0):
        return _Zlib
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if head[:6] == b"\xfd7zXZ\x00":
        return lambda: lzma.LZMADecompressor(memlimit=MOST_DICTIONARY)
    return None


def _members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What gzip, zlib, bzip2 or xz members hold one after the other, in pieces; what follows them and is none, as it is. Ends at a fault."""
    machine, left, ended = None, b"", False
    while not ended:
        left, ended = (left + more, False) if (more := next(chunks, None)) is not None else (left, True)
        while left:
            if machine is None:
                left = left.lstrip(b"\0")  # padding
                if len(left) < 6 and not ended:
                    break
                if (make := _codec(left)) is None:
                    yield left
                    yield from chunks
                    return
                machine = make()
            try:
                while True:
                    piece = machine.decompress(left, PIECE)
                    left = b""
                    if piece:
                        yield piece
                    if machine.eof or machine.needs_input:
                        break
            except (zlib.error, OSError, EOFError, lzma.LZMAError):
                return
            if machine.eof:
                left, machine = machine.unused_data, None


def _pieces(data: bytes | memoryview) -> Iterator[bytes]:
    return (data[at : at + PIECE] for at in range(0, len(data), PIECE))


def _opened(data: bytes | memoryview) -> tuple[str, Iterator[bytes]]:
    """(names of the layers of compression, what is under them)."""
    name, chunks, seen = "", _pieces(data), set()
    while True:
        head = b""
        while len(head) < PIECE and (more := next(chunks, None)) is not None:
            head += more
        kind = hashlib.blake2b(head).digest()
        # bytes that hold themselves end here
        if _codec(head) is None or kind in seen:
            return name, chain([head], chunks)
        seen.add(kind)
        inner = _members(chain(_pieces(head), chunks))
        if not (first := next(inner, b"")):
            return name, chain([head], chunks)
        name, chunks = name + ">zip", chain([first], inner)


def _windows(texts: Iterator[str]) -> Iterator[str]:
    """The text in windows of about WINDOW, cut after a letter that is in no run and no secret, so that nothing is cut in two.

    A stretch without such a letter is cut after the longest that the limits allow, and the windows there overlap by half.
    """
    parts, size = [], 0
    longest = LIMITS.get().longest
    for text in texts:
        parts.append(text)
        size += len(text)
        if size >= WINDOW and (m := LAST_APART.match(text)):
            window = "".join(parts)
            yield window[: (cut := size - len(text) + m.end())]
            parts, size = [window[cut:]], size - cut
        elif size >= longest:
            yield (window := "".join(parts))
            parts, size = [window[longest // 2 :]], size - longest // 2
    yield "".join(parts)


def _unpacked(chunks: Iterator[bytes]) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    texts = chain((decoder.decode(c) for c in chunks), (decoder.decode(b"", True) for _ in range(1)))
    return (w for w in _windows(texts) if w)


def _as_texts(data: bytes) -> Iterator[tuple[str, str]]:
    """(text, names of the layers) of windows of bytes that are text; under compression, bytes that are no text are marks."""
    name, chunks = _opened(data)
    if name:
        yield from ((w, name) for w in _unpacked(chunks))
        return
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return
    if text:
        yield text, name


def _first(data: bytes, start: int, end: int, large: list[Large]) -> list[Part] | None:
    """The first window of compressed bytes; if there are more, the bytes are added to large."""
    got = list(islice(_as_texts(data), 2))
    if len(got) > 1:
        large.append((data, start, end))
    return [(got[0][0], start, end)] if got else None


def _url(run: str, at: int, large: list[Large]) -> list[Part] | None:
    data = bytes.fromhex(run.replace("%", ""))
    if _codec(data) and _opened(data)[0]:
        return _first(data, at, at + len(run), large)
    parts: list[Part] = []
    done = 0
    for c in data.decode("utf-8", "surrogateescape"):
        n = 1 if "\udc80" <= c <= "\udcff" else len(c.encode("utf-8"))
        # a byte that is no letter stays escaped
        parts.append((run[3 * done : 3 * done + 3] if "\udc80" <= c <= "\udcff" else c, at + 3 * done, at + 3 * (done + n)))
        done += n
    return parts if any(len(p[0]) == 1 for p in parts) else None


def _unicode(run: str, at: int, large: list[Large]) -> list[Part] | None:
    codes = [(int(next(g for g in one.groups() if g), 16), at + one.start(), at + one.end()) for one in ONE_UNICODE.finditer(run)]
    data = bytes(c for c, _, _ in codes) if all(c < 256 for c, _, _ in codes) else b""
    if _codec(data) and _opened(data)[0]:
        return _first(data, at, at + len(run), large)
    parts: list[Part] = []
    changed, k = False, 0
    while k < len(codes):
        c, start, end = codes[k]
        k += 1
        if 0xD800 <= c < 0xDC00 and k < len(codes) and 0xDC00 <= codes[k][0] < 0xE000:
            c, end, k = 0x10000 + ((c - 0xD800) << 10) + codes[k][0] - 0xDC00, codes[k][2], k + 1
        if 0xD800 <= c < 0xE000 or c > 0x10FFFF:  # no letter: stays escaped
            parts.append((run[start - at : end - at], start, end))
        else:
            parts.append((chr(c), start, end))
            changed = True
    return parts if changed else None


def _unescaped(text: str, large: list[Large]) -> tuple[str, str, Map] | None:
    """(names, the stretches with escapes after one layer of these, map to the text); stretches are set apart."""
    runs = []
    for m in ESCAPES.finditer(text):
        url = m[0][0] == "%"
        parts = (_url if url else _unicode)(m[0], m.start(), large)
        if parts is not None:
            runs.append((m.start(), m.end(), parts, "url" if url else "unicode"))
    if not runs:
        return None
    apart = [m.start() for m in APART.finditer(text)]
    out, back, done, stop = [], Map(), 0, 0
    for k, (start, end, parts, _) in enumerate(runs):
        i = bisect_left(apart, start)
        if start >= stop:  # in a stretch of its own
            done = apart[i - 1] + 1 if i else 0
            if out:
                out.append("\0")
                back.add(1, done, done, False)
            stop = apart[i] if i < len(apart) else len(text)
        out.append(text[done:start])
        back.add(start - done, done, start, True)
        for piece, a, b in parts:
            out.append(piece)
            back.add(len(piece), a, b, False)
        done = end
        if k + 1 == len(runs) or runs[k + 1][0] >= stop:
            out.append(text[done:stop])
            back.add(stop - done, done, stop, True)
    return "+".join(sorted({r[3] for r in runs})), "".join(out), back


def _settled(text: str) -> tuple[str, str, Map] | None:
    """(name, the text with its escapes resolved until none is left, map to the text), in one pass.

    Letters go on a stack; an escape that its top completes gives way to what
    it stands for, which may complete another. Bytes of longer letters wait for
    the rest of these, and surrogates for their other half.
    """
    seen: list[str] = []  # a letter, a longer stretch without escapes, or "%XX" or "\\uXXXX" of a part of a letter
    starts: list[int] = []
    ends: list[int] = []
    changed = False

    def put(n: int, value: str) -> None:
        nonlocal changed
        first, last = starts[-n], ends[-1]
        del seen[-n:], starts[-n:], ends[-n:]
        seen.append(value)
        starts.append(first)
        ends.append(last)
        changed = True

    def hexes(n: int) -> int | None:
        x = "".join(seen[-n:])
        return int(x, 16) if len(x) == n and all(c in "0123456789abcdefABCDEF" for c in x) else None

    def letter(n: int, code: int) -> None:
        if 0xD800 <= code < 0xE000:
            put(n, f"\\u{code:04x}")
            if code >= 0xDC00 and len(seen) > 1 and len(seen[-2]) == 6 and seen[-2].startswith("\\ud") and seen[-2] < "\\udc00":
                put(2, chr(0x10000 + ((int(seen[-2][2:], 16) - 0xD800) << 10) + code - 0xDC00))
        else:
            put(n, chr(code))

    def reduce() -> bool:
        if len(seen) >= 3 and seen[-3] == "%" and (b := hexes(2)) is not None:
            if b < 0x80:
                put(3, chr(b))
                return True
            put(3, f"%{b:02x}")
            for n in range(1, 5):
                tail = seen[-n:]
                if len(tail) < n or any(len(x) != 3 or x[0] != "%" for x in tail):
                    return False
                with contextlib.suppress(UnicodeDecodeError):
                    c = bytes.fromhex("".join(tail).replace("%", "")).decode("utf-8")
                    if len(c) == 1:
                        put(n, c)
                        return True
            return False
        if len(seen) >= 4 and seen[-4] == "\\" and seen[-3] == "x" and (c := hexes(2)) is not None:
            letter(4, c)
            return True
        if len(seen) >= 6 and seen[-6] == "\\" and seen[-5] == "u" and (c := hexes(4)) is not None:
            letter(6, c)
            return True
        if seen[-1] == "}":
            for n in range(1, 7):
                if len(seen) >= n + 4 and seen[-n - 2] == "{" and seen[-n - 3] == "u" and seen[-n - 4] == "\\":
                    code = "".join(seen[-n - 1 : -1])
                    if len(code) == n and all(x in "0123456789abcdefABCDEF" for x in code) and int(code, 16) <= 0x10FFFF:
                        letter(n + 4, int(code, 16))
                        return True
        return False

    def push(value: str, start: int) -> None:
        seen.append(value)
        starts.append(start)
        ends.append(start + len(value))

    at = 0
    while at < len(text):
        if text[at] in "%\\" or any(x in "%\\" for x in seen[-10:]):
            push(text[at], at)
            at += 1
            while reduce():
                pass
        else:  # no escape is open
            stop = m.start() if (m := re.compile(r"[%\\]").search(text, at)) else len(text)
            push(text[at:stop], at)
            at = stop
    if not changed:
        return None
    back = Map()
    for value, start, end in zip(seen, starts, ends, strict=True):
        back.add(len(value), start, end, end - start == len(value) and text[start:end] == value)
    return "escapes", "".join(seen), back


def _bytes(body: str) -> bytes:
    with contextlib.suppress(binascii.Error):
        return base64.b64decode(body + "=" * (-len(body) % 4)) if len(body) % 4 != 1 else b""
    return b""


def _base64(run: str, any_bytes: bool = True) -> Iterator[tuple[str, str, int]]:
    """(layer, names of compression, where in the run the base64 begins); any_bytes: also of bytes that are no UTF-8."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    found = False
    for inner, name in _as_texts(whole := _bytes(body)):
        found = True
        yield inner, name, 0
    if found:
        return
    # after a path or a name: what begins at a joint, read in one of four phases
    joints = [m.end() for m in JOINTS.finditer(run) if len(body) - m.end() >= 12]
    legible = [(whole, 0)] if LEGIBLE.search(whole) else []
    for phase in range(4):
        starts = [j for j in joints if j % 4 == phase]
        if not starts:
            continue
        data = _bytes(body[phase:])
        for j in starts:
            if PACKED.match(body, j) and _codec(data[(at := (j - phase) // 4 * 3) : at + 16]):
                name, chunks = _opened(memoryview(data)[at:])
                if name:
                    found = True
                    yield from ((inner, name, j) for inner in _unpacked(chunks))
        begin = _text_from(data)
        if (j := next((j for j in starts if (j - phase) // 4 * 3 >= begin), None)) is not None and (text := data[(j - phase) // 4 * 3 :].decode("utf-8")):
            found = True
            yield text, "", j
        elif m := LEGIBLE.search(data):
            before = [j for j in starts if (j - phase) // 4 * 3 <= m.start()]
            legible += [(data[(before[-1] - phase) // 4 * 3 :], before[-1])] if before else []
    # of another encoding, or with other bytes among the text
    for data, j in legible if any_bytes and not found else ():
        yield data.decode("utf-8", "replace"), "", j


def _text_from(data: bytes) -> int:
    """Where the last stretch of bytes that are text begins."""
    text = data.decode("utf-8", "surrogateescape")
    m = re.match("(?s).*[\udc80-\udcff]", text)
    return len(text[: m.end()].encode("utf-8", "surrogateescape")) if m else 0


def _wrapped(text: str) -> Iterator[tuple[str, str, bool, int, int]]:
    """(name, layer, whether a further window, start, end) of base64 over neighbouring lines.

    Lines of one width make a run, with what may begin it on the line before
    and end it on the one after; as that may be other text, also without.
    """
    for m in LINES.finditer(text):
        lines = [x.span() for x in LINE.finditer(text, m.start(), m.end())]
        widths = [b - a for a, b in lines]
        i = 0
        while i < len(lines):
            width, j = widths[i], i + 1
            while j < len(lines) and widths[j] == width:
                j += 1
            heads, tails = [lines[i:j]], [[]]
            if i and (widths[i - 1] > width and j - i > 1 or widths[i - 1] < width and i == 1):
                heads.append([(max(lines[i - 1][0], lines[i - 1][1] - width), lines[i - 1][1]), *lines[i:j]])
            if j < len(lines):
                tails.append([(lines[j][0], min(lines[j][1], lines[j][0] + width))])
            ended = found = False
            # bytes that are no UTF-8 are read only where no guess gives text
            guesses = [(part, tail, False) for tail in tails for part in (head + tail for head in heads)]
            guesses += [(heads[0] + tail, tail, True) for tail in reversed(tails)]
            for part, tail, any_bytes in guesses:
                if any_bytes and found:
                    break
                last = part[-1][1]
                end = m.end() if last == lines[-1][1] else last
                run = "".join(text[a:b] for a, b in part) + text[last:end]
                if len(part) > 1 and len(run) >= 12:
                    for k, (inner, name, at) in enumerate(_base64(run, any_bytes)):
                        found = True
                        ended |= bool(tail) and widths[j] < width
                        first = part[0][0]
                        for a, b in part if at else ():
                            first, at = a + at, at - (b - a)
                            if at < 0:
                                break
                        yield name, inner, k > 0, first, end
            # a line that ended a run begins none alone
            i = j + (ended and widths[j + 1 : j + 2] != [widths[j]])


def _runs(text: str) -> Iterator[tuple[str, str, bool, int, int]]:
    for start, end in sorted({m.span() for pattern in BASE64 for m in pattern.finditer(text)}):
        for k, (inner, name, at) in enumerate(_base64(text[start:end])):
            yield name, inner, k > 0, start + at, end


def unwrap(text: str, settle: bool = False) -> Iterator[tuple[str, str, Map, bool, bool]]:
    """(name, layer, map to the text, whether a further window of the same, whether by escapes) of each layer directly inside.

    settle: escapes are resolved to where none is left.
    """
    large: list[Large] = []
    if "%" in text or "\\" in text:
        got = _settled(text) if settle else _unescaped(text, large)
        if got:
            yield *got, False, True
        for data, start, end in large:
            for inner, _ in islice(_as_texts(data), 1, None):
                yield "escapes", inner, _whole(len(inner), start, end), True, False
    for name, inner, further, start, end in chain(_runs(text), _wrapped(text) if "\n" in text or "\r" in text else ()):
        yield "base64" + name, inner, _whole(len(inner), start, end), further, False


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _spelled(text: str, span: Span) -> bool:
    """Whether a hexadecimal span of a layer begins with digits that an escape takes; then it is looked at in the next layer."""
    kind, start, _ = span
    if kind != "hex" or not (m := OPENING.search(text, max(0, start - 3), start)):
        return False
    # bytes of longer letters and halves of pairs may stay escaped
    return int(text[start : start + 2], 16) < 128 if m[0] == "%" else not m[0].startswith("\\u") or text[start] != "d"


def find_secrets(text: str, limits: Limits | None = None) -> tuple[list[Span], list[tuple[str, Span]]]:
    """(base spans, added spans with the layers that they are under)."""
    limits = limits or Limits()
    base = scan(text)
    known = set(base)
    added: list[tuple[str, Span]] = []
    done: set[tuple[bytes, int, int]] = set()

    def follow(first: Layer) -> None:
        work = deque([first])
        while work:
            layer = work.popleft()
            for name, inner, back, further, escapes in unwrap(layer.text, limits.looked_at(layer.letters, len(text))):
                if not inner or (d := _digest(inner)) in layer.above:
                    continue
                to_text = back.through(layer.map)
                where = (d, *to_text.back(0, len(inner)))
                if where in done:
                    continue
                done.add(where)
                here = f"{layer.path}>{name}" if layer.path else name
                for kind, a, b in scan(inner):
                    span = (kind, *to_text.back(a, b))
                    if span not in known and not _spelled(inner, (kind, a, b)):
                        known.add(span)
                        added.append((here, span))
                next_layer = Layer(inner, here, to_text, layer.above | {d}, layer.letters + len(inner) if escapes else 0)
                if further:
                    follow(next_layer)  # at once: windows are not kept
                else:
                    work.append(next_layer)

    token = LIMITS.set(limits)
    try:
        if text:
            follow(Layer(text, "", _whole(len(text), 0, len(text), True), frozenset([_digest(text)])))
    finally:
        LIMITS.reset(token)
    return base, sorted(added, key=lambda x: _order(x[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, mark: str = "[SECRET]", limits: Limits | None = None) -> str:
    """The text with a mark for each stretch of spans that touch each other."""
    base, added = find_secrets(text, limits)
    spans = sorted((a, b) for _, a, b in [*base, *(s for _, s in added)])
    out, done = [], 0
    for a, b in spans:
        if b <= done:
            continue
        if a >= done:
            out += [text[done:a], mark]
        done = b
    return "".join(out) + text[done:] if spans else text


SECRETS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long, layers string"


def scan_secrets(docs: DataFrame, limits: Limits = EVERY_LAYER) -> DataFrame:
    """For each row: counts and digest of the base spans, all spans, and the added ones with their layers (layers/kind:start:end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                base, added = find_secrets(text.as_py(), limits)
                n = [sum(s[0] == k for s in base) for k in KINDS]
                every = sorted([*base, *(s for _, s in added)], key=_order)
                out.append((doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(added), ",".join(f"{p}/{k}:{a}:{b}" for p, (k, a, b) in added)))
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SECRETS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, SECRETS)


def redact_secrets(docs: DataFrame, limits: Limits = EVERY_LAYER) -> DataFrame:
    """The rows with a mark in place of each secret in text; a text without any stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if t is None else redacted(t, limits=limits) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
