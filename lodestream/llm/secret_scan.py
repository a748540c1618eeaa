"""Secret scans with structural confirmation.

Patterns give the base spans; base64 and hex candidates are decoded, and key
encodings (DER with nested lengths), PEM blocks and signed-token headers are
parsed before they are reported. Tokens may be signed (three parts), detached (an
empty payload) or encrypted (five parts). A key may begin anywhere in a run of
base64 or hex digits and ends where its own length says; runs of base64 go on
over single line breaks. No length or number of items is bounded; each run is
decoded a fixed number of times and read once: a token's header is found from its
end, and items of keys that several candidates share are visited once. A header
nested more deeply than the JSON parser goes is none. Offsets are code points, ends exclusive. Null counts as empty text; empty
texts and texts without a secret give no span; an empty table gives no row; rows
are judged each for itself, so repeats and ties don't matter.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "jwt", "pem", "der")
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
#: Parts between dots, two dots at least, from the start of a run.
DOTTED = re.compile(rb"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,}+")
#: What a JSON object is balanced by.
STRUCTURE = re.compile(rb'["{}\[\]]')
BEGIN, END = re.compile(rb"-----BEGIN ([A-Z0-9 ]+)-----"), re.compile(rb"-----END ([A-Z0-9 ]+)-----")
#: Header lines of an armoured block, up to an empty line.
HEADERS = re.compile(rb"\s*(?:[A-Za-z0-9-]+:[^\n]*\n(?:[ \t]+\S[^\n]*\n)*)+[ \t\r]*\n")
ARMOURED = re.compile(rb"[A-Za-z0-9+/=\s]*")
#: Runs that may hold a key: base64, over single line breaks too, from its first possible start; hex.
BASE64 = re.compile(rb"M(?:[A-Za-z0-9+/]|\r?\n(?=[A-Za-z0-9+/])){39,}+")
HEX_KEY = re.compile(rb"30[0-9a-fA-F]{58,}+")
#: The shortest key, in bytes.
KEY_BYTES = 30
VALUE = np.zeros(256, np.uint8)
VALUE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")] = np.arange(64)
NIBBLE = np.zeros(256, np.uint8)
NIBBLE[list(b"0123456789abcdef")] = NIBBLE[list(b"0123456789ABCDEF")] = np.arange(16)


def _der_size(data: bytes | memoryview, at: int) -> tuple[int, int] | None:
    """Where the content of the item at ``at`` begins and ends, or None."""
    if at + 2 > len(data):
        return None
    size, at = data[at + 1], at + 2
    if size & 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or at + width > len(data):
            return None
        size, at = int.from_bytes(data[at : at + width], "big"), at + width
    return at, at + size


class Items:
    """Items that follow each other in ``data``, from any place on; every place is visited once, whichever chains lead to it.

    Where a chain goes from a place depends on nothing before it, so chains that
    meet stay together: a forest, in which each place also keeps a jump further
    along. The jumps tell in a logarithmic number of steps whether a chain passes
    through a given end.
    """

    def __init__(self, data: memoryview):
        self.data, self.links, self.wrong, self.value = data, {}, {}, {}

    def _visit(self, at: int) -> None:
        """Links from ``at`` to the end of its chain: (next, depth, jump)."""
        path, links, data = [], self.links, self.data
        while at not in links:
            found = _der_size(data, at)
            if found is None or found[1] > len(data):
                links[at] = at, 0, at
                break
            path.append((at, found[1]))
            at = found[1]
        for at, after in reversed(path):
            _, depth, jump = links[after]
            _, d1, further = links[jump]
            d2 = links[further][1]
            links[at] = after, depth + 1, further if depth - d1 == d1 - d2 else after

    def fill(self, at: int, end: int) -> int:
        """How many items fill ``at`` to ``end`` exactly; 0 if they don't."""
        self._visit(at)
        first = depth = self.links[at][1]
        while at < end:
            after, depth, jump = self.links[at]
            if after == at:
                return 0
            at = jump if jump <= end else after
        return first - self.links[at][1] if at == end else 0

    def _first(self, at: int, end: int, known: dict[int, int], test: Callable[[int], bool]) -> bool:
        """Whether an item of the chain before ``end`` passes the test. ``known`` maps a place to itself if it does, else to a later one before which none does."""
        path = []
        while at < end:
            to = known.get(at)
            if to == at:
                break
            if to is None and test(at):
                known[at] = at
                break
            path.append(at)
            at = self.links[at][0] if to is None else to
        for p in path:
            known[p] = at
        return at < end

    def is_key(self, at: int, end: int) -> bool:
        """The content ``at`` to ``end`` of a sequence: two items or more, an integer, bit or octet string, and only sequences that items fill."""
        data = self.data

        def hollow(x: int) -> bool:
            return data[x] == 0x30 and not self.fill(*_der_size(data, x))

        return self.fill(at, end) >= 2 and not self._first(at, end, self.wrong, hollow) and self._first(at, end, self.value, lambda x: data[x] in (0x02, 0x03, 0x04))


def _key_end(items: Items, at: int) -> int | None:
    """Where the key that begins at ``at`` ends: one outer sequence whose nested lengths add up, with an integer, bit or octet string inside."""
    data = items.data
    outer = _der_size(data, at) if at < len(data) and data[at] == 0x30 else None
    if outer is None or outer[1] > len(data) or outer[1] == outer[0] or data[outer[0]] not in (0x02, 0x30):
        return None  # keys begin with a version or an algorithm
    return outer[1] if items.is_key(*outer) else None


def is_der(data: bytes) -> bool:
    return bool(data) and _key_end(Items(memoryview(data)), 0) == len(data)


def _object(data: bytes) -> dict | None:
    try:
        found = json.loads(data)
        return found if isinstance(found, dict) else None
    except (ValueError, RecursionError):
        return None


def _decoded(data: bytes, altchars: bytes | None = None) -> bytes:
    try:
        return base64.b64decode(data + b"=" * (-len(data) % 4), altchars, validate=True)
    except (ValueError, binascii.Error):
        return b""


def _last_object(data: bytes) -> int | None:
    """Where the object that ends ``data`` begins, by its brackets alone, read from the end: outside of it, no quote is open."""
    stack, quoted = [], False
    for at in reversed([m.start() for m in STRUCTURE.finditer(data)]) if data.rstrip(b" \t\r\n").endswith(b"}") else ():
        c = data[at]
        if c == 0x22:
            before = at
            while before and data[before - 1] == 0x5C:
                before -= 1
            quoted ^= (at - before) % 2 == 0
        elif quoted:
            continue
        elif c in b"}]":
            stack.append(c - 2)
        elif not stack or stack.pop() != c:
            return None
        elif not stack:
            return at if c == 0x7B else None
    return None


def _header(run: bytes) -> tuple[int, dict] | None:
    """Where in ``run``, which ends before a dot, a token's header begins: an object that names an algorithm and ends the run. Every grid of four characters is decoded once."""
    best = None
    for phase in range(min(4, len(run))):
        if len(run) % 4 == (phase + 1) % 4:  # a digit left over
            continue
        data = _decoded(run[phase:], b"-_")
        brace = _last_object(data)
        if brace is None:
            continue
        first = brace
        while first and data[first - 1] in b" \t\r\n":
            first -= 1
        first = -(-first // 3) * 3  # on the grid
        found = _object(data[first:]) if first <= brace else None
        if found is not None and isinstance(found.get("alg"), str) and (best is None or phase + first // 3 * 4 < best[0]):
            best = phase + first // 3 * 4, found
    return best


def _tokens(data: bytes) -> Iterator[tuple[int, int, str]]:
    for m in DOTTED.finditer(data):
        parts = m[0].split(b".")
        at = [m.start()]
        for p in parts:
            at.append(at[-1] + len(p) + 1)
        i = 0
        while i + 2 < len(parts):
            signed = len(parts[i + 1]) >= 2 and _object(_decoded(parts[i + 1], b"-_")) is not None
            detached, five = not parts[i + 1] and bool(parts[i + 2]), i + 4 < len(parts) and all(parts[i + 2 : i + 5])
            head = _header(parts[i]) if parts[i] and (signed or detached or five) else None
            if head is None:
                i += 1
                continue
            last = i + 4 if five and isinstance(head[1].get("enc"), str) else i + 2
            if last == i + 2 and not (signed or detached):
                i += 1
                continue
            yield at[i] + head[0], at[last + 1] - 1, "jwt"
            i = last + 1


def is_pem(label: bytes, body: bytes) -> bool:
    """A body that decodes to a key encoding, or, said to be encrypted, to anything."""
    head = HEADERS.match(body)
    rest = body[head.end() :] if head else body
    if not ARMOURED.fullmatch(rest):
        return False
    raw = _decoded(b"".join(rest.split()))
    encrypted = b"KEY" in label and b"ENCRYPTED" in (label + head[0] if head else label)
    return is_der(raw) or raw.startswith(b"openssh-key-v1\0") or (encrypted and len(raw) >= 16)


def _blocks(data: bytes) -> Iterator[tuple[int, int, str]]:
    """Armoured blocks: each begin mark with the next end mark of its label, unless another begins before."""
    ends: dict[bytes, list[tuple[int, int]]] = {}
    for m in END.finditer(data):
        ends.setdefault(m[1], []).append(m.span())
    begins = list(BEGIN.finditer(data))
    for k, m in enumerate(begins):
        held = ends.get(m[1], [])
        at = bisect.bisect_left(held, (m.end(), 0))
        if at < len(held) and (k + 1 == len(begins) or begins[k + 1].start() > held[at][0]) and is_pem(m[1], data[m.end() : held[at][0]]):
            yield m.start(), held[at][1], "pem"


def _keys_in(value: np.ndarray, bits: int, decode: Callable[[int], bytes]) -> Iterator[tuple[int, int]]:
    """(first, end) of the key encodings in a run of digits of ``bits`` bits each, from any digit on; their length says where they end.

    ``decode(phase)`` gives the bytes of the run from that digit on; a byte group has 4 digits of base64, or 2 of hex.
    """
    group = 4 if bits == 6 else 2
    v = value.astype(np.int64)
    n = len(v) - 8
    if n <= 0:
        return
    if bits == 6:
        head, second = (v[:n] << 2) | (v[1 : n + 1] >> 4), ((v[1 : n + 1] & 15) << 4) | (v[2 : n + 2] >> 2)
    else:
        head, second = (v[:n] << 4) | v[1 : n + 1], (v[2 : n + 2] << 4) | v[3 : n + 3]
    held, done = {}, 0
    for p in np.flatnonzero((head == 0x30) & (second != 0x80) & (second <= 0x84)).tolist():
        if p < done:
            continue
        phase = p % group
        if phase not in held:
            held[phase] = Items(memoryview(decode(phase)))
        items, at = held[phase], p // group * (3 if bits == 6 else 1)
        size = _der_size(items.data, at)
        if size is not None and KEY_BYTES <= size[1] - at and (end := _key_end(items, at)) is not None:
            done = p + -(-8 * (end - at) // bits)
            yield p, done


def _keys(data: bytes) -> Iterator[tuple[int, int, str]]:
    for m in BASE64.finditer(data):
        run = np.frombuffer(m[0], np.uint8)
        place = np.flatnonzero(run > 32)  # without line breaks
        digits = run[place].tobytes()

        def decode(phase: int, digits: bytes = digits) -> bytes:
            part = digits[phase:]
            return _decoded(part[: len(part) - 1] if len(part) % 4 == 1 else part)

        for a, b in _keys_in(VALUE[run[place]], 6, decode):
            end = m.start() + int(place[b - 1]) + 1
            pad = -(b - a) % 4
            end += pad if pad and data[end : end + pad] == b"=" * pad else 0
            yield m.start() + int(place[a]), end, "der"
    for m in HEX_KEY.finditer(data):
        digits = m[0]
        for a, b in _keys_in(NIBBLE[np.frombuffer(digits, np.uint8)], 4, lambda phase, d=digits: bytes.fromhex(d[phase : len(d) - (len(d) - phase) % 2].decode())):
            yield m.start() + a, m.start() + b, "der"


def find_spans(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes."""
    found = []
    low = data.lower()
    if any(k in low for k in (b"passw", b"secret", b"token", b"api")):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(low) if len(m[1]) >= 6]
    if b"AKIA" in data:
        found += [(*m.span(), "access") for m in ACCESS.finditer(data) if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in HEX.finditer(data)]
    found += _tokens(data)
    blocks = list(_blocks(data)) if b"-----BEGIN" in data else []
    return found + blocks + [k for k in _keys(data) if not any(x <= k[0] and k[1] <= y for x, y, _ in blocks)]


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found = find_spans(data)
    if found and len(data) != len(text):
        at, chars, where = 0, 0, {}
        for x in sorted({x for a, b, _ in found for x in (a, b)}):
            chars += len(data[at:x].decode("utf-8", "surrogatepass"))
            at = where[x] = x
            where[x] = chars
        found = [(where[a], where[b], k) for a, b, k in found]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str | None, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str | None:
    """The text with every span (overlapping ones joined) replaced."""
    if not spans:
        return text
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``, an array of (kind, start, end), and ``redacted``; columns of these names, in any case, are replaced."""
    keep = [c for c in docs.columns if c.lower() not in ("secrets", "redacted")]
    docs = docs.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "secrets array<struct<kind:string,start:bigint,end:bigint>>, redacted string"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                found, clean = [], []
                for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                    spans = scan(t)
                    found.append([{"kind": k, "start": a, "end": b} for a, b, k in spans])
                    clean.append(redact(t, spans))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind), pa.array(clean, pa.string())], [*keep, "secrets", "redacted"])

    return docs.mapInArrow(each, schema)


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = secret_scan(docs)
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return done.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))
