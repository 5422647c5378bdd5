"""Secret scans with structural confirmation of encoded keys and signed tokens."""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastergrid.llm.common import fresh, slices, texts_of

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "der", "openssh")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the whole runs that have 16 or more
JWT = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
#: Start of base64 whose first byte is a DER sequence, or of an OpenSSH key: behind anything but a base64
#: character, or behind the letter of an escaped line end or tab.
KEY_START = re.compile(r"M(?:(?<![A-Za-z0-9+/_-]M)|(?<=\\[nrt]M))[A-Za-z0-9+/_-]{31}"
                       r"|b(?:(?<![A-Za-z0-9+/_-]b)|(?<=\\[nrt]b))3BlbnNzaC1rZXktdjEA[A-Za-z0-9+/_-]")
#: What parts two lines of base64: line ends and the blanks around them, escaped once or more, or not.
GAP = re.compile(r"(?:[ \t]|\\+t)*(?:\\+[rn]|[\r\n])(?:[ \t\r\n]|\\+[rnt])*")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
HEX_DER = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{38,}")
OPENSSH = b"openssh-key-v1\0"

INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
CONTEXT = (0xA0, 0xA1, 0x81)
MOST_PARTS = 9  # PKCS#1 has nine; PKCS#8, SEC 1 and DSA have fewer


def _element(data: bytes | _Bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, content start and content end of the DER element at a position, if its length fits."""
    if at + 2 > end:
        return None
    tag, size, start = data[at], data[at + 1], at + 2
    if size & 0x80:
        more = size & 0x7F
        if not 1 <= more <= 4 or start + more > end:
            return None
        size, start = int.from_bytes(data[start:start + more], "big"), start + more
        if size < 0x80:
            return None
    return (tag, start, start + size) if start + size <= end else None


def _children(data: bytes | _Bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill a range exactly, if they are no more than a key can have."""
    found = []
    while start < end:
        element = _element(data, start, end)
        if element is None or len(found) == MOST_PARTS:
            return None
        found.append(element)
        start = element[2]
    return found


def der_key(data: bytes | _Bytes) -> int | None:
    """Length of the private key that ``data`` starts with: PKCS#1, PKCS#8 (plain or encrypted), SEC 1
    or DSA, with every nested length and the order of the parts right."""
    outer = _element(data, 0, len(data))
    if outer is None or outer[0] != SEQUENCE or outer[2] < 20:
        return None
    parts = _children(data, outer[1], outer[2])
    if not parts:
        return None
    tags = [p[0] for p in parts]
    version = data[parts[0][1]:min(parts[0][2], parts[0][1] + 2)]

    def algorithm(part) -> bool:
        inner = _children(data, part[1], part[2])
        return bool(inner) and inner[0][0] == OID and inner[0][2] - inner[0][1] >= 3

    if tags[0] == INTEGER and version in (b"\0", b"\1"):
        numbers = all(t == INTEGER for t in tags)
        rsa = numbers and len(tags) == 9
        dsa = numbers and len(tags) == 6
        pkcs8 = (tags[1:3] == [SEQUENCE, OCTETS] and algorithm(parts[1])
                 and all(t in CONTEXT for t in tags[3:]))
        sec1 = (version == b"\1" and tags[1:2] == [OCTETS] and parts[1][2] - parts[1][1] >= 16
                and all(t in CONTEXT for t in tags[2:]))
        right = rsa or dsa or pkcs8 or sec1
    else:
        right = tags == [SEQUENCE, OCTETS] and algorithm(parts[0]) and parts[1][2] - parts[1][1] >= 16
    return outer[2] if right else None


def openssh_key(data: bytes | _Bytes) -> int | None:
    """Length of the OpenSSH private key that ``data`` starts with, by its nested lengths."""
    if data[:len(OPENSSH)] != OPENSSH:
        return None
    at = len(OPENSSH)

    def field(at: int) -> int | None:
        end = at + 4 + int.from_bytes(data[at:at + 4], "big")
        return end if at + 4 <= len(data) and end <= len(data) else None

    for _ in range(3):  # cipher, derivation, its options
        if (at := field(at)) is None:
            return None
    keys = int.from_bytes(data[at:at + 4], "big")
    if not 1 <= keys <= 16:
        return None
    at += 4
    for _ in range(keys + 1):  # public keys, the private part
        if (at := field(at)) is None:
            return None
    return at


def _decode(chars: str) -> bytes:
    chars = chars[:len(chars) - (len(chars) % 4 == 1)].replace("-", "+").replace("_", "/")
    return base64.b64decode(chars + "=" * (-len(chars) % 4))


def _json_object(part: str) -> dict | None:
    try:
        found = json.loads(_decode(part))
    except (ValueError, binascii.Error, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _tokens(text: str):
    for m in JWT.finditer(text):
        header, payload, signature = m[0].split(".")
        head = _json_object(header)
        if (head and isinstance(head.get("alg"), str) and head["alg"].lower() != "none"
                and len(signature) % 4 != 1 and _json_object(payload) is not None):
            yield "jwt", m.start(), m.end()


class _Run:
    """Lines of base64 with nothing but line ends and blanks between them."""

    def __init__(self, text: str, start: int):
        self.starts, self.totals, lines, total = [], [0], [], 0  # where each line starts; characters before it
        at = start
        while line := LINE.match(text, at):
            self.starts.append(at)
            lines.append(line[0])
            self.totals.append(total := total + len(line[0]))
            self.end = line.end()
            gap = GAP.match(text, self.end)
            if gap is None:
                break
            at = gap.end()
        self.chars = "".join(lines)

    def before(self, at: int) -> int:
        """Characters of base64 before a place in the text."""
        line = bisect_right(self.starts, at) - 1
        return self.totals[line] + at - self.starts[line]

    def end_of(self, n: int) -> int:
        """Place in the text behind the first ``n`` characters of base64."""
        line = bisect_left(self.totals, n) - 1
        return self.starts[line] + n - self.totals[line]


class _Bytes:
    """The bytes that a run encodes from one of its characters on; only those asked for are decoded."""

    def __init__(self, run: _Run, first: int):
        self.chars, self.first = run.chars, first
        self.size = (len(run.chars) - first) * 3 // 4

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, key: int | slice) -> int | bytes:
        start, stop, _ = (key if isinstance(key, slice) else slice(key, key + 1)).indices(self.size)
        at = self.first + start // 3 * 4
        found = _decode(self.chars[at:self.first + -(-stop // 3) * 4])[start % 3:start % 3 + max(stop - start, 0)]
        return found if isinstance(key, slice) else found[0]


def _base64_keys(text: str):
    """Every start is tried, those inside of a candidate that is no key too; the search goes on behind
    the end of a key."""
    run, done = None, 0
    while m := KEY_START.search(text, done):
        done = m.start() + 1
        if run is None or m.start() >= run.end:
            run = _Run(text, m.start())
        first = run.before(m.start())
        data = _Bytes(run, first)
        for kind, size in (("der", der_key(data)), ("openssh", openssh_key(data))):
            if size is not None:
                done = run.end_of(first - (-size * 8 // 6))
                yield kind, m.start(), done + re.match(r"={0,2}", text[done:done + 2]).end()


def _hex_keys(text: str):
    for m in HEX_DER.finditer(text):
        size = der_key(bytes.fromhex(m[0][:len(m[0]) // 2 * 2]))
        if size is not None:
            yield "der", m.start(), m.start() + 2 * size


def find(text: str) -> list[tuple[str, int, int]]:
    """``kind, start, end`` of all secrets of a text, by start, then kind; code points, end exclusive.

    ``assign``, ``access`` and ``hex`` are patterns. ``jwt`` is reported where header and payload
    decode to JSON objects and the header names a signature, ``der`` where base64 or hex decodes to a
    private key whose nested lengths and parts are right, ``openssh`` likewise. A key ends where its
    own length says, whatever follows it.
    """
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    found += _tokens(text)
    found += _base64_keys(text)
    found += _hex_keys(text)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str) -> str:
    """The text with every secret replaced by its kind; overlapping ones become one."""
    out, done = [], 0
    for kind, start, end in find(text):
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` with ``spans`` an array of ``kind, start, end``, one row for each row of
    ``docs``. Null texts are empty and hold nothing; repeated rows and null ids stay as they are."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in slices(batches):
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in find(t)]
                     for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "spans": pa.array(spans, kind)})

    return texts_of(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans as text."""
    def joined(spans: str) -> str:
        return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"

    base = "filter(spans, s -> s.kind in ('assign', 'access', 'hex'))"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE_KINDS]
    return scanned.select("doc_id", *counts, F.sha2(F.expr(joined(base)), 256).alias("base_sha256"),
                          F.expr(joined("spans")).alias("spans"))


def redact(docs: DataFrame, length_column: str = "n_chars") -> DataFrame:
    """``docs`` with the secrets of ``text`` replaced; all rows and columns stay, null texts stay null.
    Where a text changed, ``length_column`` (if there is one) is its new length."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(redacted, na_action="ignore")

    name = fresh(docs, "cleaned")
    out = docs.withColumn(name, clean(docs["text"].cast("string")))
    if length_column in docs.columns:
        changed = F.col(name) != docs["text"]
        out = out.withColumn(length_column, F.when(changed, F.length(name).cast("long")).otherwise(F.col(length_column)))
    return out.withColumn("text", F.col(name)).select(*docs.columns)
