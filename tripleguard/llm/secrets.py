"""Secret scan with structural confirmation.

Base patterns find assignments, access keys and long hexadecimal runs. Further candidates (runs of
base64 or hexadecimal letters, PEM blocks, dotted tokens) are reported only once they decode and
their structure holds: a DER sequence whose nested lengths add up and whose content is a key's, an
OpenSSH private key whose nested lengths fit, or a signed token whose header names an algorithm.
A key may stand anywhere in a run of base64 or hexadecimal digits (behind a path or a letter, wrapped over
lines, with colons between bytes): its own lengths say where it ends.

Defined results: a null or empty text has no spans (counts 0, spans empty, the hash that of the empty
string); every row gets one row, repeated ids included; only the two named columns
are read, so further columns may have any name. Positions count code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns and the least lengths of their matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
#: Kinds in the order in which spans of one start are listed; the last three are structural.
KINDS = ("assign", "access", "hex", "jwt", "key", "pem")

# Each scan reads a run of its letters once: a run has one place where a match may begin, and a block ends at the next beginning.
JWT = re.compile(r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))([A-Za-z0-9_-]++={0,2}\.[A-Za-z0-9_-]++={0,2}\.[A-Za-z0-9_-]*+={0,2})")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ ){0,4}PRIVATE KEY)-----((?:(?!-----)[A-Za-z0-9+/=\s\\:,.-])*+)-----END \1-----")
PEM_BYTES = re.compile(PEM.pattern.encode())
#: Encoded DER sequences (0x30 0x8X or a short length), OpenSSH keys and PEM blocks, in base64, or the former two in hexadecimal (also behind 0x).
ENCODED = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?:0[xX])?(M[A-Za-z0-9+/_-]{40,}={0,2}|b3BlbnNzaC1rZXk[A-Za-z0-9+/_-]{40,}={0,2}|LS0tLS1CRUdJTi[A-Za-z0-9+/_-]{40,}={0,2}|30[0-9A-Fa-f]{60,}|6[Ff]70656[Ee]7373682[Dd]6[Bb]65792[Dd]7631[0-9A-Fa-f]{40,})"
)

#: Runs of base64 or hexadecimal digits, over line ends and colons, in which a key may begin anywhere.
BASE64_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)*+")
HEX_RUNS = (
    re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{16,}+(?:[ \t]*+\r?\n[ \t]*+[0-9A-Fa-f]{2,}+)*+"),
    re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{2}(?::\s*+[0-9A-Fa-f]{2}){40,}+"),
)
#: How a key begins: a DER sequence that holds an integer or a sequence, an OpenSSH key, a PEM block; in base64 and in bytes.
BASE64_START = re.compile(r"M(?=I[E-P]|[A-H][AEIMQUYcgkosw048][Cw])|b3BlbnNzaC1rZXkt|LS0tLS1CRUdJTi")
START = re.compile(rb"\x30(?=[\x81-\x84]|[\x10-\x7f][\x02\x30])|openssh-key-v1\x00|-----BEGIN ", re.S)
#: Items of the longest kind of key, and public keys that one OpenSSH file may hold, with room to spare.
MOST_ITEMS = 16

OUTPUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def decoded(text: str) -> bytes | None:
    """The bytes of a base64 (either alphabet) or hexadecimal text, None if it is neither."""
    if re.fullmatch(r"(?:[0-9A-Fa-f]{2})+", text):
        return bytes.fromhex(text)
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1 or not re.fullmatch(r"[A-Za-z0-9+/]+", body):
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except binascii.Error:
        return None


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the contents of the items that fill data[start:end] exactly; None if lengths don't add up or there are more than a key has."""
    items: list[tuple[int, int, int]] = []
    while start < end:
        if start + 2 > end or len(items) == MOST_ITEMS:
            return None
        tag, n, start = data[start], data[start + 1], start + 2
        if n & 0x80:
            k = n & 0x7F
            if not 0 < k <= 4 or start + k > end:
                return None
            n, start = int.from_bytes(data[start : start + k], "big"), start + k
        if start + n > end:
            return None
        items.append((tag, start, start + n))
        start += n
    return items


def der_end(data: bytes, at: int) -> int | None:
    """Where a private key that begins at the given place ends (PKCS#1 or DSA integers, SEC 1, PKCS#8 or encrypted PKCS#8); None if there is none."""
    n, start = data[at + 1] if at + 1 < len(data) else 0x80, at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 0 < k <= 4:
            return None
        n, start = int.from_bytes(data[start : start + k], "big"), start + k
    end = start + n
    if data[at : at + 1] != b"\x30" or end > len(data):
        return None
    inside = der_items(data, start, end)
    if not inside:
        return None
    tags, sizes = [t for t, _, _ in inside], [b - a for _, a, b in inside]

    def algorithm(item: tuple[int, int, int]) -> bool:
        items = der_items(data, item[1], item[2])
        return bool(items) and items[0][0] == 0x06

    integers = len(tags) >= 6 and set(tags[:6]) == {0x02}
    curve = tags[:2] == [0x02, 0x04] and sizes[0] == 1 and sizes[1] >= 16
    wrapped = tags[:3] == [0x02, 0x30, 0x04] and sizes[0] == 1 and algorithm(inside[1])
    encrypted = tags == [0x30, 0x04] and algorithm(inside[0])
    return end if integers or curve or wrapped or encrypted else None


def openssh_end(data: bytes, at: int) -> int | None:
    """Where an OpenSSH private key that begins at the given place ends; None if there is none."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic, at):
        return None
    i, number = at + len(magic), 3  # cipher, key derivation and its options
    while number:
        if i + 4 > len(data):
            return None
        i, number = i + 4 + int.from_bytes(data[i : i + 4], "big"), number - 1
    number = int.from_bytes(data[i : i + 4], "big")
    if i + 4 > len(data) or not 0 < number <= MOST_ITEMS:
        return None
    i += 4
    for _ in range(number + 1):  # public keys, then the private part
        if i + 4 > len(data):
            return None
        i += 4 + int.from_bytes(data[i : i + 4], "big")
    return i if i <= len(data) else None


def pem_end(data: bytes, at: int) -> int | None:
    """Where a PEM block that begins at the given place ends; None if there is none or it holds no key."""
    if not data.startswith(b"-----BEGIN ", at):
        return None
    m = PEM_BYTES.match(data, at)
    return m.end() if m and is_pem(m[2].decode("latin-1")) else None


def key_end(data: bytes, at: int) -> int | None:
    return der_end(data, at) or openssh_end(data, at) or pem_end(data, at)


def is_der_key(data: bytes) -> bool:
    return der_end(data, 0) == len(data)


def is_openssh_key(data: bytes) -> bool:
    return openssh_end(data, 0) == len(data)


def is_key(text: str) -> bool:
    data = decoded(text)
    if data is None:
        return False
    if data.startswith(b"-----BEGIN "):
        return any(is_pem(m[2]) for m in PEM.finditer(data.decode("latin-1")))
    return is_der_key(data) or is_openssh_key(data)


def is_signed_token(text: str) -> bool:
    """A header naming its algorithm, a payload that is an object, and a signature unless it says none."""
    head, body, signature = text.split(".")
    try:
        header, payload = (json.loads(decoded(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(payload, dict) or not isinstance(header.get("alg"), str):
        return False
    return header["alg"].lower() == "none" or bool(signature and decoded(signature))


def embedded_keys(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of keys that begin anywhere in a run of digits. A run is decoded once for each way its digits may be grouped."""
    for m in BASE64_RUN.finditer(text):
        run = m[0]
        digits = re.sub(r"\s+", "", run)
        data: dict[int, bytes] = {}
        free, found = 0, []
        for s in BASE64_START.finditer(digits):
            at, shift = s.start(), s.start() % 4
            if at < free:
                continue
            if shift not in data:
                data[shift] = _grouped(digits[shift:])
            begin = (at - shift) // 4 * 3
            if (end := key_end(data[shift], begin)) is not None:
                free = at + -((begin - end) * 4 // 3)
                found.append((at, free))
        for a, b in _placed(run, found):
            after = text[m.start() + b : m.start() + b + 2]
            yield m.start() + a, m.start() + b + len(after) - len(after.lstrip("="))
    for pattern in HEX_RUNS:
        for m in pattern.finditer(text):
            run = m[0]
            digits = re.sub(r"[^0-9A-Fa-f]+", "", run)
            found = []
            for shift in (0, 1):
                free = 0
                raw = bytes.fromhex(digits[shift : len(digits) - (len(digits) - shift) % 2])
                for s in START.finditer(raw):
                    if shift + 2 * s.start() >= free and (end := key_end(raw, s.start())) is not None:
                        free = shift + 2 * end
                        found.append((shift + 2 * s.start(), free))
            yield from ((m.start() + a, m.start() + b) for a, b in _placed(run, sorted(found)))


def _grouped(digits: str) -> bytes:
    body = digits[: len(digits) - (len(digits) % 4 == 1)].replace("-", "+").replace("_", "/")
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _placed(run: str, found: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Places among the digits of a run as places in the run."""
    if not found:
        return
    pieces, count = [], 0  # digits before each piece, and where it stands
    for p in re.finditer(r"[^\s:]+", run):
        pieces.append((count, p.start()))
        count += len(p[0])
    for a, b in found:
        first, last = (pieces[bisect.bisect_right(pieces, (x, len(run))) - 1] for x in (a, b - 1))
        yield first[1] + a - first[0], last[1] + b - last[0]


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of signed tokens; after three parts that are none, the search goes on behind the first of them."""
    at = 0
    while m := JWT.search(text, at):
        if is_signed_token(m[1]):
            yield m.span(1)
            at = m.end()
        else:
            at = text.index(".", m.start(1))


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """Confirmed spans (kind, start, end), by start and then by kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    found += [("jwt", a, b) for a, b in tokens(text)]
    found += [("key", *m.span(1)) for m in ENCODED.finditer(text) if is_key(m[1])]
    if "-----BEGIN " in text:
        found += [("pem", *m.span()) for m in PEM.finditer(text) if is_pem(m[2])]
    taken = sorted((a, b) for kind, a, b in found if kind in ("key", "pem"))
    for a, b in embedded_keys(text):
        before = bisect.bisect_left(taken, (b, 0))  # the spans that begin before this one ends
        if not before or taken[before - 1][1] <= a:
            found.append(("key", a, b))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def is_pem(body: str) -> bool:
    """The body, without line ends (also written ones) and header lines, is a key."""
    lines = re.split(r"\s+|\\r|\\n", re.sub(r"(?m)^[A-Za-z-]+:.*$", "", body))
    data = decoded("".join(lines))
    if data is None:
        return False
    return is_der_key(data) or is_openssh_key(data) or "Proc-Type" in body and len(data) % 8 == 0


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            ids, texts = batch.column(0)[at : at + 256], batch.column(1)[at : at + 256]
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans_of(t.as_py() or "")] for t in texts]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(found, OUTPUT.field(1).type)], schema=OUTPUT)


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, found: array of (kind, start, end) for each row of docs."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _scan, "doc_id long, found array<struct<kind:string,start:long,end:long>>"
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans as text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
