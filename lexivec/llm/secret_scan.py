"""Secret scans with structural confirmation.

Three base patterns (assignments, access ids, hex runs) are reported as they match. Beyond them a
candidate is reported only if its structure holds: a base64, base64url or hex run, on one line or over
several, must decode to a private key: DER whose nested lengths add up and whose fields are those of
PKCS#1, PKCS#8 (plain or encrypted), SEC1 or DSA, or OpenSSH's own form; a PEM body likewise, with escaped
line ends and headers read (of an encrypted one the headers are the structure). Certificates, signatures
and public keys are DER too, but not secret, and stay. A signed token needs a JSON header with an
algorithm. Offsets are code points of the whole text.

Defined cases: null text counts as empty and gives the hash of an empty list; a very long text is
scanned whole; an empty table gives no rows; repeated rows are scanned alike; other columns are ignored
(by the stage: passed through).
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import slices, text_of, tidy

# Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "key", "jwt")

PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*?PRIVATE KEY)-----([^-]*(?:-(?!----)[^-]*)*+)-----END \1-----")
#: Escapes of JSON and the like within a PEM body: ends of lines, and the slash.
ESCAPED_END = re.compile(r"\\+(?:[nrt]|u000[aAdD9])")
ESCAPED_SLASH = re.compile(r"\\+/")
PEM_HEADER = re.compile(r"\b(Proc-Type|DEK-Info):\s*([A-Za-z0-9-]+,[A-Za-z0-9]+)|^[ \t]*[A-Za-z][A-Za-z0-9-]*:.*$", re.M)
#: Runs of either alphabet; one may follow an escaped end of line, whose letter isn't its own.
_START = r"(?:(?<=\\[nrt])|(?<![{0}])(?!(?<=\\)[nrt]))[{0}]{{40,}}={{0,2}}"
BASE64 = re.compile(_START.format("A-Za-z0-9+/"))
BASE64_URL = re.compile(_START.format("A-Za-z0-9_-"))
#: Runs over several lines, as PEM bodies without their first and last line.
BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{60,}\r?\n)+[A-Za-z0-9+/]+={0,2}(?![A-Za-z0-9+/=])")
#: What any run of base64 or hex has; most texts have none.
LONG_RUN = re.compile(r"[A-Za-z0-9+/_-]{40}")
HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{40,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{5,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{8,})")

# Fixed values of DER and of the key formats: tags, counts of numbers after the version, and how the
# object identifiers of password-based encryption (PKCS#5, PKCS#12) begin.
INTEGER, OCTETS, OBJECT_ID, SEQUENCE, CONSTRUCTED = 0x02, 0x04, 0x06, 0x30, 0x20
RSA_NUMBERS, DSA_NUMBERS = 8, 5
PASSWORD_ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))

Span = tuple[int, int, str]


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """(content start, content length) of the element at ``at``, if its header is well formed."""
    if at + 2 > len(data):
        return None
    first = data[at + 1]
    if first < 0x80:
        return at + 2, first
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 2 + n > len(data):
        return None
    length = int.from_bytes(data[at + 2 : at + 2 + n], "big")
    if length < 0x80 or (n > 1 and data[at + 2] == 0):
        return None
    return at + 2 + n, length


def der_elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end of the content) of the elements that exactly fill ``data[at:end]``; None if they don't."""
    found = []
    while at < end:
        head = der_length(data, at)
        if head is None or sum(head) > end:
            return None
        found.append((data[at], head[0], sum(head)))
        at = sum(head)
    return found


def der_fields(data: bytes) -> list[tuple[int, int, int]] | None:
    """The fields of a SEQUENCE that is the whole data, if the lengths add up at every depth."""
    top = der_elements(data, 0, len(data))
    if top is None or len(top) != 1 or top[0][0] != SEQUENCE:
        return None
    work = [fields := der_elements(data, *top[0][1:])]
    while work:
        level = work.pop()
        if level is None:
            return None
        work += [der_elements(data, start, end) for tag, start, end in level if tag & CONSTRUCTED]
    return fields


def is_der_key(data: bytes) -> bool:
    """Whether the data is a private key in one of the forms that have fields of their own."""
    if len(data) < 16 or data[0] != SEQUENCE or (fields := der_fields(data)) is None or len(fields) < 2:
        return False
    tags = [tag for tag, _, _ in fields]
    value = data[fields[0][1] : fields[0][2]]
    if tags[0] == INTEGER and len(value) == 1:
        version, rest = value[0], tags[1:]
        if set(rest) == {INTEGER}:
            return version == 0 and len(rest) in (RSA_NUMBERS, DSA_NUMBERS)
        if rest[:RSA_NUMBERS] == [INTEGER] * RSA_NUMBERS:
            return version == 1 and rest[RSA_NUMBERS:] == [SEQUENCE]
        if rest[0] == OCTETS:  # SEC1: curve and public point may follow
            return version == 1 and fields[1][2] > fields[1][1] and rest[1:] in ([], [0xA0], [0xA1], [0xA0, 0xA1])
        if rest[:2] == [SEQUENCE, OCTETS]:  # PKCS#8: attributes and public key may follow
            return version in (0, 1) and bool(_algorithm(data, fields[1])) and set(rest[2:]) <= {0xA0, 0xA1, 0x81}
    return tags == [SEQUENCE, OCTETS] and _algorithm(data, fields[0]).startswith(PASSWORD_ENCRYPTION)


def _algorithm(data: bytes, field: tuple[int, int, int]) -> bytes:
    """The object identifier that an algorithm sequence begins with; empty if it doesn't."""
    inner = der_elements(data, *field[1:]) or [(0, 0, 0)]
    return data[inner[0][1] : inner[0][2]] if inner[0][0] == OBJECT_ID else b""


def is_openssh_key(data: bytes) -> bool:
    """An OpenSSH private key: after its magic, length-prefixed strings."""
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return False
    # cipher, its key derivation and the options of that; what follows is for the cipher to say
    fields, _ = _prefixed(data[len(magic) :], 3)
    return len(fields) == 3 and re.fullmatch(rb"[\x21-\x7e]+", fields[0]) is not None


def _prefixed(data: bytes, most: int | None = None) -> tuple[list[bytes], int]:
    """The length-prefixed strings at the start of the data, and where they end."""
    fields, at = [], 0
    while at + 4 <= len(data) and (most is None or len(fields) < most):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            break
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return fields, at


def decoded(text: str, url_safe: bool = False) -> bytes | None:
    body = re.sub(r"\s+", "", text).rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if url_safe else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_key(data: bytes | None) -> bool:
    return data is not None and (is_der_key(data) or is_openssh_key(data))


def is_pem_key(body: str) -> bool:
    """Whether a PEM body, its headers aside, is a key, or ciphertext by what its headers say."""
    body = ESCAPED_SLASH.sub("/", ESCAPED_END.sub("\n", body))
    headers = dict(PEM_HEADER.findall(body))
    data = decoded(PEM_HEADER.sub("", body), url_safe=True)
    if "ENCRYPTED" in headers.get("Proc-Type", "") and "DEK-Info" in headers:
        return data is not None and len(data) >= 16
    return is_key(data)


def is_token_header(part: str) -> bool:
    try:
        header = json.loads(decoded(part, url_safe=True) or b"")
    except ValueError:
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def base_spans(text: str) -> list[Span]:
    """The contract's base matches, by kind."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def confirmed_spans(text: str) -> list[Span]:
    """Candidates whose structure holds."""
    found: list[Span] = []
    if "PRIVATE KEY-----" in text:
        found += [(m.start(), m.end(), "key") for m in PEM.finditer(text) if is_pem_key(m[2])]
    if "eyJ" in text:
        found += [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if is_token_header(m[1])]
    if LONG_RUN.search(text):
        for pattern, url_safe in ((BASE64_LINES, False), (BASE64, False), (BASE64_URL, True)):
            taken = sorted((a, b) for a, b, _ in found)
            starts = [a for a, _ in taken]
            for m in pattern.finditer(text):
                at = bisect.bisect_right(starts, m.start()) - 1
                if (at < 0 or taken[at][1] <= m.start()) and is_key(decoded(m[0], url_safe)):
                    found.append((m.start(), m.end(), "key"))
        for m in HEX_RUN.finditer(text):
            if len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0])):
                found.append((m.start(), m.end(), "key"))
    return found


def ordered(spans: list[Span]) -> str:
    spans = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(text: str | None) -> tuple[int, int, int, str, str, int]:
    text = text or ""
    base, more = base_spans(text), confirmed_spans(text)
    n = {k: sum(s[2] == k for s in base) for k in KINDS}
    digest = hashlib.sha256(ordered(base).encode()).hexdigest()
    return n["assign"], n["access"], n["hex"], digest, ordered(base + more), len(more)


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"


@tidy
def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (x for whole in batches for x in slices(whole)):
        rows = [scan(t.as_py()) for t in batch.column("text")]
        columns = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        names = [f.split()[0] for f in RESULT.split(", ")]
        arrays = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds))]
        yield pa.RecordBatch.from_arrays(arrays, names)


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts, the digest of the base spans and every span."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return own.mapInArrow(_scan_batches, RESULT)


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind; overlapping spans become one."""
    if not text:
        return text
    spans = sorted(base_spans(text) + confirmed_spans(text))
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        out += [text[at:start], f"[{kind}]"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def redact_stage(docs: DataFrame) -> DataFrame:
    """The documents with their secrets taken out and n_chars to match; no document goes."""
    names, schema = docs.columns, docs.schema

    @tidy
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in parts for x in slices(whole)):
            text = pa.array([redact(t.as_py()) for t in batch.column("text")], pa.string())
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, pa.field("text", pa.string()), text)

    out = docs.mapInArrow(batches, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*names)
