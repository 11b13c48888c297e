"""Secret scans with structural confirmation.

Three plain patterns give the base spans.  Beyond them, runs that could hold encoded keys are decoded and
reported only if their structure holds: private keys in DER (nested lengths must fill each other exactly),
OpenSSH keys (magic and length-prefixed fields), PEM blocks around either, and signed tokens whose header
and payload decode to JSON objects with an algorithm.

Null and empty texts have no spans.  Repeated rows give repeated results.  ``redact`` keeps every row and
every other column.
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

from .common import per_text, texts, whole_text

# The base patterns, the least lengths, the magic words of key formats.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
OPENSSH = b"openssh-key-v1\x00"
#: The identifiers of encryption by password all begin so.
BY_PASSWORD = bytes([0x2A, 0x86, 0x48, 0x86, 0xF7, 0x0D, 0x01, 0x05])
#: More elements or public keys than any key has.
MOST_ELEMENTS, MOST_KEYS = 64, 1000
#: The order of kinds that start at the same character.
KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "ssh")

# A run of at least 20 characters that keys and tokens are written in; no other kind than assign lacks it.
LONG = re.compile(r"[A-Za-z0-9+/_-]{20}")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[^-]|-(?!----))*)-----END \1-----")
# Any three parts in the alphabet of tokens; the shortest header has 14 characters.  Parts may overlap with
# those of a name before them, so nothing is consumed.  An escaped line break may stand before a candidate.
TRIPLE = re.compile(
    r"(?:(?<![A-Za-z0-9_-])|(?<=\\[nrt]))(?=([A-Za-z0-9_-]{14,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*))"
)
BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[Mb][A-Za-z0-9+/]{39,}={0,2}")
# The start of base64 that may run over line breaks, real or escaped ones; its structure tells the end.
WRAPPED = re.compile(r"(?:(?<![A-Za-z0-9+/])|(?<=\\[nrt]))(?=M[A-Za-z0-9+/]{15}|b3BlbnNzaC1rZXktdjEA)")
RUN = re.compile(r"[A-Za-z0-9+/]+")
BREAK = re.compile(r"(?:[ \t]*(?:\\+[nrt]|[\r\n]))+[ \t]*")
SECTION = re.compile(f"{RUN.pattern}(?:{BREAK.pattern}{RUN.pattern})*")
# Base64 in the alphabet for addresses, with one of its own two characters.
URL64 = re.compile(r"(?<![A-Za-z0-9_-])[Mb](?=[A-Za-z0-9]*[_-])[A-Za-z0-9_-]{39,}={0,2}")
PADDING = re.compile(r"(?:(?:[ \t]*(?:\\+[nrt]|[\r\n]))*[ \t]*={1,2})?(?![A-Za-z0-9+/])")
HEX_DER = re.compile(r"(?<![0-9a-fA-F])30[0-9a-fA-F]{62,}")

Span = tuple[int, int, int]  # start, place of the kind, end


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(word in low for word in WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_VALUE:
                found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST_ACCESS:
                found.append((m.start(), 1, m.end()))
    if LONG.search(text):
        found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def confirmed_spans(text: str) -> list[Span]:
    """Spans whose decoded content has the structure of a key or of a signed token."""
    found: list[Span] = []
    if "-----BEGIN " in text:
        found += [(m.start(), 3, m.end()) for m in PEM.finditer(text) if is_pem_body(m[2])]
    found += [(m.start(), 4, m.end(3)) for m in TRIPLE.finditer(text) if is_token(m[1], m[2])]
    found += wrapped_spans(text)
    if not LONG.search(text):
        return found
    for m in BASE64.finditer(text):
        kind = key_kind(decoded(m[0]))
        if kind:
            found.append((m.start(), KINDS.index(kind), m.end()))
    for m in URL64.finditer(text):
        kind = key_kind(decoded(m[0], url=True))
        if kind:
            found.append((m.start(), KINDS.index(kind), m.end()))
    for m in HEX_DER.finditer(text):
        if len(m[0]) % 2 == 0 and key_kind(bytes.fromhex(m[0])) == "der":
            found.append((m.start(), KINDS.index("der"), m.end()))
    return found


class Section:
    """Base64 over one or several lines: its characters without the breaks, and where each line begins."""

    def __init__(self, text: str, start: int, end: int):
        self.places, self.offsets, n = [], [], 0
        kept, at = [], start
        while run := RUN.match(text, at, end):
            self.places.append(at)
            self.offsets.append(n)
            kept.append(run[0])
            n += len(run[0])
            gap = BREAK.match(text, run.end(), end)
            if not gap:
                break
            at = gap.end()
        self.start, self.end, self.body = start, end, "".join(kept)

    def offset(self, place: int) -> int:
        k = bisect.bisect_right(self.places, place) - 1
        return self.offsets[k] + place - self.places[k]

    def place(self, offset: int) -> int:
        k = bisect.bisect_right(self.offsets, offset) - 1
        return self.places[k] + offset - self.offsets[k]

    def bytes_at(self, offset: int, first: int, n: int) -> bytes:
        """Up to ``n`` bytes of what is written from ``offset`` on, beginning with byte ``first``."""
        quantum = first // 3
        end = -(-(first + n) // 3)
        return decoded(self.body[offset + 4 * quantum : offset + 4 * end])[first - 3 * quantum :][:n]


def wrapped_spans(text: str) -> list[Span]:
    """Keys in base64 that may run over several lines.  The lengths in a key tell where it ends, so words
    on the next lines are not taken for a part of it.

    Every section is joined once; a candidate reads the few bytes that hold lengths, and only one whose
    lengths fill each other is decoded.
    """
    found: list[Span] = []
    section, sections = None, None
    for m in WRAPPED.finditer(text):
        at = m.start()
        if sections is None:
            sections = SECTION.finditer(text)
        while section is None or section.end <= at:
            span = next(sections)
            if span.end() > at:
                section = Section(text, span.start(), span.end())
        offset = section.offset(at)
        size = der_extent(section, offset) if text[at] == "M" else ssh_extent(section, offset)
        need = -(-size * 4 // 3)
        if not size or need > len(section.body) - offset:
            continue
        closed = PADDING.match(text, section.place(offset + need - 1) + 1)
        kind = key_kind(decoded(section.body[offset : offset + need])) if closed else None
        if kind:
            found.append((at, KINDS.index(kind), closed.end()))
    return found


def der_extent(section: Section, offset: int) -> int:
    """The bytes of a DER sequence with few elements that fill it exactly; 0 if there is none."""
    size = der_size(section.bytes_at(offset, 0, 6))
    if not size or size * 4 > 3 * (len(section.body) - offset) + 8:
        return 0
    head = section.bytes_at(offset, 1, 1)[0]
    at = 2 + (head & 0x7F if head >= 0x80 else 0)
    for _ in range(MOST_ELEMENTS):
        own = section.bytes_at(offset, at, 6)
        if len(own) < 2 or (own[1] >= 0x80 and not 1 <= own[1] & 0x7F <= min(4, len(own) - 2)):
            return 0
        wide = own[1] & 0x7F if own[1] >= 0x80 else 0
        at += 2 + wide + (int.from_bytes(own[2 : 2 + wide], "big") if wide else own[1])
        if at >= size:
            return size if at == size else 0
    return 0


def ssh_extent(section: Section, offset: int) -> int:
    """The bytes of an OpenSSH key up to the end of its private part; 0 if they are not all there."""
    there = (len(section.body) - offset) // 4 * 3
    at = len(OPENSSH)
    if section.bytes_at(offset, 0, at) != OPENSSH:
        return 0

    def number() -> int | None:
        own = section.bytes_at(offset, at, 4) if at + 4 <= there else b""
        return int.from_bytes(own, "big") if len(own) == 4 else None

    left = 3  # cipher, derivation and options
    while left:
        size = number()
        if size is None:
            return 0
        at, left = at + 4 + size, left - 1
    keys = number()
    if keys is None or not 1 <= keys <= MOST_KEYS:
        return 0
    at += 4
    for _ in range(keys + 1):  # the public keys, and the private part
        size = number()
        if size is None:
            return 0
        at += 4 + size
    # Up to two bytes of the last quantum may have been cut off.
    return at if at <= there + 2 else 0


def der_size(head: bytes) -> int:
    """The bytes of a DER sequence with its own tag and length; 0 if it is none."""
    if len(head) < 6 or head[0] != SEQUENCE:
        return 0
    if head[1] < 0x80:
        return 2 + head[1]
    n = head[1] & 0x7F
    return 2 + n + int.from_bytes(head[2 : 2 + n], "big") if 1 <= n <= 4 else 0


def decoded(written: str, url: bool = False) -> bytes:
    """Base64 of either alphabet with or without padding; nothing if it does not decode."""
    body = written.rstrip("=")
    body += "=" * (-len(body) % 4)
    try:
        return base64.b64decode(body, b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return b""


def is_token(header: str, payload: str) -> bool:
    parts = []
    for written in (header, payload):
        try:
            parts.append(json.loads(decoded(written, url=True)))
        except (ValueError, RecursionError):
            return False
    return all(isinstance(p, dict) for p in parts) and isinstance(parts[0].get("alg"), str)


def is_pem_body(body: str) -> bool:
    """A key in base64, perhaps after header lines such as those of an encrypted key.

    Escaped line breaks, as in JSON and in source strings, are line breaks.
    """
    body = re.sub(r"\\+[nrt]?", "\n", re.sub(r"\\+/", "/", body))
    lines = [line.strip() for line in body.splitlines()]
    encrypted = any(line.startswith("Proc-Type:") for line in lines)
    raw = decoded("".join(line for line in lines if ":" not in line))
    return bool(raw) and (encrypted or key_kind(raw) is not None or is_encrypted_der(raw))


def elements(raw: bytes) -> list[tuple[int, bytes]] | None:
    """The DER elements that fill ``raw`` exactly, as (tag, content); None if they don't."""
    out, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw):
            return None
        tag, size = raw[at], raw[at + 1]
        at += 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(raw):
                return None
            size = int.from_bytes(raw[at : at + n], "big")
            at += n
        if at + size > len(raw):
            return None
        out.append((tag, raw[at : at + size]))
        at += size
    return out


INTEGER, OCTETS, OBJECT_ID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def _sequence(raw: bytes) -> list[tuple[int, bytes]] | None:
    outer = elements(raw)
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return None
    return elements(outer[0][1])


def is_encrypted_der(raw: bytes) -> bool:
    """A wrapped key: an algorithm, then octets."""
    inner = _sequence(raw)
    return bool(inner) and [t for t, _ in inner] == [SEQUENCE, OCTETS] and _names_algorithm(inner[0][1])


def _names_algorithm(content: bytes) -> bool:
    inner = elements(content)
    return bool(inner) and inner[0][0] == OBJECT_ID


def key_kind(raw: bytes) -> str | None:
    """``der`` or ``ssh`` if the bytes are a whole private key, else None."""
    if raw.startswith(OPENSSH):
        return "ssh" if _fields(raw[len(OPENSSH) :]) else None
    inner = _sequence(raw)
    if not inner or len(inner) < 2:
        return None
    if inner[0][0] != INTEGER:
        # Without a frame around it, an encrypted key must name an encryption by password.
        algorithm = elements(inner[0][1]) if is_encrypted_der(raw) else None
        return "der" if algorithm and algorithm[0][1].startswith(BY_PASSWORD) else None
    tags = [t for t, _ in inner]
    plain = tags[1] == OCTETS and inner[0][1] == b"\x01"  # version 1, then the key
    numbers = len(tags) >= 6 and all(t == INTEGER for t in tags[:6])  # moduli, exponents, primes
    wrapped = len(tags) >= 3 and tags[1:3] == [SEQUENCE, OCTETS] and _names_algorithm(inner[1][1])
    return "der" if plain or numbers or wrapped else None


def _fields(raw: bytes) -> bool:
    """Cipher, derivation and options as length-prefixed fields, then a count of keys."""
    at = 0
    for _ in range(3):
        if at + 4 > len(raw):
            return False
        at += 4 + int.from_bytes(raw[at : at + 4], "big")
    return at + 4 <= len(raw) and 1 <= int.from_bytes(raw[at : at + 4], "big") <= MOST_KEYS


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    return base, sorted(set(base) | set(confirmed_spans(text)))


def joined(found: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as kind:start:end."""

    def rows(doc_ids: list, batch: list[str]) -> dict[str, list]:
        found = [spans(text) for text in batch]
        counts = [[kind for _, kind, _ in base] for base, _ in found]
        return {
            "doc_id": doc_ids,
            "n_assign": [kinds.count(0) for kinds in counts],
            "n_access": [kinds.count(1) for kinds in counts],
            "n_hex": [kinds.count(2) for kinds in counts],
            "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found],
            "spans": [joined(every) for _, every in found],
            "n_confirmed": [sum(kind > 2 for _, kind, _ in every) for _, every in found],
        }

    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
        "n_confirmed long"
    )
    return per_text(texts(docs), schema, rows)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by a mark."""
    out, at = [], 0
    for start, _, end in spans(text)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns, secrets in ``text`` replaced, ``n_chars`` (if any) counted anew."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            new = [None if t is None else redacted(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    at = docs.columns.index("text")
    done = docs.mapInArrow(batches, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.length(whole_text(F.col("text"))).cast(kind))
    return done
