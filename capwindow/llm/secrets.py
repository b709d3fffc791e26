"""Secrets, confirmed by their structure.

Base kinds (assign, access, hex) are the matches of their patterns. Beyond these, candidates in base64 or hex
are decoded and reported only if their bytes parse as a key encoding whose nested lengths add up
(kinds der and pem), or as a signed token whose header names an algorithm (kind jwt). Key encodings are those of RSA, DSA and EC keys,
PKCS#8 with and without a password, public keys, and openssh-key-v1. Hex is read in either case. Base64 may be wrapped in lines or hold
escaped line breaks, as in JSON; without PEM marks the key's own lengths tell where it ends.

Nulls and empty texts have no spans; very long texts are read whole, and an empty table gives an empty result. Spans are in code points, the end exclusive, ordered by start, then kind as listed.
Other columns are left alone, whatever their names; equal rows get equal spans.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capwindow.llm import common

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem", "der")
SPANS = "array<struct<kind:string,start:int,end:int>>"

ASSIGN = r"((?:(?ai:password|passwd|secret|token|api_?key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
#: The longest runs of hex digits; shorter ones would be dropped after the match.
HEX = r"[0-9a-f]{24,}"
JWT = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{16,}"
PEM = r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]|\\+[nrt/])+?)-----END \1-----"
ENCODED = r"[A-Za-z0-9+/_-]{48,}={0,2}"
#: Hex in either case, of keys.
ANY_HEX = r"[0-9A-Fa-f]{64,}"
#: Where base64 of a sequence or of openssh-key-v1 may start, at a word's or a line's start, and lines of base64 from there.
WRAPPED_START = r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n)|(?<=\\r)|(?<=\\t))(?:M[A-I]|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/_-]{10}"
WRAPPED = r"(?:[A-Za-z0-9+/_-]|\\+/)+(?:[\x20\t]*(?:\r?\n|\r|(?:\\+[nrt])+)[\x20\t]*(?:[A-Za-z0-9+/_-]|\\+/)+)*={0,2}"
#: What stands between the characters of base64.
BREAKS = r"\\+(?:[nrt]|(?=/))|\s+"
#: Password-based encryption, by PKCS#5 and PKCS#12: the first bytes of the object identifiers.
PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
OPENSSH = b"openssh-key-v1\0"
LEAST = {"assign": 6, "access": 20, "hex": 24}


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """The length of an element's content and where that starts; None unless minimally encoded and inside data."""
    if at + 2 > len(data):
        return None
    first = data[at + 1]
    if first < 0x80:
        size, start = first, at + 2
    else:
        n = first & 0x7F
        if not 1 <= n <= 4 or at + 2 + n > len(data):
            return None
        size, start = int.from_bytes(data[at + 2 : at + 2 + n], "big"), at + 2 + n
        if size < 0x80 or size >> (8 * (n - 1)) == 0:
            return None
    return (size, start) if start + size <= len(data) else None


def der_children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of the elements that exactly fill data[start:end]."""
    out = []
    while start < end:
        head = der_length(data, start)
        if not head or head[1] + head[0] > end:
            return None
        out.append((data[start], head[1], head[1] + head[0]))
        start = head[1] + head[0]
    return out


def openssh_size(data: bytes) -> int | None:
    """Bytes of the openssh-key-v1 at the start of data: cipher, key derivation, its options, public keys and the private part."""
    if not data.startswith(OPENSSH):
        return None
    at, left, found = len(OPENSSH), 3, []
    while left:
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        found.append(data[at + 4 : at + 4 + size])
        at, left = at + 4 + size, left - 1
        if len(found) == 3:
            left = int.from_bytes(data[at : at + 4], "big") + 1  # and the private part
            at += 4
            if not 2 <= left <= 64:
                return None
    return at if found[0] and found[1] and all(found[3:]) else None


def is_key(data: bytes) -> bool:
    """A sequence that fills data and holds a version and key numbers, or an algorithm identifier and a key; or an openssh-key-v1."""
    if data.startswith(OPENSSH):
        return openssh_size(data) == len(data)
    if len(data) < 32 or data[0] != 0x30:
        return False
    top = der_children(data, 0, len(data))
    if not top or len(top) != 1:
        return False
    inner = der_children(data, top[0][1], top[0][2])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _, _ in inner]
    if tags[0] == 0x02 and len(inner) >= 8 and set(tags) == {0x02}:  # numbers of a private key
        return True
    if tags == [0x02] * 6 and data[inner[0][1] : inner[0][2]] == b"\0":  # numbers of a DSA key
        return True
    if tags == [0x30, 0x04]:  # an encrypted private key; digests have this form, too, with other algorithms
        algorithm = der_children(data, inner[0][1], inner[0][2])
        return bool(algorithm) and algorithm[0][0] == 0x06 and data[algorithm[0][1] : algorithm[0][2]].startswith(PBE) and inner[1][1] < inner[1][2]
    if tags[0] == 0x02 and 0x04 in tags[1:3]:  # a private key in an octet string
        return all(der_children(data, s, e) for t, s, e in inner if t == 0x30)
    if tags == [0x30, 0x03]:  # algorithm and public key bits
        algorithm = der_children(data, inner[0][1], inner[0][2])
        return bool(algorithm) and algorithm[0][0] == 0x06
    if set(tags) == {0x02} and len(inner) == 2:  # modulus and exponent
        return inner[0][2] - inner[0][1] >= 64
    return False


def from_base64(text: str) -> bytes | None:
    body = re.sub(BREAKS, "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def wrapped_key(text: str, start: int, by: dict[str, re.Pattern]) -> int | None:
    """The end of a key in lines of base64 that starts here; lines after it don't matter."""
    body = by["wrapped"].match(text, start)
    if not body:
        return None
    head = from_base64(re.sub(BREAKS, "", body[0][:80])[:8]) or b""
    if head[:1] == b"\x30":
        n = head[1] & 0x7F if head[1] >= 0x80 else 0
        if n > 3:
            return None
        size = 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])
    else:
        joined = re.sub(BREAKS, "", body[0]).rstrip("=")
        size = openssh_size(from_base64(joined[: len(joined) // 4 * 4]) or b"")
        if size is None:  # the last characters may be the key's or those of the next line
            size = openssh_size(from_base64(joined) or b"")
    left = -(-(size or 0) * 4 // 3)
    if not left or left > len(body[0]):
        return None
    for piece in by["piece"].finditer(text, start, body.end()):
        if left <= len(piece[1] or ""):
            break
        left -= len(piece[1] or "")
    else:
        return None
    end = piece.start() + left
    if left < len(piece[1]) or end < body.end() and by["joint"].match(text, end):
        return None  # the line goes on
    end = by["padding"].match(text, end).end()
    return end if is_key(from_base64(text[start:end]) or b"") else None


def is_token(text: str) -> bool:
    """Three parts, the first of which decodes to a JSON object that names an algorithm."""
    head, body, _ = text.split(".", 2)
    for part, needs in ((head, "alg"), (body, None)):
        try:
            parsed = json.loads(from_base64(part) or b"")
        except (ValueError, UnicodeDecodeError, RecursionError):
            return False
        if not isinstance(parsed, dict) or needs and not isinstance(parsed.get(needs), str):
            return False
    return True


def patterns() -> dict[str, re.Pattern]:
    return {k: re.compile(p) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("jwt", JWT), ("pem", PEM), ("encoded", ENCODED), ("any_hex", ANY_HEX), ("wrapped_start", WRAPPED_START), ("wrapped", WRAPPED), ("piece", r"(?:\\+[nrt])+|([A-Za-z0-9+/_-]+)"), ("joint", r"\\+/"), ("padding", "={0,2}"))}


def find(text: str, by: dict[str, re.Pattern]) -> list[tuple[str, int, int]]:
    out: set[tuple[int, int, int]] = set()
    low = text.lower()
    if any(cue in low for cue in ("passw", "secret", "token", "key")):
        out |= {(m.start(), 0, m.end()) for m in by["assign"].finditer(text) if len(m[2]) >= LEAST["assign"]}
    if "AKIA" in text:
        out |= {(m.start(), 1, m.end()) for m in by["access"].finditer(text) if m.end() - m.start() >= LEAST["access"]}
    for m in by["hex"].finditer(text):
        out.add((m.start(), 2, m.end()))
        if len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0])):
            out.add((m.start(), KINDS.index("der"), m.end()))
    for m in by["any_hex"].finditer(text):
        if len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0])):
            out.add((m.start(), KINDS.index("der"), m.end()))
    if "." in text:
        out |= {(m.start(), KINDS.index("jwt"), m.end()) for m in by["jwt"].finditer(text) if is_token(m[0])}
    if "-----BEGIN" in text:
        out |= {(m.start(), KINDS.index("pem"), m.end()) for m in by["pem"].finditer(text) if is_key(from_base64(m[2]) or b"")}
    for m in by["encoded"].finditer(text):
        if is_key(from_base64(m[0]) or b""):
            out.add((m.start(), KINDS.index("der"), m.end()))
    pems = [(start, end) for start, k, end in out if KINDS[k] == "pem"]
    at = 0
    for m in by["wrapped_start"].finditer(text):
        if m.start() >= at and not any(a <= m.start() < b for a, b in pems) and (end := wrapped_key(text, m.start(), by)):
            out.add((m.start(), KINDS.index("der"), end))
            at = end
    return [(KINDS[k], start, end) for start, k, end in sorted(out)]


def _texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    by = patterns()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        yield pa.array(
            [[dict(zip(("kind", "start", "end"), s)) for s in find(t, by)] if t else [] for t in batch.to_pylist()], kind
        )


def find_secrets(df: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """df with the array of its texts' spans in column out, which replaces a column of that name."""
    common.small_batches(df.sparkSession)
    spans = F.arrow_udf(_texts, SPANS)
    return df.withColumn(out, spans(F.col(text_col)))


def mask(text: str | None, mark: str, by: dict[str, re.Pattern]) -> str | None:
    """The text with each stretch of overlapping spans replaced by mark."""
    if not text:
        return text
    parts, at = [], 0
    for _, start, end in find(text, by):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join(parts) + text[at:] if parts else text


def mask_secrets(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with the secrets in its texts masked; nulls stay null."""
    common.small_batches(df.sparkSession)

    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        by = patterns()
        for batch in batches:
            yield pa.array([mask(t, mark, by) for t in batch.to_pylist()], pa.string())

    return df.withColumn(text_col, F.arrow_udf(masked, "string")(F.col(text_col)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *(common.count_kind(F.col("secrets"), k).alias(f"n_{k}") for k in BASE_KINDS),
        common.sha_hex(common.span_text(base)).alias("base_sha256"),
        common.span_text(F.col("secrets")).alias("spans"),
    )
