"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, URL schemes and identifier cues.
Deterministic local parsers then expand each anchor to the left and right and validate what they read.
No parser searches the text, so the work per document is one automaton pass plus the length of the found spans.

Base kinds (email, ip, card, phone) follow the leftmost, non-overlapping reading of their patterns;
the added kinds are url, iban and account. Spans are in code points, the end exclusive.

Nulls and empty texts have no spans; very long texts are read whole, and an empty table gives an empty result. Other columns are left alone, whatever their names; equal rows get equal spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capwindow.llm import common

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account")
SPANS = "array<struct<kind:string,start:int,end:int>>"

DIGITS = frozenset("0123456789")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTERS = UPPER | frozenset("abcdefghijklmnopqrstuvwxyz")
LABEL = LETTERS | DIGITS | {"-"}
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
PHONE = DIGITS | frozenset(" ().-")
URL_STOP = frozenset(" \t\n\r\x0b\x0c\"'<>|{}[]\\^`")
#: Cues that announce an identifier, in lower case, upper case and capitalised.
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")
#: Words that may stand between a cue and its identifier.
FILLERS = ("number", "nummer", "no", "nr", "is")
SCHEMES = ("http://", "https://", "ftp://")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    """Length, shape and the checksum modulo 97."""
    if not 15 <= len(text) <= 34 or not (set(text[:2]) <= UPPER and set(text[2:4]) <= DIGITS and set(text) <= UPPER | DIGITS):
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def run_end(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email_at(text: str, sign: int, floor: int) -> tuple[int, int] | None:
    """The address around an at-sign whose local part starts at floor or later."""
    start = sign
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = run_end(text, sign + 1, LABEL)
    if start == sign or end == sign + 1:
        return None
    labels = 1
    while end < len(text) and text[end] == "." and (after := run_end(text, end + 1, LABEL)) > end + 1:
        labels, end = labels + 1, after
    return (start, end) if labels > 1 else None


def phone_at(text: str, plus: int) -> tuple[int, int] | None:
    """What a plus sign starts: a digit, then digits and separators up to the last digit."""
    if text[plus + 1 : plus + 2] not in DIGITS:
        return None
    end = run_end(text, plus + 2, PHONE)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return (plus, end) if end > plus + 3 and text[end - 1] in DIGITS else None


def card_at(text: str, start: int) -> tuple[int, str]:
    """The end and the digits of the run that starts here, with at most one blank or hyphen between digits."""
    end, digits = start, []
    while True:
        digits.append(text[end])
        end += 1
        if text[end : end + 1] in DIGITS:
            continue
        if text[end : end + 1] in (" ", "-") and text[end + 1 : end + 2] in DIGITS:
            end += 1
            continue
        return end, "".join(digits)


def ip_at(text: str, start: int) -> tuple[int, list[str]]:
    """The end and the parts, at most four, of the dotted numbers that start here."""
    parts, at = [], start
    while True:
        end = run_end(text, at, DIGITS)
        parts.append(text[at:end])
        if len(parts) == 4 or text[end : end + 1] != "." or text[end + 1 : end + 2] not in DIGITS:
            return end, parts
        at = end + 1


def url_at(text: str, start: int, scheme: int) -> tuple[int, int] | None:
    end = start + scheme
    while end < len(text) and text[end] not in URL_STOP:
        end += 1
    while end > start + scheme and text[end - 1] in ".,;:!?)":
        end -= 1
    host = text[start + scheme : end].split("/", 1)[0]
    return (start, end) if "." in host.strip(".") or host.startswith("localhost") else None


def identifier_after(text: str, at: int) -> tuple[str, int, int] | None:
    """An IBAN, or an account number of 8 to 15 digits, a short way after its cue, with at most three filler words between."""
    for _ in range(4):
        while at < len(text) and text[at] in " \t:=#.":
            at += 1
        if hit := identifier_at(text, at):
            return hit
        end = run_end(text, at, LETTERS)
        if end - at > 6 or text[at:end].lower() not in FILLERS or text[end : end + 1] not in (" ", "\t", ":", "=", "#", "."):
            return None
        at = end
    return None


def identifier_at(text: str, at: int) -> tuple[str, int, int] | None:
    """The IBAN or account number that starts here."""
    end, kept = at, []
    while end < len(text) and (text[end] in UPPER or text[end] in DIGITS or text[end] == " " and kept and text[end + 1 : end + 2] in UPPER | DIGITS):
        kept += text[end].strip()
        end += 1
        if iban_ok("".join(kept)) and text[end : end + 1] not in UPPER | DIGITS:
            return "iban", at, end
        if len(kept) > 34:
            break
    end = run_end(text, at, DIGITS)
    if 8 <= end - at <= 15 and text[end : end + 1] not in LETTERS:
        return "account", at, end
    return None


def automaton():
    """Values are (class of anchor, length)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for sign in "@+":
        found.add_word(sign, (sign, 1))
    for d in sorted(DIGITS):
        found.add_word(d, ("0", 1))
    for scheme in SCHEMES:
        for spelt in (scheme, scheme.upper()):
            found.add_word(spelt, ("url", len(scheme)))
    for cue in CUES:
        for spelt in (cue, cue.upper(), cue.capitalize()):
            found.add_word(spelt, ("cue", len(cue)))
    found.make_automaton()
    return found


def find(text: str, anchors) -> list[tuple[str, int, int]]:
    """All spans by kind as listed, then start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_floor = ip_floor = card_floor = phone_floor = url_floor = 0
    for last, (kind, size) in anchors.iter(text):
        at = last - size + 1
        if kind == "0":
            if at >= card_floor:
                card_floor, digits = card_at(text, at)
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append((at, card_floor))
            if at >= ip_floor:
                ip_floor, parts = ip_at(text, at)
                if len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts):
                    out["ip"].append((at, ip_floor))
        elif kind == "@":
            if hit := email_at(text, at, email_floor):
                email_floor = hit[1]
                out["email"].append(hit)
        elif kind == "+":
            if at >= phone_floor and (hit := phone_at(text, at)):
                phone_floor = hit[1]
                if 8 <= sum(c in DIGITS for c in text[hit[0] : hit[1]]) <= 15:
                    out["phone"].append(hit)
        elif kind == "url":
            if at >= url_floor and (hit := url_at(text, at, size)):
                url_floor = hit[1]
                out["url"].append(hit)
        elif not (text[at - 1 : at] in LETTERS) and (hit := identifier_after(text, last + 1)):
            if hit[1:] not in out[hit[0]]:
                out[hit[0]].append(hit[1:])
    return [(k, *span) for k in KINDS for span in sorted(out[k])]


def _texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    anchors = automaton()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        yield pa.array(
            [[dict(zip(("kind", "start", "end"), s)) for s in find(t, anchors)] if t else [] for t in batch.to_pylist()], kind
        )


def find_pii(df: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """df with the array of its texts' spans in column out, which replaces a column of that name."""
    common.small_batches(df.sparkSession)
    spans = F.arrow_udf(_texts, SPANS)
    return df.withColumn(out, spans(F.col(text_col)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *(common.count_kind(F.col("pii"), k).alias(f"n_{k}") for k in BASE_KINDS),
        common.sha_hex(common.span_text(base)).alias("base_sha256"),
        common.span_text(F.col("pii")).alias("spans"),
    )
