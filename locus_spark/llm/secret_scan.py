"""Secret scans with structural confirmation (operator 6).

Three base patterns find assigned values, access key ids and hex runs. Beyond those, a
candidate counts only if it decodes to what it claims to be: armoured private keys and
long base64 or hex runs, also over several lines, must hold a private key whose nested lengths add up (DER or the
OpenSSH container), a dotted token needs a JSON header that names its algorithm, and a
prefixed token its checksum.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from locus_spark.llm.common import blocks, bound_batches, buffers

#: The base patterns and the fewest characters of each.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "armour", "jwt", "checked", "b64key", "hexkey")

#: A line break may also be written as an escape, as in JSON or environment files.
BREAK = r"(?:\r?\n[ \t]*|\\r\\n|\\n)"
ARMOUR = re.compile(r"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]|\\[nr])+)-----END \1-----")
DOTTED = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]*){1,3}")
CHECKED = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
RUN = re.compile(rf"(?:(?<=\\)[nrt])?([A-Za-z0-9+/_-]{{32,}}(?:{BREAK}[A-Za-z0-9+/_-]{{32,}})*(?:{BREAK}[A-Za-z0-9+/_-]+)?={{0,2}})")
HEXRUN = re.compile(rf"[0-9A-Fa-f]{{48,}}(?:{BREAK}[0-9A-Fa-f]{{48,}})*(?:{BREAK}[0-9A-Fa-f]+)?")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
OPENSSH = b"openssh-key-v1\0"
SHORTEST_RUN = 24


def der(data: bytes, at: int = 0, end: int | None = None) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER value at ``at``."""
    end = len(data) if end is None else end
    if end - at < 2:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or end < at + k:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def children(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of values that fill ``data`` exactly."""
    out, at = [], 0
    while at < len(data):
        got = der(data, at)
        if got is None:
            return None
        out.append((got[0], data[got[1] : got[2]]))
        at = got[2]
    return out


def is_private_key(data: bytes) -> bool:
    """Whether ``data`` is a private key: PKCS#1, PKCS#8, encrypted PKCS#8, SEC 1, DSA or OpenSSH."""
    if data.startswith(OPENSSH):
        at = len(OPENSSH)
        for field in range(4):  # cipher, kdf, kdf options, number of keys
            if at + 4 > len(data):
                return False
            n = int.from_bytes(data[at : at + 4], "big")
            at += 4
            if field < 3:
                at += n
        for _ in range(n + 1 if n < 16 else 99):  # public keys and the private part
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at == len(data)
    got = der(data)
    if got is None or got[0] != 0x30 or got[2] != len(data):
        return False
    parts = children(data[got[1] :])
    if not parts:
        return False
    tags = [t for t, _ in parts]
    if tags[0] == 0x02 and parts[0][1] in (b"\0", b"\1"):
        if len(tags) >= 6 and all(t == 0x02 for t in tags[:6]):  # PKCS#1 or DSA
            return len(parts[1][1]) >= 32
        if len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:  # PKCS#8
            kind = children(parts[1][1])
            return bool(kind) and kind[0][0] == 0x06
        if tags[1:2] == [0x04] and all(t in (0xA0, 0xA1) for t in tags[2:]):  # SEC 1
            return len(parts[1][1]) >= 16
    if tags == [0x30, 0x04]:  # encrypted PKCS#8
        kind = children(parts[0][1])
        return bool(kind) and kind[0][0] == 0x06 and len(parts[1][1]) % 8 == 0
    return False


def unbase64(text: str) -> bytes | None:
    """Decoded base64 of either alphabet, padded or not."""
    text = re.sub(r"\s+|\\[nr]", "", text).rstrip("=").translate(str.maketrans("-_", "+/"))
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def unhex(text: str) -> bytes | None:
    try:
        return bytes.fromhex(re.sub(r"\s+|\\[nr]", "", text))
    except ValueError:
        return None


def _holds_key(data: bytes | None) -> bool:
    if not data:
        return False
    if is_private_key(data):
        return True
    if b"PRIVATE KEY-----" in data:  # an armoured key, encoded once more
        got = ARMOUR.search(data.decode("latin-1"))
        return bool(got) and _holds_key(unbase64(got[2]))
    return False


def _is_signed_token(text: str) -> bool:
    head, body, *rest = text.split(".")
    try:
        header = json.loads(unbase64(head) or b"")
        if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
            return False
        if "enc" in header:
            return len(rest) == 3
        return len(rest) == 1 and (isinstance(json.loads(unbase64(body) or b""), dict) or "cty" in header)
    except (ValueError, RecursionError):
        return False


def _signed_length(text: str) -> int:
    """Characters of the signed token at the head of ``text``: of all its parts, or the first three; else 0."""
    return next((len(t) for t in (text, ".".join(text.split(".")[:3])) if _is_signed_token(t)), 0)


def _has_checksum(text: str) -> bool:
    n, tail = zlib.crc32(text[4:34].encode()), ""
    while n:
        n, d = divmod(n, 62)
        tail = BASE62[d] + tail
    return text[34:] == tail.rjust(6, "0")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _runs(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """Spans of runs: all lines together, all but the last, and each line."""
    for m in pattern.finditer(text):
        start, end = m.span(pattern.groups)
        lines, at = [], start
        for cut in re.finditer(BREAK, text[start:end]):
            lines.append((at, start + cut.start()))
            at = start + cut.end()
        yield start, end
        if lines:
            if len(lines) > 1:
                yield start, lines[-1][1]
            yield from [*lines, (at, end)]


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates whose structure is confirmed."""
    out = [(m.start(), 3, m.end()) for m in ARMOUR.finditer(text) if _holds_key(unbase64(m[2]))]
    out += [(m.start(), 4, m.start() + n) for m in DOTTED.finditer(text) if (n := _signed_length(m[0]))]
    out += [(m.start(), 5, m.end()) for m in CHECKED.finditer(text) if _has_checksum(m[0])]
    for kind, pattern, decode in ((6, RUN, unbase64), (7, HEXRUN, unhex)):
        taken = sorted((s, e) for s, _, e in out)
        starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        last = 0
        for s, e in _runs(text, pattern):
            before = bisect.bisect_right(starts, s)
            if s >= last and not (before and reach[before - 1] > s) and _holds_key(decode(text[s:e])):
                out.append((s, kind, e))
                last = e
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RUN = np.isin(np.arange(256), [*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"])
_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"akia", b"-----begin", b"eyj")


def suspects(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents hold a keyword, a prefix or a long enough run: all others have no span."""
    flag = np.zeros(len(offsets) - 1, bool)
    if not len(raw):
        return flag
    low, at = _LOWER[raw].tobytes(), []
    for word in _HINTS:
        p = low.find(word)
        while p >= 0:
            at.append(p)
            p = low.find(word, p + 1)
    run = np.concatenate([[False], _RUN[raw], [False]])
    edge = np.flatnonzero(run[1:] != run[:-1])
    # A run may go on into the next document: then each is looked at in full.
    long = edge[::2][edge[1::2] - edge[::2] >= SHORTEST_RUN]
    ends = edge[1::2][edge[1::2] - edge[::2] >= SHORTEST_RUN] - 1
    first, last = (np.searchsorted(offsets, x, "right") - 1 for x in (long, ends))
    for a, b in zip(first.tolist(), last.tolist()):
        flag[a : b + 1] = True
    if at:
        flag[np.searchsorted(offsets, np.array(at), "right") - 1] = True
    return flag


EMPTY = hashlib.sha256(b"").hexdigest()
REPORT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"


def _scan(keep: list[str], text_column: str, redact: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text_column):
                texts = part.column(text_column)
                n = len(texts)
                counts, digest, spans, extra = np.zeros((n, 3), np.int64), [EMPTY] * n, [""] * n, np.zeros(n, np.int64)
                changed: dict[int, str] = {}
                for k in np.flatnonzero(suspects(*buffers(texts))).tolist():
                    text = texts[k].as_py() or ""
                    base, more = base_spans(text), confirmed_spans(text)
                    for _, kind, _ in base:
                        counts[k, kind] += 1
                    if base or more:
                        digest[k] = hashlib.sha256(joined(base).encode()).hexdigest()
                        spans[k], extra[k] = joined(sorted(base + more)), len(more)
                        if redact is not None:
                            out, at = [], 0
                            for s, _, e in sorted(base + more):
                                if e > at:
                                    if s >= at:
                                        out += [text[at:s], redact]
                                    at = e
                            changed[k] = "".join([*out, text[at:]])
                if redact is None:
                    columns = [part.column(c) for c in keep]
                    columns += [pa.array(counts[:, 0]), pa.array(counts[:, 1]), pa.array(counts[:, 2]), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(extra)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(x.split()[0] for x in REPORT.split(", "))])
                else:
                    if changed:
                        own = texts.to_pylist()
                        for k, text in changed.items():
                            own[k] = text
                        texts = pa.array(own, pa.string())
                    yield pa.RecordBatch.from_arrays([texts if c == text_column else part.column(c) for c in keep], names=keep)

    return run


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Secrets in every whole text, one row per row.

    Returns id_column, n_assign, n_access, n_hex (long, base patterns), base_sha256 (hex
    sha256 of the base spans as kind:start:end, by start and then kind, joined by commas;
    code points, end exclusive), spans (all spans, joined likewise), n_confirmed (long).

    A null text is empty. Base spans and confirmed ones may overlap. Repeated rows and
    null ids are reported like any row; other columns are ignored; an empty table gives
    no rows.
    """
    bound_batches(docs)
    rows = docs.select(id_column, docs[text_column].cast("string").alias(text_column))
    return rows.mapInArrow(_scan([id_column], text_column, None), f"{_schema(rows.select(id_column))}, {REPORT}")


def redact_secrets(docs: DataFrame, text_column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of ``find_secrets`` replaced by ``mark``, overlapping ones as one.

    All rows and columns stay; a null text stays null.
    """
    bound_batches(docs)
    return docs.mapInArrow(_scan(docs.columns, text_column, mark), _schema(docs))
