"""Secret scans: keyword automaton, anchored expressions at its hits, embedded checks.

An Aho-Corasick automaton over all keywords reads each whole text once; the
expression of a keyword's kind is tried only where the keyword begins. Long
hexadecimal runs have no keyword: byte classes of a whole batch find the texts
that can hold one. Kinds with an embedded check keep a match only if it holds:
the CRC32 at the end of repository and package tokens, the JSON header of web
tokens.

Base kinds are assign, access and hex; their matches are found leftmost and
without overlap within the kind, and one that fails its condition is dropped but
still uses up its span. Positions are code points, end exclusive. Null and empty
texts give no span. Repeated rows give a row each; an empty table gives none.
"""

from __future__ import annotations

import base64
import binascii
import functools
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from curbspark.llm.common import table

#: Kinds in the order in which spans that start alike are listed.
KINDS = ("assign", "access", "hex", "repo_token", "package_token", "web_token", "chat_token", "cloud_key", "private_key")
BASE = KINDS[:3]
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
#: Rows whose bytes are classified at a time.
ROWS = 256

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _crc_tail(token: str) -> bool:
    """The last six characters are the CRC32 of the random part, in base 62."""
    body = token[token.index("_") + 1 :]
    value, digits = zlib.crc32(body[:-6].encode()), ""
    for _ in range(6):
        value, rest = divmod(value, 62)
        digits = _BASE62[rest] + digits
    return digits == body[-6:]


def _json_head(token: str) -> bool:
    head = token.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (binascii.Error, ValueError, TypeError):
        return False


_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_HEX = re.compile(r"[0-9a-f]+")
_WEB_RUN = re.compile(r"[A-Za-z0-9_-]*")
#: Kind -> its keywords in lower case, the expression anchored at them, the condition on a match.
_RULES = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), _ASSIGN, lambda m: len(m[2]) >= MIN_VALUE),
    "access": (("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= MIN_ACCESS),
    "repo_token": (
        ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
        re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
        lambda m: _crc_tail(m[0]),
    ),
    "package_token": (("npm_",), re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: _crc_tail(m[0])),
    "web_token": (
        ("eyj",),
        re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
        lambda m: _json_head(m[0]),
    ),
    "chat_token": (("xox",), re.compile(r"xox[abprs]-[0-9]{8,}-[A-Za-z0-9-]{16,}"), lambda m: True),
    "cloud_key": (("aiza",), re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"), lambda m: True),
    "private_key": (
        ("-----begin",),
        re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s\\]{32,}-----END (?:[A-Z]+ )?PRIVATE KEY-----"),
        lambda m: True,
    ),
}


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, (words, _, _) in _RULES.items():
        for word in words:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def spans_of(text: str, may_hold_hex: bool = True) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of every secret, in order."""
    # Lower case of ASCII letters only, so that positions stay.
    lowered = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits = sorted((end - size + 1, kind) for end, (kind, size) in _automaton().iter(lowered))
    used: dict[str, int] = {}
    out = []
    for start, kind in hits:
        if start < used.get(kind, 0):
            continue
        _, expression, holds = _RULES[kind]
        if m := expression.match(text, start):
            used[kind] = m.end()
            if holds(m):
                out.append((start, KINDS.index(kind), m.end()))
        elif kind == "web_token" and text.startswith("eyJ", start):
            # What is missing stands behind the run, so no later place in the run matches either.
            used[kind] = _WEB_RUN.match(text, start).end()
    if may_hold_hex:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if len(m[0]) >= MIN_HEX]
    return sorted(out)


def _with_hex_run(texts: pa.Array) -> np.ndarray:
    """Which texts have MIN_HEX hexadecimal bytes in a row; may also name neighbours of such a text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    first, last = int(offsets[0]), int(offsets[-1])
    out = np.zeros(len(texts), bool)
    if last - first >= MIN_HEX:
        data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last]
        table_ = np.zeros(256, bool)
        table_[list(b"0123456789abcdef")] = True
        breaks = np.flatnonzero(~table_[data])
        edges = np.concatenate(([-1], breaks, [len(data)]))
        runs = np.flatnonzero(np.diff(edges) > MIN_HEX)
        out[np.searchsorted(offsets - first, edges[runs] + 1, "right") - 1] = True
        # A run that crosses a border begins in an earlier text.
        ends = np.searchsorted(offsets - first, edges[runs + 1] - 1, "right") - 1
        for begin, end in zip(np.searchsorted(offsets - first, edges[runs] + 1, "right") - 1, ends, strict=True):
            out[begin : end + 1] = True
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    written = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
    for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
        texts = batch.column("text").cast(pa.string()).fill_null("")
        counts, digests, listed = [], [], []
        for text, hexed in zip(texts, _with_hex_run(texts), strict=True):
            spans = spans_of(text.as_py(), hexed)
            base = [x for x in spans if x[1] < len(BASE)]
            counts.append([sum(x[1] == k for x in base) for k in range(len(BASE))])
            digests.append(hashlib.sha256(written(base).encode()).hexdigest())
            listed.append(written(spans))
        columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(BASE))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *columns, pa.array(digests, pa.string()), pa.array(listed, pa.string())],
            ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
        )


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    columns = ", ".join(f"n_{k} long" for k in BASE)
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id long, {columns}, base_sha256 string, spans string")


def op9_secret_scans(spark, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
