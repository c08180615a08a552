"""Secret scan: Aho-Corasick prefilter, anchored expressions near hits, checks inside the match.

One automaton pass over the ASCII-lower-cased text finds keywords; only at such a
hit an anchored expression is tried.  Runs of hex digits have no keyword: for them
every hex digit is mapped to one symbol, an automaton finds 32 of it in a row, and
the expression is anchored there.  Matches of some kinds hold a check of their own (a CRC-32 in base 62, a decodable header),
which must hold.

Base kinds are ``assign``, ``access`` and ``hex``; the rest are added by the
method.  Letters are ASCII only.  Within a kind, matches are leftmost and do not
overlap, and a match that fails its test still uses up its characters.

Defined results: null and empty texts have no secrets; texts are scanned whole,
in linear time; repeated rows get equal results; extra columns pass through.
"""

from __future__ import annotations

import base64
import binascii
import functools
import json
import re
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calorix.llm.shared import strings

#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem", "slack", "stripe")
HEX_RUN = re.compile("[0-9a-f]{32,}")
HEX_FOLD = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(".") for b in range(256))
HEX_OF_BYTE = np.frombuffer(HEX_FOLD, np.uint8)
HEX_KEY = b"h" * 32
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc62_holds(match: re.Match) -> bool:
    """The last six characters are the CRC-32 of those between prefix and them, in base 62."""
    body, check, value = match[1][:-6], match[1][-6:], 0
    for c in check:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def jwt_holds(match: re.Match) -> bool:
    """The header decodes to a JSON object that names an algorithm."""
    head = match[1]
    try:
        found = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (binascii.Error, ValueError, RecursionError):
        return False
    return isinstance(found, dict) and "alg" in found


#: kind: (keywords in lower case, expression anchored at a hit, test of the match)
RULES: dict[str, tuple[tuple[str, ...], re.Pattern, Callable[[re.Match], bool]]] = {
    "assign": (
        ("password", "passwd", "secret", "token", "api_key", "apikey"),
        re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        lambda m: len(m[1]) >= 8,
    ),
    "access": (("akia",), re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), crc62_holds),
    "npm": (("npm_",), re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), crc62_holds),
    "jwt": (("eyj",), re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), jwt_holds),
    "pem": (("-----begin",), re.compile(r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,3}PRIVATE KEY-----"), lambda m: True),
    "slack": (("xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-"), re.compile(r"xox[abprs]-[0-9A-Za-z-]{20,}"), lambda m: True),
    "stripe": (("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[0-9A-Za-z]{16,}"), lambda m: True),
}


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """Keywords of all rules; a hit gives (kind, length)."""
    found = ahocorasick.Automaton()
    for kind, (keys, _, _) in RULES.items():
        for key in keys:
            found.add_word(key, (kind, len(key)))
    found.make_automaton()
    return found


@functools.cache
def hex_automaton() -> ahocorasick.Automaton:
    """The keyword of hex runs in mapped text."""
    found = ahocorasick.Automaton()
    found.add_word(HEX_KEY.decode(), 0)
    found.make_automaton()
    return found


def hex_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Runs of hex digits: the expression is tried at the automaton's hits only."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    mapped = HEX_OF_BYTE[np.minimum(points, 255)].tobytes().decode()
    used = 0
    for last, _ in hex_automaton().iter(mapped):
        start = last - len(HEX_KEY) + 1
        if start >= used and (m := HEX_RUN.match(text, start)):
            used = m.end()
            yield "hex", start, used


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets of a text, by start and kind; code points."""
    raw = text.encode("utf-8", "surrogatepass")
    lowered = raw.lower().decode("utf-8", "surrogatepass")  # bytes.lower() changes A-Z only, so positions stay
    spans, used = [], dict.fromkeys(KINDS, 0)
    hits = sorted((last - n + 1, kind) for last, (kind, n) in automaton().iter(lowered))
    for start, kind in hits:
        _, expression, holds = RULES[kind]
        if start >= used[kind] and (m := expression.match(text, start)):
            used[kind] = m.end()
            if holds(m):
                spans.append((kind, start, m.end()))
    if HEX_KEY in raw.translate(HEX_FOLD):
        spans += hex_spans(text)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``secrets``: an array of (kind, start, end)."""
    spare = [c for c in docs.columns if c != "secrets"]
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in scan(t)] for t in strings(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in spare), pa.array(found, pa.list_(item))], [*spare, "secrets"])

    narrow = docs.select(*spare)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema)
    return narrow.mapInArrow(search, f"{schema}secrets array<struct<kind:string,start:bigint,end:bigint>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: secrets of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS[:3]))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(docs).select("doc_id", *map(count, KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
