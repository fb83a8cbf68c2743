"""Secrets in texts: keywords by one automaton, patterns only at its hits, then checksums.

A text is walked once by an Aho-Corasick automaton of all keywords. At each hit the pattern of
that keyword is tried at that very place; nothing else of the text meets a pattern. A run of characters
in which one hit failed is not read again, so a text of repeated keywords takes no longer. Runs of
hexadecimal digits have no keyword: their prefilter is a search for 32 marks in the text with
every hexadecimal digit replaced by a mark. Tokens that carry a checksum (a CRC-32 in base 62
in the last six characters) and web tokens (whose head must be base64 of a JSON object naming
an algorithm) count only if that is valid.

Each document is a row of its own, so nothing is shuffled. Defined results: a null text is
empty; a null id stays null; repeated rows are scanned and returned each; columns of the input
other than those returned are not read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adfacts.llm.common import table

BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, "checked", "webtoken", "key"]
PATTERNS = {
    "assign": re.compile(
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.ASCII,
    ),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
    "checked": re.compile(r"(?:gh[pousr]|npm)_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "webtoken": re.compile(r"(eyJ[A-Za-z0-9_-]++)\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"),
    "key": re.compile(
        # Lines of headers, then base 64; line ends may be escaped, as in JSON.
        r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----"
        r"(?:(?:\s|\\+[nr])++[A-Za-z][A-Za-z0-9-]*+:(?:[^\r\n\\-]|-(?!----))*+)*+"
        r"(?:[A-Za-z0-9+/=\s]|\\+[nrt/])++-----END \1-----"
    ),
}
# A hit that fails fails at all other hits in the same run of these as well.
RUNS = {"webtoken": re.compile(r"[A-Za-z0-9_-]++")}
KEYWORDS = {
    **dict.fromkeys(["password", "passwd", "secret", "token", "apikey", "api_key"], "assign"),
    "akia": "access",
    **dict.fromkeys(["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"], "checked"),
    "eyj": "webtoken",
    "-----begin ": "key",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_RUN = b"x" * 32
HEX_MARKS = bytes(ord("x") if chr(b) in "0123456789abcdef" else 32 for b in range(256))

SPAN = "struct<kind:string,start:int,end:int>"


def checksum(payload: str) -> str:
    """CRC-32 in base 62, six characters."""
    value, digits = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


def _web_head(head: str) -> bool:
    try:
        fields = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (binascii.Error, ValueError):
        return False
    return isinstance(fields, dict) and "alg" in fields


def _holds(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[1]) >= 8
    if kind == "access":
        return len(match[0]) >= 16
    if kind == "hex":
        return len(match[0]) >= 32
    if kind == "checked":
        body = match[0][4:]
        return checksum(body[:-6]) == body[-6:]
    if kind == "webtoken":
        return _web_head(match[1])
    return True


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def _hex_places(data: bytes, text: str) -> Iterator[int]:
    """Where runs of 32 or more hexadecimal digits begin."""
    marks = data.translate(HEX_MARKS)
    at = marks.find(HEX_RUN)
    while at >= 0:
        yield at if len(data) == len(text) else len(data[:at].decode())
        end = marks.find(b" ", at)
        at = marks.find(HEX_RUN, end) if end >= 0 else -1


def spans(data: bytes, keywords: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind as listed."""
    text = data.decode()
    hits: dict[str, list[int]] = {}
    for end, (length, kind) in keywords.iter(data.lower().decode()):
        hits.setdefault(kind, []).append(end - length + 1)
    runs = list(_hex_places(data, text))
    if runs:
        hits["hex"] = runs
    found = []
    for kind, places in hits.items():
        free = 0
        for place in sorted(places):
            if place < free:
                continue
            match = PATTERNS[kind].match(text, place)
            if match:
                free = match.end()
                if _holds(kind, match):
                    found.append((kind, match.start(), match.end()))
            elif kind in RUNS and (run := RUNS[kind].match(text, place)):
                free = run.end()
    found.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return found


def with_spans(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and ``spans``, all secrets of ``text``."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        )
        for batch in batches:
            texts = batch.column("_text")
            found = [
                [{"kind": k, "start": s, "end": e} for k, s, e in spans(t.as_py() or b"", keywords)]
                for t in texts
            ]
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(found, kind)], names=[*columns, "spans"]
            )

    read = docs.select(*columns, F.col("text").cast("binary").alias("_text"))
    return read.mapInArrow(scan, f"{schema}, spans array<{SPAN}>")


def redacted(docs: DataFrame) -> DataFrame:
    """Documents with every secret replaced by ``[kind]``; n_chars is that of the new text.

    Overlapping spans are replaced as one, by the kind that starts first.
    """
    docs = docs.withColumn("n_chars", F.col("n_chars").cast("long"))
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    schema = docs.schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            texts = []
            for value in batch.column("text"):
                data = value.as_py()
                if data is None:
                    texts.append(None)
                    continue
                text, parts, done = data, [], 0
                for kind, start, end in spans(data.encode(), keywords):
                    if start >= done:
                        parts += [text[done:start], f"[{kind}]"]
                    done = max(done, end)
                texts.append("".join([*parts, text[done:]]))
            columns = {c: batch.column(c) for c in others}
            columns["text"] = pa.array(texts, pa.string())
            columns["n_chars"] = pa.array(
                [None if t is None else len(t) for t in texts], pa.int64()
            )
            yield pa.RecordBatch.from_arrays(
                [columns[f.name] for f in schema], names=[f.name for f in schema]
            )

    return docs.mapInArrow(scan, schema)


def _listed(found: str) -> Column:
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(table(spark, sf_dir, "documents"), "doc_id")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.withColumn(
        "_base", F.filter("spans", lambda s: s["kind"].isin(BASE_KINDS))
    ).select(
        "doc_id",
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(_listed("_base"), 256).alias("base_sha256"),
        _listed("spans").alias("spans"),
        (F.size("spans") - F.size("_base")).cast("long").alias("n_checked"),
    )


QUERIES = {"op6_secrets": op6_secrets}
CHECKS: dict[str, str] = {}
