"""Pieces of SQL for the checking engine, written independently of the Column functions."""

from __future__ import annotations

from html.entities import html5

from adfacts import constants as K
from adfacts.functions.text import LATIN_1_GAP, STRIPPED


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {quoted(STRIPPED)})"


MARKUP = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)"
    r"|<template\b[^>]*>.*?</template\s*>|<rt\b[^>]*>.*?</rt\s*>|<rp\b[^>]*>.*?</rp\s*>"
    r"""|</?[a-z](?:[^>"']*(?:"[^"]*"|'[^']*'))*[^>"']*>|</?[a-z][^>]*>|<![^>]*>|<\?[^>]*>"""
)
ENTITY = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?|[^&]+|&"


def _character(n: str) -> str:
    return (
        f"CASE WHEN {n} BETWEEN 128 AND 159 THEN ({listed(LATIN_1_GAP)})[{n} - 127] "
        f"WHEN {n} > 0 AND {n} < 1114112 AND {n} NOT BETWEEN 55296 AND 57343 "
        f"THEN chr(({n})::INTEGER) ELSE '�' END"
    )


def decoded(x: str) -> str:
    names = ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in {k.rstrip(";"): v for k, v in html5.items()}.items())
    decimal = "coalesce(try_cast(regexp_extract(p, '^&#([0-9]+)', 1) AS BIGINT), 0)"
    hexadecimal = (
        "(CASE WHEN length(ltrim(regexp_extract(p, '^&#[xX]([0-9a-fA-F]+)', 1), '0')) <= 6 "
        "THEN ('0x' || regexp_extract(p, '^&#[xX]([0-9a-fA-F]+)', 1))::BIGINT ELSE 0 END)"
    )
    name = "regexp_extract(p, '^&([A-Za-z0-9]+)', 1)"
    return f"""array_to_string(list_transform(regexp_extract_all({x}, {quoted(ENTITY)}), lambda p:
  CASE WHEN left(p, 1) <> '&' OR p = '&' THEN p
    WHEN regexp_matches(p, '^&#[0-9]') THEN {_character(decimal)}
    WHEN regexp_matches(p, '^&#') THEN {_character(hexadecimal)}
    ELSE coalesce((map {{{names}}})[{name}], '&' || {name}) END), '')"""


def filled_lines(x: str) -> str:
    return (
        f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), "
        f"lambda t: {strip('t')}), lambda t: t <> ''), chr(10))"
    )


def html_to_text(x: str) -> str:
    nodes = f"regexp_replace(coalesce({x}, ''), {quoted(MARKUP)}, chr(10), 'g')"
    return f"coalesce({filled_lines(decoded(nodes))}, '')"


def no_emojis(x: str) -> str:
    return f"regexp_replace({x}, {quoted('[' + K.EMOJI_RANGES + ']+')}, '', 'g')"


def task_type(x: str, otherwise: str = "Unknown") -> str:
    cases = " ".join(
        f"WHEN contains({x}, {quoted(marker)}) THEN {quoted(task)}"
        for task, marker in K.TASK_MARKERS.items()
    )
    return f"CASE {cases} ELSE {quoted(otherwise)} END"


def frequency(x: str) -> str:
    cases = []
    for name, words in K.FREQUENCY_KEYWORDS.items():
        held = " OR ".join(f"contains({x}, {quoted(w)})" for w in words)
        cases.append(f"WHEN {held} THEN {quoted(name)}")
    return f"CASE {' '.join(cases)} END"


def any_of(x: str, phrases: list[str]) -> str:
    return " OR ".join(f"regexp_matches({x}, {quoted(f'\\b{p}\\b')})" for p in phrases)


TOKEN = r"[\p{L}\p{N}]+|[^\x09-\x0d\x20\p{L}\p{N}]"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {quoted(TOKEN)})"


def strip_tags_lowered(*parts: str) -> str:
    text = " || ' ' || ".join(f"coalesce({p}, '')" for p in parts)
    return f"lower(trim(regexp_replace(regexp_replace({text}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')))"


def spelled_ids(x: str) -> str:
    return (
        f"list_transform({x}, lambda t: ((length(t) * 7919 + unicode(t) * 104729 "
        "+ unicode(t[-1]) * 1299709) % 150000 + 2)::INTEGER)"
    )


def repeated(value: str, n: str) -> str:
    return f"list_transform(range(0, greatest({n}, 0)::BIGINT), lambda i: {value})"


def padded(x: str, length: str, value: str = "0") -> str:
    return f"list_concat({x}, {repeated(value, f'{length} - len({x})')})"


def joined(x: str) -> str:
    return f"array_to_string({x}, ' ')"
