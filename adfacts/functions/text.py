"""Cleaning ads and building prompts."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from adfacts import constants as K
from adfacts.functions.values import once

# What str.strip takes off both ends: ASCII white space and separators, NEL, NBSP and
# the wider Unicode spaces.
STRIPPED = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# Everything between two text nodes: comments, elements whose text is not page text,
# tags (a quoted attribute value may hold ">"), declarations.
MARKUP = (
    r"(?is)<(?:!--.*?-->"
    r"|script\b[^>]*>.*?(?:</script\s*>|\z)"
    r"|style\b[^>]*>.*?(?:</style\s*>|\z)"
    r"|template\b[^>]*>.*?</template\s*>"
    r"|rt\b[^>]*>.*?</rt\s*>"
    r"|rp\b[^>]*>.*?</rp\s*>"
    r"""|/?[a-z](?:[^>"']*+(?:"[^"]*"|'[^']*'))*+[^>"']*+>"""
    r"|/?[a-z][^>]*>"
    r"|![^>]*>"
    r"|\?[^>]*>)"
)
# All names of characters as one literal, which folds into one map. A map is searched from its
# start, so the old short names, which pages use most, come first.
NAMES = {name.rstrip(";"): text for name, text in sorted(html5.items(), key=lambda n: (len(n[0]), n[0]))}
ENTITIES = "\x01".join(f"{name}\x02{text}" for name, text in NAMES.items())
ENTITY_OR_TEXT = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?|[^&]+|&"

WHITE_SPACE_RUN = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}]+"
)

# Numeric references 128 to 159 mean the Windows code page, where it has a character.
LATIN_1_GAP = [
    bytes([n]).decode("cp1252", errors="ignore") or chr(n) for n in range(128, 160)
]


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(STRIPPED))


def _code_point(n: Column) -> Column:
    known = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
    wide = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    gap = F.array(*[F.lit(ch) for ch in LATIN_1_GAP])
    return (
        F.when(n.between(128, 159), F.get(gap, (n - 128).cast("int")))
        .when(known, wide)
        .otherwise(F.lit("\ufffd"))
    )


def _reference(piece: Column) -> Column:
    """One piece of text: a character reference decoded, anything else as it is."""
    named = F.str_to_map(F.lit(ENTITIES), F.lit("\x01"), F.lit("\x02"))
    name = F.regexp_extract(piece, r"^&([A-Za-z0-9]+)", 1)
    decimal = F.regexp_extract(piece, r"^&#([0-9]+)", 1)
    hexadecimal = F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]+)", 1)
    # Digits past any code point overflow to null, which reads as an unknown character.
    decimal_point = F.coalesce(decimal.try_cast("bigint"), F.lit(0))
    hexadecimal_point = once(
        F.ltrim(hexadecimal, F.lit("0")),
        lambda h: F.when(F.length(h) <= 6, F.conv(h, 16, 10).cast("bigint")).otherwise(F.lit(0)),
    )
    return (
        F.when(~piece.startswith("&") | (piece == "&"), piece)
        .when(F.rlike(piece, F.lit("^&#[0-9]")), once(decimal_point, _code_point))
        .when(piece.startswith("&#"), once(hexadecimal_point, _code_point))
        .otherwise(
            once(name, lambda n: F.coalesce(F.try_element_at(named, n), F.concat(F.lit("&"), n)))
        )
    )


def decode_entities(c: Column) -> Column:
    """Character references decoded once; a reference with an unknown name stays as text."""
    pieces = F.regexp_extract_all(c, F.lit(ENTITY_OR_TEXT), F.lit(0))
    return F.array_join(F.transform(pieces, _reference), "")


def filled_lines(c: Column) -> Column:
    """Lines stripped, blank ones dropped."""
    lines = F.transform(F.split(c, "\n"), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def html_to_text(c: Column) -> Column:
    """The text nodes of an HTML fragment, one per line; null gives the empty string.

    Works on tags as written and builds no tree, so inline tags end a line too.
    """
    return filled_lines(decode_entities(F.regexp_replace(text_or_empty(c), MARKUP, "\n")))


def remove_emojis(c: Column) -> Column:
    return F.regexp_replace(c, f"[{K.EMOJI_RANGES}]+", "")


def clean_title(title: Column) -> Column:
    return remove_emojis(html_to_text(strip(text_or_empty(title))))


def clean_ad(ad: Column) -> Column:
    return html_to_text(strip(text_or_empty(ad)))


def _spaced(*parts: Column) -> Column:
    # Markup that was escaped in a part is only now markup, hence the second parse.
    return html_to_text(F.concat_ws(" ", *parts))


def salary_prompt(title: Column, ad: Column, nation: Column, pay: Column) -> Column:
    return _spaced(
        clean_title(title),
        clean_ad(ad),
        strip(text_or_empty(nation)),
        strip(text_or_empty(pay)),
    )


def seniority_prompt(
    title: Column, summary: Column, ad: Column, field: Column, subfield: Column
) -> Column:
    return _spaced(
        clean_title(title),
        strip(text_or_empty(summary)),
        clean_ad(ad),
        strip(text_or_empty(field)),
        strip(text_or_empty(subfield)),
    )


def arrangement_prompt(ad: Column) -> Column:
    return clean_ad(ad)


def strip_tags(c: Column) -> Column:
    """Tags become spaces and white space collapses to one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), WHITE_SPACE_RUN, " "))


def joined_text(*parts: Column) -> Column:
    return F.concat_ws(" ", *[text_or_empty(p) for p in parts])


def lowered(c: Column) -> Column:
    return F.lower(text_or_empty(c))


def _known_task(task: str, texts: dict) -> str:
    if task not in texts:
        raise ValueError(f"unknown task {task!r}, expected one of {sorted(texts)}")
    return texts[task]


def tagged_prompt(text: Column, task: str) -> Column:
    prefix = _known_task(task, K.TAGGED_PREFIX)
    return F.concat(F.lit(prefix + "job ad: \n"), text_or_empty(text), F.lit("\n\n"))


def zero_shot_prompt(text: Column, task: str) -> Column:
    prefix = _known_task(task, K.ZERO_SHOT_PREFIX)
    return F.concat(
        F.lit(prefix + "Job Advertisement:\n"), strip(text_or_empty(text)), F.lit("\n")
    )


def expert_prompt(prompt: Column, task: Column) -> Column:
    """The template of the task around the prompt; other tasks get the prompt alone."""
    out = prompt
    for name, template in K.EXPERT_TEMPLATE.items():
        before, after = template.split("{prompt}")
        out = F.when(task == name, F.concat(F.lit(before), prompt, F.lit(after))).otherwise(out)
    return out


def task_type(prompt: Column, otherwise: str = "Unknown") -> Column:
    """The task whose marker the prompt holds, tested in a fixed order."""
    chain = F
    for name, marker in K.TASK_MARKERS.items():
        chain = chain.when(F.contains(prompt, F.lit(marker)), F.lit(name))
    return chain.otherwise(F.lit(otherwise))


# --- ads with a header ---------------------------------------------------------------

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def header_lines(prompt: Column) -> Column:
    return F.split(F.regexp_replace(text_or_empty(prompt), rf"(?:{LINE_END})\z", ""), LINE_END)


def tail_start(lines: Column) -> Column:
    """1-based position of the first line that opens the contents, 0 if there is none."""
    opens = F.transform(lines, lambda line: F.lower(line).startswith("contents:"))
    return F.array_position(opens, True)


def split_header(prompt: Column) -> Column:
    """Struct of the named header fields (null if absent) and the tail.

    Of several lines with the same name the last counts; other head lines are lost.
    """
    return once(header_lines(prompt), lambda lines: once(tail_start(lines), _split_at(lines)))


def _split_at(lines: Column):
    def parts(start: Column) -> Column:
        head = F.when(start == 0, lines).otherwise(F.slice(lines, F.lit(1), start - 1))
        tail = F.when(start > 0, F.array_join(F.slice(lines, start, F.size(lines)), "\n"))
        return once(
            head,
            lambda h: F.struct(
                *[_last_field(h, name).alias(_field_name(name)) for name in K.HEADER_FIELDS],
                F.coalesce(tail, F.lit("")).alias("tail"),
            ),
        )

    return parts


def _last_field(head: Column, name: str) -> Column:
    pattern = rf"(?i)^\s*{name}\s*:\s*(.*)$"
    hits = F.filter(head, lambda line: F.rlike(line, F.lit(pattern)))
    return once(hits, lambda h: strip(F.regexp_extract(F.get(h, F.size(h) - 1), pattern, 1)))


def _field_name(name: str) -> str:
    return name.lower().replace(" ", "_")


def build_header(parts: Column) -> Column:
    """The text of a header struct again, fields in their fixed order."""
    head = F.concat_ws(
        "\n",
        *[F.concat(F.lit(f"{name}: "), parts[_field_name(name)]) for name in K.HEADER_FIELDS],
    )
    tail = F.regexp_replace(parts["tail"], r"^\n+", "")
    return F.concat(head, F.when(parts["tail"] != "", F.concat(F.lit("\n"), tail)).otherwise(""))


def message_preview(idx: Column, name: Column, content: Column, shown: int = 200) -> Column:
    """One line of a chat log; ``idx`` counts from 0, the log from 1."""

    def line(said: Column) -> Column:
        return F.concat(
            F.lit("["), (idx + 1).cast("string"), F.lit("] "),
            F.coalesce(name, F.lit("Unknown")), F.lit(": "),
            F.substring(said, 1, shown),
            F.when(F.length(said) > shown, F.lit("...")).otherwise(F.lit("")),
        )

    return once(strip(text_or_empty(content)), line)
