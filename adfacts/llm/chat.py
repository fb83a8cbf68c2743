"""Chat records of several layouts as canonical turns, formatted by a reversible template.

A record is a row whose columns hold a chat in one of the layouts of ``LAYOUTS``: an array of
messages, an array of shared turns, an instruction with its output, or a prompt with its response.
Layouts may be mixed in one table, as the merged schema of JSON files has them. The fingerprint
of a record is the hash of the sorted paths, nested ones included, of those fields that layouts
know and that are not null in the record. A mapping is declared by the paths it needs and those it
may use; the fingerprints of all that can be are a short table, which is joined by fingerprint.

The template writes ``<|im_start|>``, role, line end, text, ``<|im_end|>`` and line end for each
turn. In texts and roles, ``<`` followed by any number of backslashes and ``|`` gets one backslash
more, so no text holds a mark, and reading takes it away again. In roles, line ends and backslashes
are written as two characters each. ``runs`` is the loss mask in code points: per turn, how many
before its text, how many of its text, and whether the text counts.

Everything is DataFrame functions, a projection over records. ``conversations_of`` gathers rows by
turn, as the contract's table has them; a conversation becomes one training row, so it is as
large as that row.

Defined results: a null or absent text is empty, a null role an empty role; an empty array of
messages has no turns and the formatted text is empty; a record whose fields fit no layout, or
those of two, has a null layout and null turns; other columns stay, columns named like results
are replaced. Turns of equal number are ordered by role and text; rows without an id are one
conversation.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adfacts.llm.common import OWN, table

# Marks of the template.
START, END = "<|im_start|>", "<|im_end|>\n"
# Roles whose texts count for the loss.
LEARNED = ("assistant",)
TURNS = "array<struct<role:string,text:string>>"
ADDED = ["fingerprint", "layout", "turns", "formatted", "runs"]


@dataclass(frozen=True)
class Layout:
    """A declarative mapping: paths that must and may be there, and where turns come from.

    Either ``each`` names an array whose elements have ``role`` and ``text``, or ``fields`` lists
    (role, paths) whose texts are joined by a blank line. ``roles`` renames roles.
    """

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)


LAYOUTS = [
    Layout("messages", ("messages", "messages[].role"), ("messages[].content",),
           each="messages", role="role", text="content"),
    Layout("empty_messages", ("messages",), ("messages[].content",),
           each="messages", role="role", text="content"),
    Layout("shared", ("conversations", "conversations[].from"), ("conversations[].value", "system"),
           each="conversations", role="from", text="value", fields=(("system", ("system",)),),
           roles={"human": "user", "gpt": "assistant", "chatgpt": "assistant"}),
    Layout("instruction", ("instruction",), ("input", "output", "system"),
           fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt", ("prompt",), ("response", "system"),
           fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("completion", ("prompt", "completion"), ("system",),
           fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("nested", ("prompt.text", "response.text"), ("system",),
           fields=(("system", ("system",)), ("user", ("prompt.text",)), ("assistant", ("response.text",)))),
]


def fingerprint_of(paths: list[str] | tuple[str, ...]) -> str:
    return hashlib.sha256(",".join(sorted(set(paths))).encode()).hexdigest()


def known_fingerprints(layouts: list[Layout]) -> dict[str, str]:
    """The layout of every fingerprint that one can have; each may be declared once."""
    found: dict[str, str] = {}
    for layout in layouts:
        for n in range(len(layout.may) + 1):
            for some in combinations(layout.may, n):
                key = fingerprint_of((*layout.needs, *some))
                if key in found:
                    raise ValueError(f"{layout.name} and {found[key]} have the same fields")
                found[key] = layout.name
    return found


def _type_at(schema: T.StructType, path: str) -> T.DataType | None:
    """The type of a path, ``[]`` standing for the elements of an array; null if absent."""
    at: T.DataType = schema
    for name in path.split("."):
        parts = name.split("[]")
        if not isinstance(at, T.StructType) or parts[0] not in at.names:
            return None
        at = at[parts[0]].dataType
        for _ in parts[1:]:
            if not isinstance(at, T.ArrayType):
                return None
            at = at.elementType
    return at


def _present(schema: T.StructType, path: str) -> Column:
    """Whether a field is not null; of an array's elements, in any of them."""
    if "[]" not in path:
        return _value(schema, path).isNotNull()
    outer, inner = path.split("[].")
    return F.coalesce(
        F.exists(F.col(outer), lambda e: e.getField(inner).isNotNull()), F.lit(False)
    )


def _value(schema: T.StructType, path: str) -> Column:
    first, *rest = path.split(".")
    value = F.col(f"`{first}`")
    for name in rest:
        value = value.getField(name)
    return value


def _usable(schema: T.StructType, path: str) -> bool:
    """A text, an array of structs, or for a path within an array a text."""
    kind = _type_at(schema, path)
    return isinstance(kind, T.StringType) or (
        isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)
    )


def with_layout(records: DataFrame, layouts: list[Layout] | None = None) -> DataFrame:
    """Adds ``fingerprint`` and ``layout``; the layout is null where none fits."""
    layouts = LAYOUTS if layouts is None else layouts
    records = records.drop("fingerprint", "layout")
    schema = records.schema
    paths = sorted({p for layout in layouts for p in (*layout.needs, *layout.may)})
    marks = [F.when(_present(schema, p), F.lit(p)) for p in paths if _usable(schema, p)]
    present = F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")
    rows = list(known_fingerprints(layouts).items())
    known = records.sparkSession.createDataFrame(rows, f"{OWN}fingerprint string, layout string")
    found = records.withColumn("fingerprint", F.sha2(F.array_join(present, ","), 256))
    return found.join(
        F.broadcast(known), F.col("fingerprint") == F.col(f"{OWN}fingerprint"), "left"
    ).drop(f"{OWN}fingerprint")


def _turn(role: Column, text: Column) -> Column:
    empty = F.lit("")
    return F.struct(F.coalesce(role, empty).alias("role"), F.coalesce(text, empty).alias("text"))


def _turns(schema: T.StructType, layout: Layout) -> Column:
    """The turns of a record of this layout. Fields that are null in it have no turn."""
    turns = []
    for role, paths in layout.fields:
        texts = [_value(schema, p) for p in paths if _usable(schema, p)]
        if texts:
            some = F.array_compact(F.array(*texts))
            turns.append(F.when(F.size(some) > 0, _turn(F.lit(role), F.array_join(some, "\n\n"))))
    found = [F.array_compact(F.array(*turns)).cast(TURNS)] if turns else []
    if layout.each and _usable(schema, layout.each):
        inside = schema[layout.each].dataType.elementType

        def named(element: Column, name: str) -> Column:
            known = name in inside.names and isinstance(inside[name].dataType, T.StringType)
            return element.getField(name) if known else F.lit(None).cast("string")

        def turn(element: Column) -> Column:
            role = renamed = named(element, layout.role)
            for theirs, ours in layout.roles.items():
                renamed = F.when(role == theirs, F.lit(ours)).otherwise(renamed)
            return _turn(renamed, named(element, layout.text))

        found.append(F.transform(F.col(f"`{layout.each}`"), turn).cast(TURNS))
    return F.concat(*found) if found else F.array().cast(TURNS)


def canonical_turns(records: DataFrame, layouts: list[Layout] | None = None) -> DataFrame:
    """Adds ``fingerprint``, ``layout`` and ``turns`` (role, text)."""
    layouts = LAYOUTS if layouts is None else layouts
    found = with_layout(records.drop("turns"), layouts)
    turns = F.lit(None).cast(TURNS)
    for layout in layouts:
        if all(_usable(found.schema, p) for p in layout.needs):
            turns = F.when(F.col("layout") == layout.name, _turns(found.schema, layout)).otherwise(turns)
    return found.withColumn("turns", turns)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escaped_role(role: Column) -> Column:
    """A role on one line: every backslash is followed by ``s`` (itself) or ``n`` (a line end)."""
    one = F.replace(escaped(role), F.lit("\\"), F.lit("\\s"))
    return F.replace(one, F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    one = F.replace(role, F.lit("\\n"), F.lit("\n"))
    return unescaped(F.replace(one, F.lit("\\s"), F.lit("\\")))


def formatted(records: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """Adds ``formatted``, the text of all ``turns``, and ``runs``, its loss mask."""
    written = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n")).alias("head"),
        escaped(t["text"]).alias("body"),
        t["role"].isin(*learned).alias("loss"),
    ))
    own = f"{OWN}parts"
    return records.drop("formatted", "runs").withColumn(own, written).withColumns({
        "formatted": F.array_join(
            F.transform(own, lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""
        ),
        "runs": F.transform(own, lambda p: F.struct(
            F.length(p["head"]).alias("before"), F.length(p["body"]).alias("inside"),
            p["loss"].alias("loss"),
        )),
    }).drop(own)


def _pieces(text: Column) -> Column:
    """What follows each start mark, up to the next one."""
    return F.slice(F.split(text, F.lit(r"<\|im_start\|>")), 2, 1 << 30)


def read_turns(text: Column) -> Column:
    """The turns of a formatted text."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substring(
            piece, F.length(role) + 2, F.length(piece) - F.length(role) - (1 + len(END))
        )
        return F.struct(unescaped_role(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(_pieces(text), turn)


def read_loss(text: Column, runs: Column) -> Column:
    """The texts of a formatted text that its mask counts, in order."""

    def inside(piece: Column, i: Column) -> Column:
        run = F.get(runs, i)
        # A piece begins behind the start mark, which the run's first part counts.
        taken = F.substring(piece, run["before"] - (len(START) - 1), run["inside"])
        return F.when(run["loss"], unescaped(taken))

    return F.array_compact(F.transform(_pieces(text), inside))


def conversations_of(rows: DataFrame) -> DataFrame:
    """One record per ``conv_id`` with ``messages`` in order of turns."""
    message = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("messages"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, said, said)], "conv_id long, prompt string, response string")
    records = conversations_of(table(spark, sf_dir, "conversations"))
    found = formatted(canonical_turns(records.unionByName(extra, allowMissingColumns=True)))
    lines = F.transform(
        read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    return (
        found.select(
            "conv_id", lines.alias("lines"),
            F.array_join(read_loss(F.col("formatted"), F.col("runs")), "").alias("loss"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
        .select(
            "conv_id",
            F.size("lines").cast("long").alias("n_turns"),
            F.sha2(F.array_join("lines", ""), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )


SQL = r"""
WITH extra(conv_id, turn, role, text) AS (
  VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
    (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
),
rows_ AS (
  SELECT false AS e, conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT true, conv_id, turn, role, text FROM extra
),
marked AS (
  SELECT *, coalesce(role, '') AS r, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS body,
    replace(replace(regexp_replace(coalesce(role, ''), '<(\\*)\|', '<\\\1|', 'g'), '\', '\s'),
      chr(10), '\n') AS head
  FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text))
    AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)
    FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>' || head || chr(10) || body || '<|im_end|>' || chr(10)))::BIGINT
    AS formatted_chars
FROM marked GROUP BY e, conv_id
"""

QUERIES = {"op13_chat_format": op13_chat_format}
CHECKS = {"op13_chat_format": SQL}
