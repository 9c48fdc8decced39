r"""Chat formatting: a state machine over roles, and a template that gives segments with loss flags.

Each turn becomes three segments: an opening, the escaped text, a closing. Only
the texts of roles with loss carry a set loss flag. Escaping is reversible:
a backslash becomes `\b`, and the first character of a control string becomes `\l`
(`<`) or `\k` (`[`), so that no text holds a control string. Control strings
hold `<` and `[` in the first place only, hence none arises where segments meet.

Turns are ordered by turn, role and text, nulls first. A null text counts as
empty, a null role as the empty role; roles outside the template are written
into the opening. Rows without conv_id form one conversation. Repeated rows are
turns of their own. An order of roles that the machine refuses is formatted all
the same, with valid_order false. An empty table gives no conversation but the
added ones.

The digests are of whole conversations, so a conversation is put together in
one task; its memory is that of its own text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbspark.llm.common import table


@dataclass(frozen=True)
class Template:
    """What opens and closes a turn, by role; `other` is for the rest, with {role} in its place."""

    turns: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("<s>[SYS]", "[/SYS]</s>"),
            "user": ("<s>[INST]", "[/INST]</s>"),
            "assistant": ("<s>[OUT]", "[/OUT]</s>"),
        }
    )
    other: tuple[str, str] = ("<s>[ROLE]{role}[SAYS]", "[/SAYS]</s>")
    #: Roles whose texts are trained on.
    loss_roles: tuple[str, ...] = ("assistant",)
    #: State -> roles that may follow it. The state is the role before, "" at the start.
    moves: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("", ("system", "user")),
        ("system", ("user",)),
        ("user", ("assistant",)),
        ("assistant", ("user", "tool")),
        ("tool", ("assistant",)),
    )
    #: Roles that a conversation may end with.
    ends: tuple[str, ...] = ("assistant",)


DEFAULT = Template()
_NAMES = ("SYS", "INST", "OUT", "ROLE", "SAYS")
#: Said by both turns of the conversation that the query adds.
ADDED_TEXT = "</s>[INST] ok [/INST]"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    text = F.regexp_replace(text, "<(?=/?s>)", r"\\l")
    return F.regexp_replace(text, r"\[(?=/?(?:" + "|".join(_NAMES) + r")\])", r"\\k")


def unescaped(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\k"), F.lit("["))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def formatted(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, formatted, segments (array of text and loss), valid_order: one row a conversation."""

    def place(role: Column, which: int) -> Column:
        out = F.replace(F.lit(template.other[which]), F.lit("{role}"), escaped(role))
        for name, parts in template.turns.items():
            out = F.when(role == name, F.lit(parts[which])).otherwise(out)
        return out

    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    moves = F.create_map(
        *(F.lit(x) for state, roles in template.moves for role in roles for x in (f"{state}>{role}", role))
    )
    parts = lambda t: F.array(
        segment(place(t["role"], 0), F.lit(False)),
        segment(escaped(t["text"]), t["role"].isin(*template.loss_roles)),
        segment(place(t["role"], 1), F.lit(False)),
    )
    # Raw texts are collected, so that turns alike in turn and role stand in the order of their texts.
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (
        turns.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
        .withColumns(
            {
                "segments": F.flatten(F.transform("_turns", parts)),
                "_end": F.aggregate(
                    "_turns.role",
                    F.lit(""),
                    lambda state, r: F.coalesce(F.try_element_at(moves, F.concat_ws(">", state, r)), F.lit("refused")),
                ),
            }
        )
        .select(
            "conv_id",
            F.array_join("segments.text", "").alias("formatted"),
            "segments",
            F.col("_end").isin(*template.ends).alias("valid_order"),
        )
    )


def read_back(chats: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """chats with turns (array of role and text), parsed from the formatted text alone."""
    # A turn ends with a control string that no text holds.
    pieces = F.filter(F.split("formatted", "</s>"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        role = unescaped(F.regexp_extract(piece, r"(?s)^<s>\[ROLE\](.*)\[SAYS\]", 1))
        body = F.regexp_extract(piece, r"(?s)^<s>\[ROLE\].*\[SAYS\](.*)\[/SAYS\]$", 1)
        for name, (opening, closing) in template.turns.items():
            closing = closing.removesuffix("</s>")
            mine = F.startswith(piece, F.lit(opening))
            inner = F.substring(piece, F.lit(len(opening) + 1), F.length(piece) - len(opening) - len(closing))
            role, body = F.when(mine, F.lit(name)).otherwise(role), F.when(mine, inner).otherwise(body)
        return F.struct(role.alias("role"), unescaped(body).alias("text"))

    return chats.withColumn("turns", F.transform(pieces, turn))


def with_added(turns: DataFrame) -> DataFrame:
    """The turns and conversation -1: a user and an assistant row that both say a control string."""
    added = turns.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(ADDED_TEXT).alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(added)


def digests(chats: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives."""
    said = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    return (
        read_back(chats)
        .withColumn("_loss", unescaped(F.array_join(F.filter("segments", lambda s: s.loss).getField("text"), "")))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
            F.length("_loss").cast("long").alias("loss_chars"),
            F.sha2("_loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "valid_order",
        )
    )


def op5_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return digests(formatted(with_added(table(spark, sf_dir, "conversations"))))


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *,
         length(text) + length(text) - length(replace(text, '\', ''))
         + len(regexp_extract_all(text, '</?s>|\[/?(?:SYS|INST|OUT|ROLE|SAYS)\]'))
         + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 20 WHEN 'assistant' THEN 18
           ELSE 30 + length(role) + length(role) - length(replace(role, '\', ''))
                + len(regexp_extract_all(role, '</?s>|\[/?(?:SYS|INST|OUT|ROLE|SAYS)\]')) END AS chars,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS after
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user')
                     ELSE (before, role) IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user'),
                                             ('assistant', 'tool'), ('tool', 'assistant')) END
                AND (after IS NOT NULL OR role = 'assistant')) AS valid_order
FROM e GROUP BY conv_id
"""
