"""Chat formatting: turns to one marked text with a loss mask, in native
expressions only.

A finite-state machine reads the roles of a conversation in turn order.  Its
states are ``start``, the role just seen, and ``bad``; ``TRANSITIONS`` lists
the allowed steps.  The template is data (``ChatTemplate``): the text before
and after a turn's body, and which roles carry loss.  Output per
conversation: segments (text, loss flag) whose concatenation is the formatted
text, and the machine's verdict.  Only the bodies of loss roles are under the
loss mask.

Bodies are escaped so that the markers cannot occur in them: every ``<``
followed by backslashes and ``|`` gets one more backslash.  Role names are
written as themselves when made of letters, digits and ``._-``, otherwise
percent-encoded.  Both are undone exactly when reading back.

A conversation is one value by contract (one text, one hash), so its rows
meet in one row; the array of turns is bounded by the size of a value.

Defined cases: NULL text is empty; NULL role is the empty role, which no
transition allows; turns are sorted by (turn, role, text) with NULLs first,
so ties and repeated rows have one order; rows with NULL conv_id form one
conversation; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: state -> roles that may follow
TRANSITIONS = {
    "start": ("system", "user"),
    "system": ("user",),
    "user": ("assistant",),
    "assistant": ("user", "tool"),
    "tool": ("assistant",),
}


@dataclass(frozen=True)
class ChatTemplate:
    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    final: tuple[str, ...] = ("assistant",)
    transitions: dict = field(default_factory=lambda: TRANSITIONS)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _after(state: Column, role: Column, t: ChatTemplate) -> Column:
    out = F.lit("bad")
    for source, targets in t.transitions.items():
        out = F.when((state == source) & role.isin(*targets), role).otherwise(out)
    return out


def format_chats(turns: DataFrame, t: ChatTemplate = ChatTemplate()) -> DataFrame:
    """conv_id, n_turns, segments array<struct<text, loss>>, formatted, state
    (role of the last turn, or ``bad``) and valid."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    by_conv = (turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("row"))
               .groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows")))
    segments = F.flatten(F.transform("rows", lambda r: F.array(
        F.struct(F.concat(F.lit(t.open), F.url_encode(r["role"]), F.lit(t.after_role)).alias("text"),
                 F.lit(False).alias("loss")),
        F.struct(escape(r["text"]).alias("text"), r["role"].isin(*t.loss_roles).alias("loss")),
        F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")))))
    state = F.aggregate("rows", F.lit("start"), lambda s, r: _after(s, r["role"], t))
    return (by_conv.select("conv_id", F.size("rows").cast("long").alias("n_turns"),
                           segments.alias("segments"), state.alias("state"))
            .withColumn("formatted", F.array_join(F.transform("segments", lambda x: x["text"]), ""))
            .withColumn("valid", F.col("state").isin(*t.final)))


def read_back(chats: DataFrame, t: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Adds ``turns``, array<struct<role, text>> parsed from the formatted
    text alone, and ``loss_text``, the unescaped text under the loss mask."""
    pieces = F.split("formatted", "\\Q" + t.open + "\\E")
    parts = F.filter(pieces, lambda x, i: i > 0)          # nothing stands before the first marker

    def turn(part):
        cut = F.instr(part, t.after_role)
        body = F.substring(part, cut + len(t.after_role),
                           F.length(part) - cut - len(t.after_role) + 1 - len(t.close))
        return F.struct(F.url_decode(F.substring(part, F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text"))

    under = F.filter("segments", lambda x: x["loss"])
    return (chats.withColumn("turns", F.transform(parts, turn))
            .withColumn("loss_text", F.array_join(F.transform(under, lambda x: unescape(x["text"])), "")))
