"""Chat formatting: a machine over roles, and a template that marks turns and says which text bears loss.

The machine takes a step at each turn, from the role before to the turn's own. Texts are escaped so that no control string can arise inside
one, and the escape can be taken back. All of it is windows, array and string expressions; the one shuffle brings a conversation's rows together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``start`` role ``between`` text ``end``, for each turn. ``start`` and ``end`` begin with ``<|``, which escaped texts can't hold.

    ``follows``: the machine. What role may come after each ("" is the beginning); ``last``: roles that a conversation may end with.
    """

    start: str = "<|im_start|>"
    between: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    last: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(text: Column) -> Column:
    """No ``<|`` is left; ``unescape`` gives the text back."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    """As ``escape``, and no line end is left either, so that the role's end is certain."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Takes both escapes back. A run of backslashes begins with pairs, each one backslash; a single one belongs to what follows."""
    single = lambda part: F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), single), "\\")


def format_chats(turns: DataFrame, template: Template = CHATML, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: ``conv_id``, ``formatted``, ``segments`` (array of start, length in code
    points, role, loss - the spans of escaped texts in ``formatted``, in order) and ``valid`` (the machine accepts the roles).

    Turns go by ``turn``, ties by role and text; null text and null role are empty. Repeated rows are turns
    of their own. A null ``conv_id`` is a conversation like others. Invalid conversations are formatted too. Other columns are
    left out. An empty table gives no rows. A conversation is one text, so one task holds it; its cost is in proportion to its length.
    """
    t = template
    rows = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    parts = rows.withColumns({"head": F.concat(F.lit(t.start), escape_role(F.col("role")), F.lit(t.between)), "body": escape(F.col("text"))})
    size = F.length("head") + F.length("body") + len(t.end)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    steps = [(a, b) for a, nexts in t.follows.items() for b in nexts]
    before = F.coalesce(F.lag("role").over(order), F.lit(""))
    moved = F.concat(before, F.lit("\x00"), "role").isin(*(f"{x}\x00{y}" for x, y in steps))
    ended = F.lead("role").over(order).isNotNull() | F.col("role").isin(*t.last)
    stepped = parts.withColumns({"at": (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size).cast("int"), "ok": moved & ended})
    chats = stepped.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "head", "body", "role"))).alias("_parts"), F.bool_and("ok").alias("valid"))
    spans = F.transform("_parts", lambda p: F.struct((p["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"), p["role"].alias("role"), p["role"].isin(*t.loss_roles).alias("loss")))
    return chats.select("conv_id", F.concat_ws("", F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(t.end)))).alias("formatted"), spans.alias("segments"), "valid")


def read_back(chats: DataFrame, template: Template = CHATML) -> DataFrame:
    """``chats`` with ``turns`` (array of role, text), parsed from ``formatted`` alone, and ``loss_text``, cut out of it by ``segments``."""
    t = template
    bodies = F.slice(F.split("formatted", _quoted(t.start)), 2, 1 << 30)
    role = lambda b: F.substring_index(b, t.between, 1)
    rest = lambda b: F.substr(b, F.length(role(b)) + F.lit(len(t.between) + 1), F.length(b) - F.length(role(b)) - F.lit(len(t.between) + len(t.end)))
    turns = F.transform(bodies, lambda b: F.struct(unescape(role(b)).alias("role"), unescape(rest(b)).alias("text")))
    masked = F.filter("segments", lambda s: s["loss"])
    loss = F.concat_ws("", F.transform(masked, lambda s: unescape(F.substr(F.col("formatted"), s["start"] + F.lit(1), s["length"]))))
    return chats.withColumns({"turns": turns, "loss_text": loss})


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"
