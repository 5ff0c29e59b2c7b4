"""Chat formatting with typed content parts: a visitor turns each part into text, or into a placeholder and an attachment.

A turn's content is an array of parts. The visitor has one rule a kind: text is escaped; image, audio and document parts
become a placeholder each, in order, and are recorded with their reference and with the number of tokens into which a model
expands the placeholder. Turns stand between marks that begin with `<`; texts hold no bare `<`, since `<` is written `\\l`
and `\\` is written `\\b`, so reading back is exact. All of it is column expressions and one window over a
conversation's turns, which share one shuffle.

Defined results: turns are in the order of turn (null first), equal ones in that of role and content; a null role, text,
part or array of parts counts as empty; a part of an unknown kind is kept as a placeholder `<other>` of no tokens, so nothing
gets lost; rows without a conversation id form one conversation; repeated rows are repeated turns; an empty table gives an
empty one. Only the named columns are read, so further columns may have any name. A conversation is one row of the result,
so it is held by one task when it is put together: its length is what bounds that row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Marks of a turn: before its role, between role and content, behind its content.
OPEN, NAMED, CLOSE = "<turn:", ">", "</turn>\n"
#: Tokens of an attachment: image squares of so many pixels a side, tokens for each second of sound and for each page.
PATCH, PER_SECOND, PER_PAGE = 28, 25.0, 700
PLACEHOLDERS = r"<(?:image|audio|document|other)>"
_OPEN_PLACE, _CLOSE_PLACE = "<", ">"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    """A role stands inside a mark, so it holds no `>` either."""
    return F.replace(escaped(role), F.lit(">"), F.lit("\\g"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\g"), F.lit(">")))


def text_parts(text: Column) -> Column:
    """Plain text as content of one part."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in none.items())))


def _squares(pixels: Column) -> Column:
    return F.ceil(F.coalesce(pixels, F.lit(0)) / F.lit(PATCH)).cast("long")


def visitor(part: Column) -> dict[str, tuple[Column, Column]]:
    """For each kind what stands in the text and how many tokens it expands to."""
    placeholder = lambda kind: F.lit(f"{_OPEN_PLACE}{kind}{_CLOSE_PLACE}")
    return {
        "image": (placeholder("image"), _squares(part["width"]) * _squares(part["height"])),
        "audio": (placeholder("audio"), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * PER_SECOND).cast("long")),
        "document": (placeholder("document"), (F.coalesce(part["pages"], F.lit(0)) * PER_PAGE).cast("long")),
        "other": (placeholder("other"), F.lit(0).cast("long")),
    }


def visited(part: Column) -> Column:
    """A part as a struct: written, attached (is it an attachment), kind, ref, tokens."""
    rules = visitor(part)
    kind = F.coalesce(part["kind"], F.lit("text"))
    known = F.when(kind == "text", "text").when(kind.isin([k for k in rules if k != "other"]), kind).otherwise("other")
    choose = lambda at, text: reduce(lambda c, k: c.when(known == k, rules[k][at]), rules, F.when(known == "text", text))
    return F.struct(
        choose(0, escaped(F.coalesce(part["text"], F.lit("")))).alias("written"), (known != "text").alias("attached"), kind.alias("kind"), part["ref"].alias("ref"), choose(1, F.lit(0).cast("long")).alias("tokens")
    )


def _text_spans(pieces: Column) -> Column:
    """start and end, counted from the first piece, of the text pieces that aren't empty."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    zero = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))

    def add(state: Column, piece: Column) -> Column:
        end = state["at"] + F.char_length(piece["written"])
        span = F.array(F.struct(state["at"].alias("start"), end.alias("end")))
        kept = ~piece["attached"] & (end > state["at"])
        return F.struct(end.alias("at"), F.when(kept, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(pieces, zero, add, lambda s: s["spans"])


def format_chats(
    turns: DataFrame, parts: str = "parts", conv_id: str = "conv_id", turn: str = "turn", role: str = "role", learned: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """A row for each conversation: conv_id, formatted, turn_starts, loss, attachments, n_tokens.

    parts: array of structs as PART. turn_starts: where each turn begins in formatted. loss: turn (from 1), start and end (code points
    of formatted, end exclusive) of the texts of learned roles, without marks and placeholders. attachments: kind, ref and tokens
    in the order of the placeholders; n_tokens is the sum of their tokens.
    """
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.filter(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()).alias("parts"))
    told = rows.withColumn("pieces", F.transform("parts", visited)).drop("parts")
    head = F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit(NAMED))
    body = F.array_join(F.transform("pieces", lambda p: p["written"]), "")
    spans = F.when(F.col("role").isin(list(learned)), _text_spans(F.col("pieces"))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    attached = F.transform(F.filter("pieces", lambda p: p["attached"]), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    written = told.select(
        "conv_id", "turn", "role", F.concat(head, body, F.lit(CLOSE)).alias("segment"), F.char_length(head).cast("long").alias("head"), spans.alias("spans"), attached.alias("attached")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "segment", F.to_json("attached"))
    before = F.sum(F.char_length("segment")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = written.withColumns({"at": F.coalesce(before, F.lit(0).cast("long")), "no": F.row_number().over(order)})
    in_turn = F.transform("spans", lambda s: F.struct(F.col("no").alias("turn"), (s["start"] + F.col("at") + F.col("head")).alias("start"), (s["end"] + F.col("at") + F.col("head")).alias("end")))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("no", "at", "segment", in_turn.alias("loss"), "attached"))).alias("all"))
    flat = lambda name: F.flatten(F.transform("all", lambda x: x[name]))
    return whole.select(
        "conv_id", F.array_join(F.transform("all", lambda x: x["segment"]), "").alias("formatted"), F.transform("all", lambda x: x["at"]).alias("turn_starts"),
        flat("loss").alias("loss"), flat("attached").alias("attachments"),
    ).withColumn("n_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: role, text (without placeholders) and placeholders, in order."""
    segments = F.filter(F.split(formatted, CLOSE, -1), lambda s: s != "")
    role = lambda s: F.substring_index(F.substr(s, F.lit(len(OPEN) + 1)), NAMED, 1)
    body = lambda s: F.substr(s, F.instr(s, NAMED) + len(NAMED))
    return F.transform(
        segments,
        lambda s: F.struct(
            unescaped_role(role(s)).alias("role"), unescaped(F.regexp_replace(body(s), PLACEHOLDERS, "")).alias("text"), F.regexp_extract_all(body(s), F.lit(PLACEHOLDERS), F.lit(0)).alias("placeholders")
        ),
    )


def loss_text(formatted: Column, turn_starts: Column, loss: Column) -> Column:
    """What lies under the mask, as it was before it was escaped. Each span is cut from its own turn, so the work is linear."""
    segments = F.split(formatted, CLOSE, -1)

    def cut(span: Column) -> Column:
        first = F.element_at(turn_starts, span["turn"].cast("int"))
        return unescaped(F.substr(F.element_at(segments, span["turn"].cast("int")), (span["start"] - first + 1).cast("int"), (span["end"] - span["start"]).cast("int")))

    return F.array_join(F.transform(loss, cut), "")
