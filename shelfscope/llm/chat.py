"""Chat formatting: typed content parts become one marked text with a loss mask (DataFrame functions only).

A turn is a list of parts. A visitor, one expression per kind of part, flattens them in order: text is
escaped (adjacent text parts as one, so that no mark forms where they meet), every other part becomes a
placeholder and an attachment record with its reference, place in the text and expanded token count.

Defined results: null role -> empty; line breaks and backslashes of a role are escaped too; null or empty parts -> an empty turn; null text -> empty; a part of
unknown or null kind -> taken as text; null sizes count as 0. Turns order by turn number (null first),
then role, then content, so ties and repeated rows keep one order; repeated rows are repeated turns. A
null conversation id is an id of its own. Other columns of the input are not read. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART_TYPE = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TURN = "<|turn|>"
END = "<|end|>\n"
#: What a text may not hold as it is: our own marks, and marks of two widespread templates. An opening
#: sign, then what follows it; between them escaping puts one backslash more than there were.
OPENING = r"([<\[])"
REST = r"(\||/?s>|/?INST\])"


def escaped(text: Column) -> Column:
    """Without control strings; `unescaped` gives the text back exactly."""
    return F.regexp_replace(text, OPENING + r"(\\*)" + REST, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, OPENING + r"\\(\\*)" + REST, "$1$2$3")


def escaped_role(role: Column) -> Column:
    """On one line and without control strings; `unescaped_role` gives the role back exactly."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def whole(x: Column) -> Column:
    return F.greatest(F.coalesce(x, F.lit(0)), F.lit(0))


@dataclass(frozen=True)
class Costs:
    """How many tokens a placeholder stands for."""

    patch: int = 14
    audio_per_second: float = 25.0
    per_page: int = 256

    def image(self, part: Column) -> Column:
        side = lambda x: F.ceil(whole(x) / F.lit(self.patch))
        return side(part["width"]) * side(part["height"])

    def audio(self, part: Column) -> Column:
        return F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * F.lit(self.audio_per_second))

    def document(self, part: Column) -> Column:
        return whole(part["pages"]).cast("long") * F.lit(self.per_page)


def visitor(costs: Costs) -> dict[str, Callable[[Column], Column]]:
    """Token count by kind of attachment."""
    return {"image": costs.image, "audio": costs.audio, "document": costs.document}


def visit(part: Column, costs: Costs) -> Column:
    """(body, kind, ref, tokens) of a part; text has null kind and is not yet escaped."""
    kinds = visitor(costs)
    tokens = F.lit(None).cast("long")
    for kind, count in kinds.items():
        tokens = F.when(part["kind"] == kind, count(part).cast("long")).otherwise(tokens)
    attached = F.coalesce(part["kind"].isin(*kinds), F.lit(False))
    return F.struct(
        F.when(attached, F.concat(F.lit("<|"), part["kind"], F.lit("|>")))
        .otherwise(F.coalesce(part["text"], F.lit("")))
        .alias("body"),
        F.when(attached, part["kind"]).alias("kind"),
        F.when(attached, part["ref"]).alias("ref"),
        tokens.alias("tokens"),
    )


VISITED = "struct<body:string,kind:string,ref:string,tokens:bigint>"


def text_runs(visited: Column) -> Column:
    """Visited parts with each run of adjacent texts as one escaped text."""

    def text(run: Column) -> Column:
        none = F.lit(None)
        return F.array(F.struct(
            escaped(run).alias("body"), none.cast("string").alias("kind"), none.cast("string").alias("ref"), none.cast("long").alias("tokens"),
        ))

    def add(state: Column, part: Column) -> Column:
        attached = part["kind"].isNotNull()
        return F.struct(
            F.when(attached, F.concat(state["out"], text(state["run"]), F.array(part))).otherwise(state["out"]).alias("out"),
            F.when(attached, F.lit("")).otherwise(F.concat(state["run"], part["body"])).alias("run"),
        )

    start = F.struct(F.array().cast(f"array<{VISITED}>").alias("out"), F.lit("").alias("run"))
    return F.aggregate(visited, start, add, lambda state: F.concat(state["out"], text(state["run"])))


def text_part(text: Column) -> Column:
    """A turn of one text as a list of parts."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
        )
    )


def flattened(turns: DataFrame, costs: Costs) -> DataFrame:
    """One row per turn: header, body, and the placeholders with their places in the body."""
    role = F.coalesce(F.col("role"), F.lit(""))
    visited = F.transform(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART_TYPE}>")), lambda p: visit(p, costs))
    placed = F.aggregate(
        F.col("pieces"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["body"])).alias("at"),
            F.concat(a["starts"], F.array(a["at"])).alias("starts"),
        ),
        lambda a: a["starts"],
    )
    found = F.filter(
        F.arrays_zip(F.col("pieces"), F.col("starts")),
        lambda x: x["pieces"]["kind"].isNotNull(),
    )
    return (
        turns.select("conv_id", "turn", role.alias("role"), visited.alias("visited"))
        .withColumn("pieces", text_runs(F.col("visited")))
        .withColumn("starts", placed)
        .select(
            "conv_id", "turn", "role",
            F.concat(F.lit(TURN), escaped_role(F.col("role")), F.lit("\n")).alias("header"),
            F.array_join(F.col("pieces.body"), "").alias("body"),
            F.transform(
                found,
                lambda x: F.struct(
                    x["pieces"]["kind"].alias("kind"), x["pieces"]["ref"].alias("ref"),
                    x["pieces"]["tokens"].alias("tokens"), x["starts"].cast("long").alias("at"),
                ),
            ).alias("found"),
        )
    )


def format_chat(turns: DataFrame, costs: Costs = Costs(), loss_role: str = "assistant") -> DataFrame:
    """Per conversation: `formatted`, `loss_spans` and `attachments`, from conv_id, turn, role, parts.

    `loss_spans` are (start, length) in code points of `formatted`, ascending, one per turn of
    `loss_role`; `attachments` are (kind, ref, tokens, start), in order of their placeholders;
    `attachment_tokens` is what the placeholders stand for together.

    Turns are dealt by conversation once; places come from a running sum in that order, and the
    collecting step reuses the same distribution. What one task must hold is one conversation, as its
    formatted text is one value.
    """
    in_order = W.partitionBy("conv_id").orderBy("turn", "role", "body", F.to_json("found"))
    length = F.length("header") + F.length("body") + F.lit(len(END))
    rows = (
        flattened(turns, costs)
        .withColumn("n", F.row_number().over(in_order))
        .withColumn("start", F.sum(length).over(in_order.rowsBetween(W.unboundedPreceding, 0)) - length)
    )
    body_at = F.col("start") + F.length("header")
    collected = rows.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "n",
                    F.concat("header", "body", F.lit(END)).alias("piece"),
                    F.when(F.col("role") == loss_role, F.struct(body_at.alias("start"), F.length("body").cast("long").alias("length"))).alias("loss"),
                    F.transform("found", lambda x: x.withField("at", x["at"] + body_at)).alias("found"),
                )
            )
        ).alias("turns")
    )
    return collected.select(
        "conv_id",
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.filter(F.col("turns.loss"), lambda x: x.isNotNull()).alias("loss_spans"),
        F.flatten(F.col("turns.found")).alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["tokens"], F.lit(0))))


def turns_of(formatted: Column) -> Column:
    """(role, text) of every turn, read back from the formatted text; placeholders stay in the text.

    Splitting finds each mark exactly, as no text holds one after escaping.
    """
    pieces = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescaped(_between(p)).alias("text"),
        ),
    )


def _between(piece: Column) -> Column:
    head = F.length(F.substring_index(piece, "\n", 1)) + 1
    return F.substring(piece, head + F.lit(1), F.length(piece) - head - F.lit(len(END)))


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))),
        "",
    )
