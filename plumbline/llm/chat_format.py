"""Chat formatting with typed content parts, in DataFrame functions only.

A conversation becomes one string. Every turn is

    <|turn|> role <|body|> content <|end|>          (without the blanks)

with ``<|train|>`` in place of ``<|body|>`` where the content is under the loss mask. A turn's
content is the flattening of its parts: text is escaped, and an image, audio or document part
becomes ``<|kind:n|>``, where n counts the conversation's attachments from 0.

Control strings inside texts (and roles) are escaped, adjacent text parts as the one text that
they make: a backslash is doubled, and one is put after the first character of ``<|``, ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``. No control
string of the template can thus occur inside a text, and dropping each backslash that starts a
pair restores the text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, TRAIN, END = "<|turn|>", "<|body|>", "<|train|>", "<|end|>"
CONTROL = r"([<\[])(\||/?s>|/?INST\])"
#: Tokens an attachment expands to: a fixed part and one for each unit (image tiles, seconds of audio, pages).
EXPANSION = {"image": (85, 170), "audio": (2, 25), "document": (4, 600)}
PART = "struct<kind: string, text: string, ref: string, units: bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"\\([\s\S])", "$1")).otherwise(text)


def format_conversations(turns: DataFrame, train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One formatted string per conversation.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and either ``parts`` (an array of
    ``struct<kind, text, ref, units>``) or ``text``, which counts as a single text part.

    Returns ``conv_id``, ``n_turns``, ``formatted``, ``loss_spans`` (code-point offsets
    ``struct<start, end>`` in ``formatted``, in order), ``attachments``
    (``struct<ordinal, turn_no, kind, ref, tokens>``) and ``attachment_tokens``.

    Null roles, texts and part lists count as empty; rows with a null ``conv_id`` form one
    conversation; an unknown part kind becomes an attachment without tokens. Turns are ordered
    by ``turn`` (nulls first), ties by role and content, so repeated rows give repeated turns.
    Very long texts are formatted whole. Other columns are ignored, whatever their names. An empty table gives no rows. The rows of a conversation meet in
    one task, because its string is one value; there is one shuffle.
    """
    typed = "parts" in turns.columns
    if typed:
        parts = turns["parts"].cast(f"array<{PART}>")
    else:
        parts = F.array(F.struct(F.lit("text").alias("kind"), turns["text"].alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))
    rows = turns.select(
        turns["conv_id"].alias("conv_id"),
        turns["turn"].alias("turn"),
        F.coalesce(turns["role"], F.lit("")).alias("role"),
        F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()).alias("parts"),
    )
    is_text = lambda p: F.coalesce(p["kind"], F.lit("text")) == "text"
    tokens = lambda p: F.coalesce(*[F.when(p["kind"] == k, F.lit(a) + F.lit(b) * F.coalesce(p["units"], F.lit(1))) for k, (a, b) in EXPANSION.items()], F.lit(0)).cast("bigint")
    # The visit of a turn: text stretches and attachments in order; attachments keep their place in the turn.
    rows = rows.withColumn("media", F.filter("parts", lambda p: ~is_text(p)))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "parts", "media"))).alias("turns"))
    before = F.transform(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: F.when(F.exists("turns", lambda t: F.size(t["media"]) > 0), F.aggregate(F.slice("turns", 1, i), F.lit(0), lambda n, t: n + F.size(t["media"]))).otherwise(0),
    )

    def content(turn: Column, first: Column) -> Column:
        parts, text = turn["parts"], lambda p: F.coalesce(p["text"], F.lit(""))
        if not typed:
            return F.array_join(F.transform(parts, lambda p: escape(text(p))), "")
        # Stretches of adjacent text parts are escaped as one text; attachments are numbered in order.
        at = F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: i < F.size(parts))
        said = lambda i: F.get(parts, i).isNotNull() & is_text(F.get(parts, i))
        begins, ends = F.filter(at, lambda i: said(i) & ~said(i - 1)), F.filter(at, lambda i: said(i) & ~said(i + 1))
        texts = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("at"), escape(F.array_join(F.transform(F.slice(parts, a + 1, b - a + 1), text), "")).alias("shown")))
        media = F.transform(F.filter(at, lambda i: ~said(i)), lambda i, k: F.struct(i.alias("at"), F.concat(F.lit("<|"), escape(F.get(parts, i)["kind"]), F.lit(":"), (first + k).cast("string"), F.lit("|>")).alias("shown")))
        return F.array_join(F.transform(F.array_sort(F.concat(texts, media)), lambda x: x["shown"]), "")

    visited = grouped.withColumn("first", before).select(
        "conv_id",
        F.transform(
            F.arrays_zip("turns", "first"),
            lambda z, i: F.struct(
                F.concat(F.lit(TURN), escape(z["turns"]["role"]), F.when(z["turns"]["role"].isin(*train_roles), TRAIN).otherwise(BODY)).alias("head"),
                content(z["turns"], z["first"]).alias("body"),
                z["turns"]["role"].isin(*train_roles).alias("train"),
                F.transform(z["turns"]["media"], lambda m, k: F.struct((z["first"] + k).alias("ordinal"), i.alias("turn_no"), m["kind"].alias("kind"), m["ref"].alias("ref"), tokens(m).alias("tokens"))).alias("attachments"),
            ),
        ).alias("t"),
    )
    return visited.select(
        "conv_id",
        F.size("t").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.transform("t", lambda t: F.struct(F.length(t["head"]).cast("bigint").alias("head"), F.length(t["body"]).cast("bigint").alias("body"), t["train"].alias("train"))).alias("lengths"),
        F.flatten(F.transform("t", lambda t: t["attachments"])).alias("attachments"),
    ).select(
        "conv_id",
        "n_turns",
        "formatted",
        _spans(F.col("lengths")).alias("loss_spans"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def _spans(lengths: Column) -> Column:
    """Trained bodies as offsets: a running sum over the turns' lengths."""
    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans"))
    step = lambda acc, t: F.struct(
        (acc["at"] + t["head"] + t["body"] + F.lit(len(END))).alias("at"),
        F.when(t["train"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["head"]).alias("start"), (acc["at"] + t["head"] + t["body"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
    )
    return F.aggregate(lengths, start, step, lambda acc: acc["spans"])


def parse_turns(formatted: Column) -> Column:
    """Read a formatted string back: ``array<struct<role, text, trained>>``, texts unescaped."""
    turns = F.filter(F.split(formatted, r"<\|end\|>"), lambda t: F.startswith(t, F.lit(TURN)))
    trained = lambda t: F.contains(t, F.lit(TRAIN))
    halves = lambda t: F.split(F.substring(t, len(TURN) + 1, 2_147_483_647), r"<\|(?:body|train)\|>")
    return F.transform(turns, lambda t: F.struct(unescape(halves(t)[0]).alias("role"), unescape(halves(t)[1]).alias("text"), trained(t).alias("trained")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted strings hold, parsed from the strings alone.

    The loss mask is read from the marks in the string (``<|train|>``), in one pass over the turns;
    ``loss_spans`` says the same as offsets.
    """
    masked = F.array_join(F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: t["text"]), "")
    return formatted.withColumn("turns", parse_turns(F.col("formatted"))).withColumn("loss", masked).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
