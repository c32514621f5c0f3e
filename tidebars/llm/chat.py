"""Chat formatting with typed content parts, in DataFrame functions alone.

A turn is <|im_start|>ROLE, a line end, its content, <|im_end|> and a line end. Content parts are visited in
order: a text part stands escaped, other parts stand as placeholders, one per expanded token, and are recorded
as attachments. Escaping puts every backslash as \\0, a line end in a role as \\1, and <| as <\\2|, so no text or
role can hold a control string, and unescaping gives back every text exactly. With the formatted text goes its loss mask, the
spans of the assistant's contents in bytes of UTF-8, and what is learned from is read through that mask alone.

Defined results: a null text or role is empty; a null part list is no parts; turns are in order of turn (null
first), ties by role and text; rows that repeat count as turns; conversations are told apart by conv_id, null
being one of its own; an empty table gives no conversations; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: The role whose contents are learned from.
LEARNED = "assistant"
#: Fields of a content part.
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Patch side in pixels, audio tokens a second, tokens a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256


def escape(x: Column, role: bool = False) -> Column:
    x = F.replace(x, F.lit("\\"), F.lit("\\0"))
    if role:
        x = F.replace(x, F.lit("\n"), F.lit("\\1"))
    return F.replace(x, F.lit("<|"), F.lit("<\\2|"))


def unescape(x: Column) -> Column:
    """Every backslash of an escaped text is followed by its digit, so these can't meet by chance."""
    x = F.replace(F.replace(x, F.lit("\\2"), F.lit("")), F.lit("\\1"), F.lit("\n"))
    return F.replace(x, F.lit("\\0"), F.lit("\\"))


def part_tokens(p: Column) -> Column:
    """Tokens that a part other than text expands to; at least one."""
    size = lambda v: F.coalesce(v, F.lit(0))
    return F.greatest(
        F.lit(1),
        F.when(p["kind"] == "image", F.ceil(size(p["width"]) / PATCH) * F.ceil(size(p["height"]) / PATCH))
        .when(p["kind"] == "audio", F.ceil(size(p["seconds"]) * AUDIO_RATE))
        .when(p["kind"] == "document", size(p["pages"]) * PAGE_TOKENS)
        .otherwise(F.lit(1))
        .cast("int"),
    )


def placeholder(kind: Column) -> Column:
    """A kind the template doesn't know stands as a document."""
    return F.when(kind == "image", "<|image|>").when(kind == "audio", "<|audio|>").otherwise("<|document|>")


def is_text(p: Column) -> Column:
    return F.coalesce(p["kind"], F.lit("text")) == "text"


def visit(parts: Column) -> Column:
    """The content string of an array of parts."""
    one = lambda p: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.repeat(placeholder(p["kind"]), part_tokens(p)))
    return F.array_join(F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), one), "")


def attachments(parts: Column) -> Column:
    """kind, ref and expanded tokens of the parts other than text, in order."""
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: ~is_text(p))
    return F.transform(parts, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))


def text_parts(text: Column) -> Column:
    """A plain text as its only part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask, attachments, expanded_tokens from rows of conv_id, turn, role, parts.

    loss_mask: start and length, in bytes, of each assistant turn's content within formatted, in order.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    content = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), visit(F.col("parts")).alias("content"), attachments(F.col("parts")).alias("files"))
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), content.alias("t"))
    head = F.concat(F.lit(START), escape(F.col("t.role"), True), F.lit("\n"))
    own = own.withColumns({"head": F.octet_length(head).cast("long"), "size": F.octet_length("t.content").cast("long")})
    # running lengths and the list of turns are by conv_id both: one exchange
    before = Window.partitionBy("conv_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("head") + F.col("size") + len(END) + 1).over(before), F.lit(0)) + F.col("head")
    own = own.select("conv_id", F.struct("t", F.struct(start.alias("start"), F.col("size").alias("length")).alias("span")).alias("t"))
    # the order of equal turns is that of their starts, so spans rise
    rows = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    body = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(START), escape(t["t"]["role"], True), F.lit("\n"), t["t"]["content"], F.lit(END + "\n"))), "")
    mask = F.transform(F.filter("turns", lambda t: t["t"]["role"] == LEARNED), lambda t: t["span"])
    files = F.flatten(F.transform("turns", lambda t: t["t"]["files"]))
    return rows.select("conv_id", body.alias("formatted"), mask.alias("loss_mask"), files.alias("attachments"), F.aggregate(files, F.lit(0).cast("long"), lambda n, f: n + f["tokens"]).alias("expanded_tokens"))


def masked(formatted: Column, mask: Column) -> Column:
    """The texts under the mask, unescaped, one a span; bytes are cut, so a span costs its own length."""
    cut = lambda data: F.transform(mask, lambda s: unescape(F.decode(F.substring(data, (s["start"] + 1).cast("int"), s["length"].cast("int")), "utf-8")))
    return F.get(F.transform(F.array(F.encode(formatted, "utf-8")), cut), F.lit(0))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation; placeholders stay in the text."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>", -1), F.lit(2), F.size(F.split(formatted, r"<\|im_start\|>", -1)))

    def turn(x: Column) -> Column:
        head = F.substring_index(x, "\n", 1)
        body = F.substring(x, F.length(head) + 2, F.length(x) - F.length(head) - 1 - len(END) - 1)
        return F.struct(unescape(head).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns and the text under the loss mask."""
    read = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), F.array_join(masked(F.col("formatted"), F.col("loss_mask")), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )
