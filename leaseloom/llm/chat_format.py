"""Chat formatting of the messages that ask for a chunk's insights, with Spark expressions only.

Each run of turns of one role is a block `<|role|>ROLE<|text|>TEXT<|next|>TEXT<|end|>`. Inside roles and texts a backslash is doubled and
`<|` becomes `<\\|`, so a mark never occurs in them, whatever they hold, and both are read back exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, TEXT, NEXT, END = "<|role|>", "<|text|>", "<|next|>", "<|end|>"
#: The role whose texts are learned.
LEARNED = "assistant"
_BLOCKS = "array<struct<role:string,texts:array<string>>>"
_SPANS = "struct<at:bigint,spans:array<struct<start:bigint,end:bigint>>>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _blocks(turns: Column) -> Column:
    """Adjacent turns of one role as one block."""

    def merged(done: Column, turn: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["role"] == turn["role"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(fresh))).cast(_BLOCKS)

    return F.aggregate(turns, F.expr(f"cast(array() as {_BLOCKS})"), merged)


def _loss_spans(blocks: Column) -> Column:
    """Start and end, in characters of the formatted text, of each learned text."""
    size = lambda c: F.length(c).cast("bigint")

    def block(done: Column, b: Column) -> Column:
        learned = b["role"] == LEARNED

        def text(inner: Column, t: Column) -> Column:
            span = F.array(F.struct(inner["at"].alias("start"), (inner["at"] + size(t)).alias("end")))
            return F.struct((inner["at"] + size(t) + len(NEXT)).alias("at"),
                            F.when(learned, F.concat(inner["spans"], span)).otherwise(inner["spans"]).alias("spans")).cast(_SPANS)

        begun = F.struct((done["at"] + len(ROLE) + size(b["role"]) + len(TEXT)).alias("at"), done["spans"].alias("spans")).cast(_SPANS)
        ended = F.aggregate(b["texts"], begun, text)
        return F.struct((ended["at"] - len(NEXT) + len(END)).alias("at"), ended["spans"].alias("spans")).cast(_SPANS)

    start = F.expr(f"cast(named_struct('at', 0L, 'spans', array()) as {_SPANS})")
    return F.aggregate(blocks, start, block)["spans"]


def format_chats(messages: DataFrame) -> DataFrame:
    """One text for each chunk's chat. `messages`: chunk_id, turn, role, content; other columns are ignored.

    Returns chunk_id, formatted and loss_spans (start and end of each assistant text in characters of `formatted`). Turns stand in the
    order of `turn`, nulls first; equal turns by role, then content; repeated rows are turns of their own. A null role or content is
    empty; all messages without a chunk_id make one chat. No messages: no rows. A chat is one output row, so its messages meet in one
    group, never more than that chat's own."""
    turn = F.struct(F.col("turn"), escaped(F.col("role")).alias("role"), escaped(F.col("content")).alias("text"))
    chats = messages.groupBy("chunk_id").agg(_blocks(F.sort_array(F.collect_list(turn))).alias("_blocks"))
    piece = lambda b: F.concat(F.lit(ROLE), b["role"], F.lit(TEXT), F.array_join(b["texts"], NEXT), F.lit(END))
    return chats.select(
        "chunk_id", F.array_join(F.transform("_blocks", piece), "").alias("formatted"), _loss_spans(F.col("_blocks")).alias("loss_spans"))


def _cut(text: Column, mark: str) -> Column:
    return F.split(text, "\\Q" + mark + "\\E", -1)


def read_chats(formatted: DataFrame) -> DataFrame:
    """The turns of formatted chats, read back from the text alone, and the texts under the loss mask.

    `formatted`: chunk_id, formatted, loss_spans. Returns chunk_id, turns (array of role, text), learned (array of texts), formatted."""
    blocks = F.filter(_cut(F.col("formatted"), END), lambda b: b != "")
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(
        _cut(_cut(b, TEXT)[1], NEXT),
        lambda t: F.struct(unescaped(F.substring_index(_cut(b, TEXT)[0], ROLE, -1)).alias("role"), unescaped(t).alias("text")))))
    learned = F.transform("loss_spans", lambda s: unescaped(F.substr(
        F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("chunk_id", turns.alias("turns"), learned.alias("learned"), "formatted")
