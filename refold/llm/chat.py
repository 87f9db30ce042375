"""Chat formatting by perspective rotation.

Every dialogue is rendered once for each of its participants: that speaker's turns become the
assistant's, all others are named users, and the loss falls on the assistant's turns only. Context
roles (system) speak in every rendering and have none of their own.

A dialogue is one row for each participant, part 0, as long as its turns come to SIZE code points (each
with its role and 32 more) or less. A longer one doesn't fit a row that Spark can be trusted with: it
goes on in further parts of that size, and each of them begins with the context turns of part 0. So no
task holds more than twice SIZE and one turn, however many turns a conversation has.

Which dialogues are long is known from sums by conversation, kept as at most SIEVE hashes. Their turns
are dealt by ranges of the order below, so the places of their turns come from sums within a range and
sums of whole ranges; all others are not touched by this. A dialogue is then rendered by a task that
streams sorted turns and holds one part at a time.

Turns follow by number (null first), role, MD5 of the text. A text's `<|` is written `<\\|`, and one
backslash more goes where some stand between already, so no text can open or close a turn and the text
can be had back. In the head line a role's backslashes are doubled, its line feeds are written `\\n` and
its `<|` as in texts; `participant` is the role as it is.

`loss_spans` lists start:end of what is learned, in code points of `text`, ends exclusive: each of the
assistant's turns with its end mark, without the line feed after it.

Edge cases: null texts are empty turns; null roles are one speaker, UNNAMED; repeated rows are repeated
turns; null conv_ids are one conversation; one without participants gives no row; an empty table gives
no rows; columns beyond conv_id, turn, role and text are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, settle, small_batches

SIZE, SIEVE = 4 << 20, 1 << 20
UNNAMED = "unnamed"
CONTEXT = ("system",)
START, END = "<|im_start|>", "<|im_end|>"
ORDER = ("turn", "role", "tie")
#: What a row of a part is: a context turn of part 0, a turn, a participant.
SHARED, OWN, SPEAKER = 0, 1, 2
_MARK = re.compile(r"<(\\*)\|")


def perspectives(turns: DataFrame, context: tuple[str, ...] = CONTEXT, size: int = SIZE) -> DataFrame:
    """conv_id, part, participant, n_turns, text, loss_spans."""
    spark = turns.sparkSession
    small_batches(spark)
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(UNNAMED)), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.md5(text).alias("tie"))
    speakers = rows.where(~F.col("role").isin(*context)).select("conv_id", "role").distinct()
    sifted = F.pmod(F.xxhash64("conv_id"), F.lit(SIEVE)).alias("sieve")
    weight = (F.length("role") + F.length("text") + 32).cast("long")
    sums = rows.groupBy("conv_id").agg(F.sum(weight).alias("size"))
    long = settle(sums.where(F.col("size") > size).select(sifted).distinct(), "long")  # at most SIEVE rows
    kind = lambda df, k, part: df.select("conv_id", part.alias("part"), F.lit(k).alias("kind"), *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("tie", "string"), ("text", "string"))))
    first = F.lit(0).cast("long")
    if not long.take(1):
        given = kind(rows, OWN, first).unionByName(kind(speakers, SPEAKER, first))
    else:
        split = lambda df, how: df.withColumn("sieve", sifted).join(F.broadcast(long), "sieve", how).drop("sieve")
        parted = _parted(split(rows, "left_semi").withColumn("size", weight), size)
        parts = settle(parted.select("conv_id", "part").distinct(), "parts").select(F.col("conv_id").alias("conv"), "part")
        each = lambda df, later: df.join(parts.where("part > 0") if later else parts, F.col("conv_id").eqNullSafe(F.col("conv")))
        lead = parted.where((F.col("part") == 0) & F.col("role").isin(*context)).drop("part")
        given = (
            kind(split(rows, "left_anti"), OWN, first)
            .unionByName(kind(split(speakers, "left_anti"), SPEAKER, first))
            .unionByName(kind(parted, OWN, F.col("part")))
            .unionByName(kind(each(split(speakers, "left_semi"), False), SPEAKER, F.col("part")))
            .unionByName(kind(each(lead, True), SHARED, F.col("part")))
        )
    dealt = given.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "kind", *ORDER)
    name = turns.schema["conv_id"].dataType.simpleString()
    return dealt.select("conv_id", "part", "kind", "role", "text").mapInArrow(_renderer(context), f"conv_id {name}, part long, participant string, n_turns long, text string, loss_spans string")


def _parted(rows: DataFrame, size: int) -> DataFrame:
    """Turns (conv_id, ORDER, text, size) with their part, by the sum of sizes before them."""
    marked = settle(rows.withColumn("salt", F.monotonically_increasing_id()), "turns")
    dealt = marked.repartitionByRange(parts_for(marked), "conv_id", *ORDER, "salt")
    dealt = settle(dealt.withColumn("range", F.spark_partition_id()), "ranges")
    ranges = dealt.groupBy("conv_id", "range").agg(F.sum("size").alias("all"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("all").over(upto(Window.partitionBy("conv_id").orderBy("range"))), F.lit(0))  # a row for each range
    base = ranges.select(F.col("conv_id").alias("conv"), F.col("range").alias("at"), before.alias("before"))
    within = F.coalesce(F.sum("size").over(upto(Window.partitionBy("conv_id", "range").orderBy(*ORDER, "salt"))), F.lit(0))
    both = dealt.withColumn("within", within).join(base, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("range") == F.col("at")))
    part = F.floor((F.col("before") + F.col("within")) / size).cast("long")
    return settle(both.select("conv_id", *ORDER, "text", part.alias("part")), "parted")


def written(text: str) -> str:
    """A text without marks of turns."""
    return _MARK.sub(r"<\1\\|", text)


def named(role: str) -> str:
    """A role as part of a head line."""
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("<|", "<\\|")


def render(turns: list[tuple[str, str]], speaker: str, context: tuple[str, ...]) -> tuple[str, str]:
    """(text, loss spans) of (role, text) turns as one speaker has them."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head = "assistant" if role == speaker else role if role in context else f"user name={named(role)}"
        head, body = f"{START}{head}\n", f"{written(text)}{END}\n"
        out += (head, body)
        if role == speaker:
            spans.append(f"{at + len(head)}:{at + len(head) + len(body) - 1}")
        at += len(head) + len(body)
    return "".join(out), ",".join(spans)


def _renderer(context: tuple[str, ...], batch: int = 8 << 20):
    names = ["conv_id", "part", "participant", "n_turns", "text", "loss_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out, size = None, [], [], 0
        for b in batches:
            kind_of = b.schema.field("conv_id").type
            for conv, part, kind, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (conv, part):
                    key, held = (conv, part), []
                if kind != SPEAKER:
                    held.append((role, text))
                    continue
                shown, spans = render(held, role, context)
                out.append((conv, part, role, len(held), shown, spans))
                size += len(shown)
                if size > batch or len(out) >= 10_000:
                    yield _batch(out, kind_of, names)
                    out, size = [], 0
            if out:
                yield _batch(out, kind_of, names)
                out, size = [], 0

    return run


def _batch(rows: list[tuple], conv: pa.DataType, names: list[str]) -> pa.RecordBatch:
    types = (conv, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
