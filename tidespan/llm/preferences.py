"""Preference formatting of conversations.

Two conversations, one chosen and one rejected, share a longest common prefix of turns. It is rendered once as the prompt; what
follows is rendered as two completions with their masks: the spans, in code points of the completion, of the texts that a model is
trained on (those of the trained role).

``pair_by_opening`` makes pairs from a table of turns: conversations with the same first turn are paired in the order of their ids, in
blocks, so that an opening which a third of all conversations share is dealt over many tasks. A block of odd size leaves one
conversation without a partner; those left over are dealt again, first within their opening, then, one an opening at most, among all
openings, where nothing is shared and the prompt is empty. So one conversation of a table at most has no partner; it is kept, with nulls
on the rejected side. The chosen one is that with more text of the trained role, the one with the smaller id on ties.

Null roles and texts are rendered as empty and equal each other. Turns are ordered by number, role and text; repeated turns stay.
Turns without a conversation id are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidespan.llm.scratch import Scratch


#: Openings of more than one block up to which their table is broadcast (some 90 bytes a row); a shuffled join serves beyond.
BROADCAST_OPENINGS = 100_000


@dataclass(frozen=True)
class ChatConfig:
    begin: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    trained: str = "assistant"
    block: int = 200  # conversations of one opening in a task


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and turns, an ordered array of (turn, role, text)."""
    rows = turns.filter("conv_id is not null").select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def _deal(rows: DataFrame, step: str, cfg: ChatConfig, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """rows: conv_id, score, opening -> pairs within openings, and the one conversation at most that each opening leaves over."""
    done: list[DataFrame] = []
    while True:
        blocks = scratch.keep(rows.groupBy("opening").agg(F.ceil(F.count("*") / max(2, cfg.block)).alias("blocks")).filter("blocks > 1"), "blocks")
        many = F.broadcast(blocks) if blocks.count() <= BROADCAST_OPENINGS else blocks
        placed = rows.join(many, "opening", "left").withColumn("b", F.coalesce(F.pmod(F.xxhash64("conv_id"), "blocks"), F.lit(0)))
        placed = placed.repartition("opening", "b")  # a join on the opening must not deal the blocks of one opening to one task
        w = Window.partitionBy("opening", "b")
        placed = scratch.keep(placed.withColumn("r", F.row_number().over(w.orderBy("conv_id"))).withColumn("n", F.count("*").over(w)), "placed")
        odd = "r = n and n % 2 = 1"
        pair = F.concat_ws(":", F.lit(f"{step}{len(done)}"), "opening", "b", F.floor((F.col("r") + 1) / 2))
        done.append(placed.filter(f"not ({odd})").select("conv_id", "score", pair.alias("pair")))
        rows = placed.filter(odd).select("conv_id", "score", "opening")
        if blocks.isEmpty():
            return done, rows


def pair_by_opening(convs: DataFrame, cfg: ChatConfig, scratch: Scratch) -> DataFrame:
    """conv_id, score, pair (a key that two conversations share; one conversation at most has a key of its own)."""
    score = F.expr(f"aggregate(turns, 0L, (n, t) -> n + if(t.role = {_quoted(cfg.trained)}, length(t.text), 0))")
    rows = scratch.keep(convs.select("conv_id", F.sha2(F.concat_ws("\x00", F.col("turns")[0]["role"], F.col("turns")[0]["text"]), 256).alias("opening"), score.alias("score")), "openings")
    same, left = _deal(rows, "same", cfg, scratch)
    other, left = _deal(left.withColumn("opening", F.lit("")), "other", cfg, scratch)
    out = left.select("conv_id", "score", F.lit("alone").alias("pair"))
    for pairs in (*same, *other):
        out = out.union(pairs)
    return out


def format_pairs(pairs: DataFrame, cfg: ChatConfig = ChatConfig()) -> DataFrame:
    """pairs: chosen_id, chosen, rejected_id, rejected (turns) -> one row per pair with prompt, completions and masks."""
    begin, end, role = _quoted(cfg.begin), _quoted(cfg.end), _quoted(cfg.trained)
    render = lambda turns: f"array_join(transform({turns}, t -> concat({begin}, t.role, '\\n', t.text, {end})), '')"
    head = len(cfg.begin) + 1
    mask = lambda turns: (
        f"aggregate({turns}, named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int>>)), (a, t) -> named_struct('at', a.at + {head + len(cfg.end)} + length(t.role) + length(t.text), "
        f"'out', if(t.role = {role}, concat(a.out, array(named_struct('start', a.at + {head} + length(t.role), 'end', a.at + {head} + length(t.role) + length(t.text)))), a.out)), a -> a.out)"
    )
    same = "zip_with(slice(chosen, 1, least(size(chosen), size(rejected))), slice(rejected, 1, least(size(chosen), size(rejected))), (a, b) -> a.role = b.role and a.text = b.text)"
    n = F.expr(f"case when rejected is null then greatest(size(chosen) - 1, 0) when array_position({same}, false) > 0 then cast(array_position({same}, false) - 1 as int) else least(size(chosen), size(rejected)) end")
    rows = pairs.withColumn("n_common", n)
    rows = rows.withColumn("_c", F.expr("slice(chosen, n_common + 1, size(chosen))")).withColumn("_r", F.expr("slice(rejected, n_common + 1, size(rejected))"))
    return rows.select(
        "chosen_id", "rejected_id", "n_common", F.expr(render("slice(chosen, 1, n_common)")).alias("prompt"), F.expr(render("_c")).alias("chosen"), F.expr(mask("_c")).alias("chosen_mask"),
        F.expr(render("_r")).alias("rejected"), F.expr(mask("_r")).alias("rejected_mask"),
    )


def preferences(turns: DataFrame, cfg: ChatConfig = ChatConfig()) -> DataFrame:
    """Every conversation of ``turns`` in one formatted pair (one of them alone if their number is odd, its last turn the completion)."""
    scratch = Scratch(turns.sparkSession, "preferences")
    convs = scratch.keep(conversations(turns), "conversations")
    paired = convs.join(pair_by_opening(convs, cfg, scratch), "conv_id").groupBy("pair").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "conv_id", "turns"))).alias("p"))
    return format_pairs(paired.select(F.expr("p[0].conv_id").alias("chosen_id"), F.expr("p[0].turns").alias("chosen"), F.expr("get(p, 1).conv_id").alias("rejected_id"), F.expr("get(p, 1).turns").alias("rejected")), cfg)
