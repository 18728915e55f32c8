"""Relational chat formatting: turns are collected per conversation, sorted, merged where adjacent
turns have one role, and joined into one marked string, with Spark expressions only.

Output of format_conversations: conv_id, formatted, loss_mask (run lengths over formatted: the runs
tile it, and those with loss=true are the assistants' texts). A block is
``<|role|>`` text (``<|part|>`` text)* ``<|end|>``; the parts of a block are its merged turns.
In roles and texts & < [ | are written as &amp; &lt; &lb; &bar; so that no control string of this or
of the common bracketed templates can occur there; unescape() restores them.

Null text or role: empty. Turns order by turn (nulls first), then role, then text; repeated rows are repeated
turns. A null conv_id is a conversation of its own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"), ("|", "&bar;"))
OPEN, SHUT, PART, END = "<|", "|>", "<|part|>", "<|end|>"


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def format_conversations(turns: DataFrame, learn_role: str = "assistant") -> DataFrame:
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    n = F.size("turns")
    role_at = lambda i: F.element_at("turns", i)["role"]
    places = F.sequence(F.lit(1), n)
    starts = F.filter(places, lambda i: F.when(i == 1, True).otherwise(role_at(i) != role_at(F.greatest(i - 1, F.lit(1)))))
    grouped = grouped.withColumn("starts", starts)
    blocks = F.transform("starts", lambda s, k: F.struct(
        role_at(s).alias("role"),
        F.transform(
            F.slice("turns", s, F.coalesce(F.get("starts", k + 1), n + 1) - s),
            lambda t: escape(t["text"])).alias("parts")))
    grouped = grouped.withColumn("blocks", blocks)
    rendered = F.array_join(F.transform("blocks", lambda b: F.concat(
        F.lit(OPEN), escape(b["role"]), F.lit(SHUT), F.array_join(b["parts"], PART), F.lit(END))), "")
    run = lambda length, loss: F.struct(length.cast("long").alias("length"), loss.alias("loss"))
    mask = F.flatten(F.transform("blocks", lambda b: F.concat(
        F.array(run(F.length(escape(b["role"])) + len(OPEN + SHUT), F.lit(False))),
        F.flatten(F.transform(b["parts"], lambda p, k: F.array(
            run(F.length(p), b["role"] == learn_role),
            run(F.when(k + 1 < F.size(b["parts"]), len(PART)).otherwise(len(END)), F.lit(False))))))))
    return grouped.select("conv_id", rendered.alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text, as they were), loss_text: parsed from the formatted string and its mask.

    Work grows with the length of the string: each block is parsed once, and the mask's runs are laid beside the characters.
    """
    blocks = F.transform(F.filter(F.split("formatted", r"<\|end\|>"), lambda b: b != ""), _parsed)
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(b["parts"], lambda p: F.struct(b["role"].alias("role"), unescape(p).alias("text")))))
    masked = F.flatten(F.transform("loss_mask", lambda r: F.array_repeat(r["loss"], r["length"].cast("int"))))
    both = F.arrays_zip(F.split("formatted", "").alias("char"), masked.alias("loss"))
    lost = F.array_join(F.transform(F.filter(both, lambda z: F.coalesce(z["loss"], F.lit(False))), lambda z: z["char"]), "")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), unescape(lost).alias("loss_text"))


def _parsed(block: Column) -> Column:
    """role and parts of a block without its end mark."""
    role = F.substring_index(F.substring(block, len(OPEN) + 1, 1 << 30), SHUT, 1)
    body = F.substring(block, F.length(role) + len(OPEN + SHUT) + 1, F.length(block))
    return F.struct(unescape(role).alias("role"), F.split(body, r"<\|part\|>").alias("parts"))


def digests(formatted: DataFrame) -> DataFrame:
    back = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
