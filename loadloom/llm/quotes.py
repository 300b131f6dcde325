"""Chat formatting: conversations in reply order, with quotations replaced by links to the messages they quote.

A message's lines begin with as many ``>`` as their quote level.  Lines without are its own text; each run of lines of a
level is a quotation.  Passages (a message's whole own text, its paragraphs and lines) are normalised (white space, case, marks at the
ends) and hashed; each quotation meets, in the same conversation, the earliest message with an equal passage, which must come
before it.  The reply is to the latest of the quoted messages of the lowest level that was found.  Linked quotations go from the
text; lines that quote nothing stay in it.  Threads are ordered by their first message, within a thread by depth, then by
turn; a message that quotes nothing begins a thread, so that plain conversations keep their order.

Scale: originals are reduced to the earliest message of each passage of a conversation before they are joined, so a line that
is repeated in a third of all messages is one row.  Only conversations with a quotation are indexed.  Depths come from pointer
jumping over links, in a number of rounds that grows with the logarithm of the longest chain.  The result is range-sorted; no
conversation has to fit in a task.

Edge cases: null and empty texts are messages without text; repeated rows stay, each a message with a link of its own; a message
does not quote others of its own turn; of equal turns the earliest is the first by role, then by text; null
conversations form one, empty ids another; null turns come before all others and are quoted by none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialise, pieces, table

MARKS = re.compile(r"^((?:[ \t]?>)+)[ \t]?")
#: How a message is written out.
HEAD, MIDDLE, TAIL = "<|", "|>\n", "\n<|end|>\n"


def normalised(passage: str) -> str:
    return re.sub(r"\s+", " ", passage).strip(" .!?…\"'“”").casefold()


def digest(passage: str) -> int | None:
    n = normalised(passage)
    return int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little", signed=True) if n else None


def parse(text: str | None) -> list[tuple[int, str, str]]:
    """Runs of lines of a level, 0 for own text: the level, the lines as they are, and without marks."""
    out: list[tuple[int, list[str], list[str]]] = []
    for line in (text or "").split("\n"):
        m = MARKS.match(line)
        here = m[1].count(">") if m else 0
        if not out or out[-1][0] != here:
            out.append((here, [], []))
        out[-1][1].append(line)
        out[-1][2].append(line[m.end() :] if m else line)
    return [(n, "\n".join(x), "\n".join(y)) for n, x, y in out]


def own_text(parts: list[tuple[int, str, str]]) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x for n, x, _ in parts if not n)).strip("\n")


def hashes(quotation: str) -> list[int]:
    """Of a quotation as a whole and of its lines: mail programs break and shorten them."""
    return [h for x in dict.fromkeys([quotation, *quotation.split("\n")]) if (h := digest(x)) is not None]


def passages(own: str) -> set[int]:
    """Hashes of a text, its paragraphs and its lines."""
    return {h for x in (own, *own.split("\n\n"), *own.split("\n")) if (h := digest(x)) is not None}


def _parsed(df: DataFrame) -> DataFrame:
    schema = "_conv string, _turn long, _role string, _tie long, _parts array<struct<level: int, text: string, hashes: array<long>>>, _passages array<long>"
    kind = pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string()), ("hashes", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in itertools.chain.from_iterable(pieces(b, 4) for b in batches):
            done = [parse(t.as_py()) for t in batch.column(4)]
            parts = [[{"level": n, "text": x, "hashes": hashes(y) if n else []} for n, x, y in d] for d in done]
            own = [sorted(passages(own_text(d))) for d in done]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(parts, kind), pa.array(own, pa.list_(pa.int64()))], names=["_conv", "_turn", "_role", "_tie", "_parts", "_passages"])

    return arrow_map(df, run, schema)


def reply_order(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each of ``df``: conversation, turn, role, ``text`` without linked quotations, ``n_quotes``, ``n_linked``,
    ``reply_to`` (a turn or null), ``thread`` (the first turn of the thread), ``depth`` and ``formatted``, sorted in reply order."""
    kind = dict(df.dtypes)[conv_col]
    role, text = F.col(role_col).cast("string"), F.col(text_col).cast("string")
    # Ties between messages of a turn go by role and a hash of the text; equal rows beyond that are told apart by ``_msg``.
    messages = df.select(F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("_conv"), F.col(turn_col).cast("long").alias("_turn"), role.alias("_role"), F.xxhash64(text).alias("_tie"), text.alias("_text"))
    parsed = materialise(_parsed(messages).withColumn("_msg", F.monotonically_increasing_id()), "messages")

    quotations = parsed.where(F.exists("_parts", lambda p: p["level"] > 0)).select("_msg", "_conv", "_turn", F.posexplode("_parts").alias("_part", "p")).where("p.level > 0")
    quoting = quotations.select("_msg", "_conv", "_turn", "_part", "p.level", F.explode("p.hashes").alias("hash"))
    wanted = quoting.select("_conv", "hash").distinct()
    # Reduced before the join: the earliest message of each passage, by task and then in all.
    originals = parsed.join(wanted.select("_conv").distinct(), "_conv", "left_semi").where(F.col("_turn").isNotNull()).select("_conv", F.struct("_turn", "_role", "_tie", "_msg").alias("_m"), F.explode("_passages").alias("hash"))
    originals = originals.groupBy("_conv", "hash").agg(F.min("_m").alias("_first")).join(wanted, ["_conv", "hash"], "left_semi")
    met = materialise(quoting.join(originals, ["_conv", "hash"]).where(F.col("_first._turn") < F.col("_turn")), "met")
    found = F.min(F.struct("level", (-F.col("_first._turn")).alias("t"), F.col("_first._role").alias("r"), F.col("_first._tie").alias("h"), F.col("_first._msg").alias("to")))
    links = materialise(met.groupBy("_msg").agg(found.alias("f"), F.collect_set("_part").alias("_linked")).select("_msg", F.col("f.to").alias("_to"), (-F.col("f.t")).alias("_reply"), "_linked"), "links")

    # ``_up`` jumps ``_steps`` links up; those at the top no longer move.
    chains = links.select("_msg", F.col("_to").alias("_up"), F.lit(1).alias("_steps"))
    while True:
        above = chains.select(F.col("_msg").alias("_up"), F.col("_up").alias("_next"), F.col("_steps").alias("_more"))
        moved = chains.join(above, "_up", "left")
        moved = materialise(moved.select("_msg", F.coalesce("_next", "_up").alias("_up"), (F.col("_steps") + F.coalesce("_more", F.lit(0))).alias("_steps"), F.col("_next").isNotNull().alias("_moved")), "chains")
        done = moved.where("_moved").limit(1).count() == 0
        chains = moved.drop("_moved")
        if done:
            break

    tops = chains.select("_up").distinct().join(parsed.select(F.col("_msg").alias("_up"), F.struct("_turn", "_role", "_tie", "_msg").alias("_top")), "_up")
    placed = parsed.drop("_passages").join(links.join(chains.join(tops, "_up"), "_msg"), "_msg", "left")
    linked = F.coalesce("_linked", F.array().cast("array<int>"))
    kept = F.filter("_parts", lambda p, i: (p["level"] == 0) | ~F.array_contains(linked, i))
    own = F.regexp_replace(F.regexp_replace(F.array_join(F.transform(kept, lambda p: p["text"]), "\n"), "\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")
    top = F.coalesce("_top", F.struct("_turn", "_role", "_tie", "_msg"))
    out = placed.withColumn("_own", own).select(
        F.when(F.col("_conv") != "", F.expr("substring(_conv, 2)")).cast(kind).alias(conv_col),
        top["_turn"].alias("thread"),
        F.coalesce("_steps", F.lit(0)).alias("depth"),
        F.col("_turn").alias(turn_col),
        F.col("_role").alias(role_col),
        F.col("_own").alias("text"),
        F.size(F.filter("_parts", lambda p: p["level"] > 0)).alias("n_quotes"),
        F.size(linked).alias("n_linked"),
        F.col("_reply").alias("reply_to"),
        F.concat(F.lit(HEAD), F.coalesce("_role", F.lit("")), F.lit(MIDDLE), F.col("_own"), F.lit(TAIL)).alias("formatted"),
        top.alias("_of"),
    )
    keys = [conv_col, "_of", "depth", turn_col, role_col, "text"]
    return out.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_of")


def op8_reply_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(table(spark, sf_dir, "conversations"))
