"""Chat formatting from an event log: order, fold, render, and read back.

Every message becomes one segment ``<s>[role]\\ntext</s>\\n``; a conversation is its segments end to end. In roles and
texts a backslash is put behind every ``<``, ``[``, ``]`` and backslash, so that no control string
(``<s>``, ``</s>``, ``[INST]``, ``<|...|>`` and the like) survives in them, and taking it out again restores them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, NAMED, CLOSE = "<s>[", "]\n", "</s>\n"
_special = re.compile(r"[<\[\]\\]")
_escaped = re.compile(r"([<\[\]\\])\\")
_named = re.compile(r"\](?!\\)")
#: Code points of results that leave a task at a time.
FLUSH = 4 << 20


def escape(text: str) -> str:
    return _special.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A rendered message, and where its escaped text starts and ends."""
    head = OPEN + escape(role) + NAMED
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(rendered: str) -> Iterator[tuple[str, str]]:
    """``(role, text)`` of the messages in rendered text; anything else is an error."""
    at = 0
    while at < len(rendered):
        end = rendered.find(CLOSE, at)
        name = _named.search(rendered, at + len(OPEN))
        if end < 0 or not rendered.startswith(OPEN, at) or not name or not rendered.startswith(NAMED, name.start()) or name.start() > end:
            raise ValueError(f"no message at position {at}")
        yield unescape(rendered[at + len(OPEN) : name.start()]), unescape(rendered[name.start() + len(NAMED) : end])
        at = end + len(CLOSE)


def ordered_log(events: DataFrame, message_col: str | None = None) -> DataFrame:
    """``(conv, place, message, seq, kind, role, text)`` of a log, ``place`` being the first ``seq`` of the message.

    ``events`` has ``conv_id``, ``seq``, ``role``, ``text`` and perhaps ``kind`` and ``message_col``. Without a message
    (or where it is null) an event is a message of its own.
    """
    kind = F.col("kind") if "kind" in events.columns else F.lit("message")
    message = F.col(message_col).cast("string") if message_col else F.lit(None).cast("string")
    log = events.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("seq").cast("long").alias("seq"), message.alias("message"), kind.alias("kind"),
        F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    if not message_col:
        return log.withColumn("place", F.col("seq"))
    own = log.filter("message is null").withColumn("place", F.col("seq"))
    parts = log.filter("message is not null")
    first = parts.groupBy(F.col("conv").alias("c"), F.col("message").alias("m")).agg(F.min("seq").alias("place"))
    parts = parts.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("message") == F.col("m"))).drop("c", "m")
    return own.unionByName(parts)


def as_log(turns: DataFrame) -> DataFrame:
    """Finished ``(conv_id, turn, role, text)`` as the event log ``(conv_id, seq, message, kind, role, text)`` that ends with them.

    By a hash of its place, a turn is a plain message, an empty one that deltas fill, a draft with an edit, or a draft that is
    regenerated by deltas. Turns of the same number follow each other by role and text. Null texts are
    empty; turns without a number are plain messages, and come first.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    same = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = rows.withColumn("message", F.concat_ws(":", F.coalesce(F.col("turn").cast("string"), F.lit("none")), F.lpad(same.cast("string"), 10, "0")))
    third = F.floor(F.length("text") / 3).cast("int")
    parts = [F.substring("text", F.lit(1), third), F.substring("text", third + 1, third), F.substring("text", 2 * third + 1, F.length("text"))]
    draft = F.concat(F.lit("<draft> "), F.substring("text", F.lit(1), third))

    def event(k: int, kind: str, said: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), said.alias("said"))

    deltas = [event(k, "delta", parts[k - 1]) for k in (1, 2, 3)]
    ways = [
        [event(0, "message", F.col("text"))],
        [event(0, "message", F.lit("")), *deltas],
        [event(0, "message", draft), event(1, "edit", F.col("text"))],
        [event(0, "message", draft), event(1, "regenerate", parts[0]), *deltas[1:]],
    ]
    way = F.when(F.col("turn").isNull(), 0).otherwise(F.pmod(F.xxhash64("conv_id", "message"), F.lit(len(ways))))
    events = F.get(F.array(*[F.array(*w) for w in ways]), way.cast("int"))
    rows = rows.select("conv_id", "turn", "message", "role", F.explode(events).alias("e"))
    return rows.select("conv_id", (F.col("turn") * 4 + F.col("e.k")).alias("seq"), "message", "e.kind", "role", F.col("e.said").alias("text"))


def render(events: DataFrame, message_col: str | None = None) -> DataFrame:
    """Fold a log into final messages and render them: one row per message.

    ``(conv, place, message, role, text, segment, loss_start, loss_end)``. In order of ``seq`` a ``message``, ``edit`` or
    ``regenerate`` event sets the text of its message (a regeneration starts it anew, and deltas follow), a
    ``delta`` adds to it, and a ``delete`` takes the message out until it is set again. Events of other kinds are ignored.
    Messages stand where their first event did. Ties in ``seq`` go by kind (setting before adding, deletion last), role
    and text. Null texts are empty, null roles too; the first role of a message counts. ``loss_*`` is the part of the
    segment under the loss mask: the text of assistants, else empty. Messages are dealt out one by one, so that
    a long conversation is rendered by many tasks; only the deltas of one message need to be held together.
    """
    log = ordered_log(events, message_col).withColumn(
        "step", F.when(F.col("kind").isin("message", "edit", "regenerate"), 0).when(F.col("kind") == "delta", 1).when(F.col("kind") == "delete", 2)
    ).filter("step is not null")
    order = ["conv", "place", "message", "seq", "step", "role", "text"]
    spread = log.repartition("conv", "place", "message").sortWithinPartitions(*order)
    names = ["conv", "place", "message", "role", "text", "segment", "loss_start", "loss_end"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def finished(key: tuple, role: str, text: list[str]) -> tuple:
        whole = "".join(text)
        done, start, end = segment(role, whole)
        return (*key, role, whole, done, start, end if role == "assistant" else start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, role, text, out, size = None, "", None, [], 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for conv, place, message, step, who, said in zip(*(batch.column(c) for c in ("conv", "place", "message", "step", "role", "text"))):
                now, step = (conv.as_py(), place.as_py(), message.as_py()), step.as_py()
                if now != key or now[2] is None:
                    if text is not None:
                        out.append(finished(key, role, text))
                        size += len(out[-1][5])
                        if size >= FLUSH:
                            yield flush()
                            size = 0
                    key, role, text = now, who.as_py() or "", None
                role = role or who.as_py() or ""
                if step == 0:
                    text = [said.as_py()]
                elif step == 1:
                    text = [] if text is None else text
                    text.append(said.as_py())
                else:
                    text = None
        if text is not None:
            out.append(finished(key, role, text))
        if out:
            yield flush()

    return spread.mapInArrow(run, "conv long, place long, message string, role string, text string, segment string, loss_start long, loss_end long")


def digests(rendered: DataFrame) -> DataFrame:
    """What each conversation says, read back from its segments alone: one row per conversation.

    ``(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``. The segments of a conversation stream by in
    order, and digests take them one at a time: a conversation of any length needs the memory of one message. A
    digest of all its text in order is the one thing that a conversation can't share among tasks.
    """
    rows = rendered.select("conv", "place", "message", "role", "segment", "loss_start", "loss_end")
    rows = rows.repartition("conv").sortWithinPartitions("conv", "place", "message", "role", "segment")
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, open_ = None, False
        turns = loss = None
        n = chars = formatted = 0

        def row() -> tuple:
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

        for batch in batches:
            out = []
            for c, text, start, end in zip(*(batch.column(x).to_pylist() for x in ("conv", "segment", "loss_start", "loss_end"))):
                if not open_ or c != conv:
                    if open_:
                        out.append(row())
                    conv, open_, turns, loss, n, chars, formatted = c, True, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, said in parse(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                masked = unescape(text[start:end])
                chars += len(masked)
                loss.update(masked.encode())
                formatted += len(text)
            if out:
                yield _batch(out, names)
        if open_:
            yield _batch([row()], names)

    return rows.mapInArrow(run, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
