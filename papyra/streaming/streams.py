"""Streams of tokens and events."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class FrameParser:
    """Server-sent events from chunks cut anywhere: what is not ended waits for more."""

    def __init__(self, waiting: str = ""):
        self.waiting = waiting

    def push(self, chunk: str, final: bool = False) -> list[tuple[str, str]]:
        self.waiting += chunk.replace("\r\n", "\n")
        parts = self.waiting.split("\n\n")
        self.waiting = "" if final else parts.pop()
        out = []
        for raw in parts:
            event, data = "message", []
            for line in raw.split("\n"):
                if line.startswith("event:"):
                    event = line[6:].strip() or "message"
                elif line.startswith("data:"):
                    data.append(line[5:].lstrip())
            if data:
                out.append((event, "\n".join(data)))
        return out


class Reply:
    """A reply from deltas and snapshots; emit() gives what was not emitted yet."""

    def __init__(self, text: str = "", emitted: int = 0):
        self.text, self.emitted = text, emitted

    def apply(self, record: dict) -> None:
        if record.get("op") == "SET" or "snapshot" in record:
            self.text = str(record.get("snapshot", record.get("value", "")))
        elif record.get("op") == "BATCH":
            for x in record.get("value", []):
                self.apply(x)
        else:
            self.text += str(record.get("value", record.get("delta", "")))

    def emit(self) -> str:
        new = self.text[self.emitted :]
        self.emitted = max(self.emitted, len(self.text))
        return new


def split_thinking(chunks: list[str]) -> tuple[str, str]:
    """(body, reasoning) of chunks with <think> tags that chunks may cut."""
    body, inner = [], []
    rest, inside = "".join(chunks), False
    while rest:
        tag = "</think>" if inside else "<think>"
        before, found, rest = rest.partition(tag)
        (inner if inside else body).append(before)
        inside = inside != bool(found)
    return "".join(body), "".join(inner)


def frames(chunks: DataFrame) -> DataFrame:
    """Streaming: (stream, seq, chunk) -> (stream, event, data); the unfinished rest is a stream's state."""
    schema = "stream string, event string, data string"

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parser = FrameParser(state.get[0] if state.exists else "")
        out = []
        for batch in rows:
            for chunk in batch.sort_values("seq")["chunk"]:
                out += [(key[0], *f) for f in parser.push(chunk)]
        state.update((parser.waiting,))
        yield pd.DataFrame(out, columns=["stream", "event", "data"])

    return chunks.groupBy("stream").applyInPandasWithState(step, schema, "waiting string", "append", GroupStateTimeout.NoTimeout)


def frames_of_batch(chunks: DataFrame) -> DataFrame:
    """The same over a table: each stream's chunks in order."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parser, out = FrameParser(), []
        for i, chunk in enumerate(rows.sort_values("seq")["chunk"]):
            out += parser.push(chunk, final=i == len(rows) - 1)
        return pd.DataFrame([(rows["stream"].iloc[0], *f) for f in out], columns=["stream", "event", "data"])

    return chunks.groupBy("stream").applyInPandas(run, "stream string, event string, data string")


def emissions(events: DataFrame) -> DataFrame:
    """Streaming: (stream, seq, record as JSON) -> (stream, seq, delta): of each record what was not emitted before.

    A delta is emitted as it is, of a snapshot only the part beyond what was; the state is a
    reply's text and how much of it went out.
    """
    schema = "stream string, seq long, delta string"

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reply, out = Reply(*state.get) if state.exists else Reply(), []
        for seq, record in _in_order(rows, "record"):
            try:
                reply.apply(json.loads(record))
            except (ValueError, TypeError):
                continue
            if new := reply.emit():
                out.append((key[0], seq, new))
        state.update((reply.text, reply.emitted))
        yield pd.DataFrame(out, columns=["stream", "seq", "delta"])

    return events.groupBy("stream").applyInPandasWithState(step, schema, "text string, emitted long", "append", GroupStateTimeout.NoTimeout)


def _in_order(rows: Iterator[pd.DataFrame], column: str) -> list[tuple]:
    return sorted((int(seq), x) for batch in rows for seq, x in zip(batch["seq"], batch[column], strict=True))


#: Where a completion's event keeps reasoning.
REASONING_KEYS = ["reasoning_content", "reasoning", "thinking", "reasoning_delta", "thinking_delta", "analysis_delta"]


def completion_parts(event: dict) -> tuple[str, str]:
    """(text, reasoning) of one event of a completion, whatever dialect it is in."""
    def joined(x) -> str:
        if isinstance(x, list):
            return "".join(joined(i) for i in x)
        return joined(x.get("text", x.get("content", ""))) if isinstance(x, dict) else "" if x is None else str(x)

    def thought(x: dict) -> str:
        return next((joined(x[k]) for k in REASONING_KEYS if x.get(k)), "")

    text, reasoning = [], []
    for choice in event.get("choices") or []:
        delta, message = choice.get("delta") or {}, choice.get("message") or {}
        places = (delta.get("content"), delta.get("text"), message.get("content"), choice.get("text"))
        text.append(joined(next((x for x in places if x is not None), "")))
        reasoning.append(thought(delta) or thought(message) or thought(choice))
    kind, delta = str(event.get("type") or ""), event.get("delta")
    if not any(text) and delta:
        if kind == "response.reasoning_summary_text.delta" or (isinstance(delta, dict) and delta.get("type") == "thinking_delta"):
            reasoning.append(joined(delta.get("thinking")) if isinstance(delta, dict) else str(delta))
        elif "delta" in kind:
            text.append(joined(delta))
    return "".join(text), "".join(reasoning) or thought(event)


class Completion:
    """A completion from chunks cut anywhere: frames, or bare JSON on one line; <think> tags part reasoning from text."""

    def __init__(self, waiting: str = "", raw: str = "", reasoning: str = ""):
        self.frames, self.raw, self.reasoning = FrameParser(waiting), raw, reasoning

    def push(self, chunk: str) -> None:
        for _, data in self.frames.push(chunk):
            self._event(data)
        rest = self.frames.waiting.strip()
        if rest.startswith("{") and rest.endswith("}") and self._event(rest):
            self.frames.waiting = ""

    def _event(self, data: str) -> bool:
        try:
            event = json.loads(data)
        except ValueError:
            return False
        if not isinstance(event, dict):
            return False
        text, reasoning = completion_parts(event)
        self.raw += text
        self.reasoning += reasoning
        return True

    def result(self) -> tuple[str, str]:
        body, inner = split_thinking([self.raw])
        return body, self.reasoning + inner


def completions(chunks: DataFrame) -> DataFrame:
    """Streaming, in update mode: (stream, seq, chunk) -> (stream, text, reasoning), each stream's reply so far."""
    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reply = Completion(*state.get) if state.exists else Completion()
        for _, chunk in _in_order(rows, "chunk"):
            reply.push(chunk)
        state.update((reply.frames.waiting, reply.raw, reply.reasoning))
        yield pd.DataFrame([(key[0], *reply.result())], columns=["stream", "text", "reasoning"])

    return chunks.groupBy("stream").applyInPandasWithState(step, "stream string, text string, reasoning string", "waiting string, raw string, reasoning string", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, to: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that its source has now, into Parquet, and reads it."""
    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/rows/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).foreachBatch(commit).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{to}/rows").select(*stream.columns)


def replies(events: DataFrame) -> DataFrame:
    """(stream, seq, record as JSON) -> (stream, text): deltas and snapshots in order."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        reply = Reply()
        for record in rows.sort_values("seq")["record"]:
            try:
                reply.apply(json.loads(record))
            except (ValueError, TypeError):
                continue
        return pd.DataFrame([(rows["stream"].iloc[0], reply.text)], columns=["stream", "text"])

    return events.groupBy("stream").applyInPandas(run, "stream string, text string")


def progress(events: DataFrame, time: str, every: str, late: str, key: str, value: str) -> DataFrame:
    """Streaming or batch: the last value of every key and interval, clamped to 0..100."""
    seen = events.withWatermark(time, late) if events.isStreaming else events
    last = seen.groupBy(F.window(time, every), key).agg(F.max_by(value, time).alias(value))
    return last.select(F.col("window.start").alias("start"), key, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(value))).alias(value))


def step_events(c):
    """The text, reasoning and total tokens of one interaction event (JSON)."""
    kind = F.get_json_object(c, "$.delta.type")
    return F.struct(F.when(kind == "text", F.get_json_object(c, "$.delta.text")).alias("text"), F.when(kind == "thought_summary", F.get_json_object(c, "$.delta.content.text")).alias("reasoning"), F.get_json_object(c, "$.interaction.usage.total_tokens").cast("long").alias("total_tokens"))


def packed_batches(items: DataFrame, key: str, order: str, text: str, most: int) -> DataFrame:
    """Items with the batch (from 0) that they travel in: encoded lengths up to `most` a batch."""
    from ..operators.sequences import greedy_groups

    rows = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_r"))
    at = greedy_groups(F.transform("_r", lambda x: F.octet_length(x[text])), most, 1 << 30)
    return rows.select(key, F.explode(F.arrays_zip(F.col("_r").alias("r"), at.alias("batch"))).alias("x")).select(key, f"x.r.{order}", f"x.r.{text}", "x.batch")
