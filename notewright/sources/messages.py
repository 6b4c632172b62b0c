"""Captured response bodies: event streams and tool results.

A body is one value, so its events are handled with array functions inside the row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.text import LINE_BREAK, WS


def event_message(raw: Column, request_id: Column | None = None) -> Column:
    """The message of an event-stream body, as VARIANT.

    Data lines of each event are joined and parsed; events that do not parse are skipped. Chosen is
    the first message with the request's id, else the first carrying a result or an error, else the
    first, else null.
    """

    def event_json(event: Column) -> Column:
        lines = F.filter(F.split(event, LINE_BREAK), lambda line: line.startswith("data:"))
        stripped = F.transform(lines, lambda line: F.regexp_replace(line, f"^data:[{WS}]?", ""))
        return F.when(F.size(lines) > 0, V.strict_json(F.array_join(stripped, "\n")))

    messages = F.filter(
        F.transform(F.split(raw, LINE_BREAK * 2), event_json), lambda m: m.isNotNull()
    )

    def answers(message: Column) -> Column:
        return V.is_object(message) & (
            F.try_variant_get(message, "$.result", "variant").isNotNull()
            | F.try_variant_get(message, "$.error", "variant").isNotNull()
        )

    choices = [F.get(F.filter(messages, answers), F.lit(0)), F.get(messages, F.lit(0))]
    if request_id is not None:
        mine = F.filter(messages, lambda m: V.is_object(m) & (V.text_at(m, "$.id") == request_id))
        choices.insert(0, F.get(mine, F.lit(0)))
    return F.coalesce(*choices)


def decode_messages(
    df: DataFrame, keys: list[str], raw: str = "raw", request_id: str | None = None
) -> DataFrame:
    wanted = None if request_id is None else F.col(request_id)
    return df.select(*keys, event_message(F.col(raw), wanted).alias("message"))


def decode_tool_results(
    df: DataFrame, keys: list[str], body: str = "body", request_id: str | None = None
) -> DataFrame:
    """``status`` ('ok' or 'call-failed') and the ``value`` a tool answered with, as VARIANT.

    The body is JSON, else an event stream. The first content text is JSON, else the text itself.
    """
    wanted = None if request_id is None else F.col(request_id)
    message = F.coalesce(V.strict_json(F.col(body)), event_message(F.col(body), wanted))
    decoded = df.select(*keys, message.alias("message"))
    refused = V.is_record(F.try_variant_get("message", "$.error", "variant"))
    text = F.when(
        V.is_object(F.col("message")) & ~refused,
        V.text_at(F.col("message"), "$.result.content[0].text"),
    )
    return decoded.select(*keys, text.alias("text")).select(
        *keys,
        F.when(F.col("text").isNull(), "call-failed").otherwise("ok").alias("status"),
        F.coalesce(V.strict_json(F.col("text")), F.col("text").cast("variant")).alias("value"),
    )
