"""Message payload intake: JSON events -> sender, text, ids, outcome (I-09 ... I-12)."""
from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperloom.functions.regex import first_match, non_blank, strip
from paperloom.functions.scalars import normalize_phone, valid_phone

# what runs in Python workers travels by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEXT_KEYS = ("body", "text", "caption", "conversation", "contentText", "selectedDisplayText")
# The fields that are read by name; what lies deeper in ``body`` and ``message`` is walked where it is needed.
PAYLOAD = (
    "struct<event:string,payload:struct<id:string,fromMe:boolean,`from`:string,participant:string,author:string,"
    "body:string,caption:string,text:string,hasMedia:boolean,"
    "_data:struct<key:struct<remoteJidAlt:string,participantPn:string,remoteJid:string,participant:string,id:string>,"
    "participantPn:string,id:struct<_serialized:string,id:string>,message:string>>>"
)


def _non_blank(value: Column) -> Column:
    return non_blank(strip(value))


def first_text(node) -> str | None:
    """The first non-blank text at any depth: a node's own text fields, then the nodes inside it in their order."""
    todo = [node]
    while todo:
        value = todo.pop()
        if isinstance(value, str):
            if text := value.strip():
                return text
        elif isinstance(value, dict):
            inner = [v for v in value.values() if isinstance(v, (dict, list))]
            todo += [*reversed(inner), *(value[k] for k in reversed(TEXT_KEYS) if isinstance(value.get(k), str))]
        elif isinstance(value, list):
            todo += reversed(value)
    return None


@F.pandas_udf(StringType())
def _walk(event: pd.Series, part: pd.Series) -> pd.Series:
    """The text of ``payload.body`` or ``payload._data.message``; NULL events, nearly all, cost nothing."""

    def find(text: str | None, at: str) -> str | None:
        try:
            payload = json.loads(text).get("payload") if text is not None else None
        except (ValueError, RecursionError, AttributeError):
            return None
        if not isinstance(payload, dict):
            return None
        data = payload.get("_data")
        return first_text(payload.get("body") if at == "body" else data.get("message") if isinstance(data, dict) else None)

    return pd.Series([find(e, p) for e, p in zip(event, part)], dtype=object)


def sender_phone(p: Column) -> Column:
    """I-10: the first valid phone among the known paths, else the first non-empty one."""
    data = p["_data"]
    paths = [
        data["key"]["remoteJidAlt"], data["participantPn"], data["key"]["participantPn"], p["from"], p["participant"],
        p["author"], data["key"]["remoteJid"], data["key"]["participant"],
    ]
    phones = F.filter(F.array(*[normalize_phone(x) for x in paths]), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.get(F.filter(phones, valid_phone), F.lit(0)), F.get(phones, F.lit(0)), F.lit(""))


def message_text(p: Column, event: Column) -> Column:
    """I-11: the first non-blank candidate: body (plain or nested), caption, text, then the inner message.

    Plain fields and the inner message's own text fields are read in place. Only events whose text can lie deeper, in an
    object or list, are walked in full, to any depth.
    """
    nested = strip(p["body"]).startswith("{") | strip(p["body"]).startswith("[")
    body = F.when(nested, _walk(F.when(nested, event), F.lit("body"))).otherwise(_non_blank(p["body"]))
    message = p["_data"]["message"]
    first = F.from_json(message, "body string, text string, caption string, conversation string")
    spoken = _non_blank(first["conversation"])
    simple = F.when(F.coalesce(first["body"], first["text"], first["caption"]).isNull() & ~spoken.startswith("{") & ~spoken.startswith("["), spoken)
    plain = F.coalesce(body, _non_blank(p["caption"]), _non_blank(p["text"]))
    deep = plain.isNull() & simple.isNull() & message.isNotNull()
    return F.coalesce(plain, simple, _walk(F.when(deep, event), F.lit("message")))


def message_ids(p: Column) -> Column:
    """I-12: ordered distinct non-blank ids."""
    data = p["_data"]
    ids = F.array(p["id"], data["id"]["_serialized"], data["id"]["id"], data["key"]["id"])
    return F.array_distinct(F.array_compact(F.transform(ids, _non_blank)))


def parse_messages(raw: DataFrame, body: str = "body") -> DataFrame:
    """I-09: one row per event with phone, text, ids and ``reason`` (NULL = accepted). Works on streams too."""
    parsed = raw.withColumn("_m", F.from_json(F.col(body), PAYLOAD)).withColumn("_p", F.col("_m.payload"))
    p = F.col("_p")
    parsed = parsed.withColumns(
        {
            "phone": sender_phone(p),
            "message_text": message_text(p, F.col(body)),
            "message_ids": message_ids(p),
            "has_media": F.coalesce(p["hasMedia"], F.lit(False)),
        }
    )
    reason = first_match(
        [
            (F.coalesce(F.col("_m.event"), F.lit("")) != "message", F.lit("non-message event")),
            (F.coalesce(p["fromMe"], F.lit(False)), F.lit("echo")),
            (F.col("phone") == "", F.lit("missing sender")),
            (F.col("message_text").isNull() & ~F.col("has_media"), F.lit("non-text message")),
        ]
    )
    return parsed.withColumn("reason", reason).drop("_m", "_p")
