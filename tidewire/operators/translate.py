"""Translation by a service that is called for each text: distinct texts only, at a bounded rate, remembered between runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import strip
from tidewire.operators.summary import TRANSLATED, translatable
from tidewire.scratch import Scratch

Call = Callable[[str], "str | None"]
MEMO = "key string, text string, made string"
#: Bytes of this run's translations up to which they are sent to every executor; beyond, they are joined by item.
BROADCAST_BYTES = 64 << 20


def asking(call: Call, pause: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Calls start at least ``pause`` seconds apart. A call that fails, or changes nothing, has made null."""
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free = 0.0
        for batch in batches:
            made = []
            for text in batch["text"]:
                if pause:
                    time.sleep(max(0.0, free - time.monotonic()))
                    free = time.monotonic() + pause
                try:
                    got = call(text)
                except Exception:  # noqa: BLE001  the item keeps its own text
                    got = None
                made.append(None if got == text else got)
            yield batch.assign(made=pd.Series(made, dtype=object, index=batch.index))

    return ask


def translate_once(
    items: DataFrame, call: Call, known: DataFrame | None = None, callers: int = 8, per_second: float | None = None, most: int = TRANSLATED, broadcast_bytes: int = BROADCAST_BYTES
) -> tuple[DataFrame, DataFrame]:
    """The items with title_zh, summary_zh and ai_summary_zh as ``translate_items`` adds them, and the memo for the next run.

    call: from a text to its translation; null, or an exception, leaves the item its own text and isn't remembered. Only the first
    ``most`` characters of a text are sent, each distinct one once, whatever the number of items that share it. known: a
    memo (key, text, made) of earlier runs, whose texts aren't sent again. ``callers`` tasks call at the same time, all together at most
    ``per_second`` times a second; the calls' results are written before they are used. A task that Spark runs again calls again.

    A text that many items share is counted map-side and its translation is joined either by broadcast, while this run's translations are of
    ``broadcast_bytes`` at most, or by the items' ord, so no task holds all items of one text. ord names an item, and may repeat; an item
    whose ord is null keeps its own texts beyond the broadcast's bound. Blank texts aren't sent. No items: an empty table and the memo as it was.
    """
    spark, scratch = items.sparkSession, Scratch(items.sparkSession, "translate")
    parts = translatable(items)
    cut = {name: F.when(needed & (strip(text) != ""), F.left(text, F.lit(most))) for name, (text, needed, _) in parts.items()}
    key = {name: F.sha2(c, 256) for name, c in cut.items()}
    known = known.select("key", "text", "made") if known is not None else spark.createDataFrame([], MEMO)

    texts = items.select(F.explode(F.array_compact(F.array(*cut.values()))).alias("text")).distinct().withColumn("key", F.sha2("text", 256))
    asked, first = scratch.save(texts.join(known.select("key", "made").dropDuplicates(["key"]), "key", "left").select("key", "text", "made"))
    send = asked.where("made is null").repartition(callers, "key")
    sent, _ = scratch.save(send.mapInPandas(asking(call, callers / per_second if per_second else 0.0), MEMO).where("made is not null"))
    now = asked.where("made is not null").unionByName(sent).select("key", "made")

    size = now.agg(F.sum(F.octet_length("made") + 64)).first()[0] or 0
    rows = items
    if size <= broadcast_bytes:
        made = {}
        for i, name in enumerate(parts):
            rows = rows.join(F.broadcast(now.select(F.col("key").alias(f"_key{i}"), F.col("made").alias(f"_made{i}"))), key[name] == F.col(f"_key{i}"), "left")
            made[name] = F.col(f"_made{i}")
    else:
        narrow = items.select(F.col("ord").alias("_ord"), F.explode(F.array_compact(F.array(*key.values()))).alias("key")).where("_ord is not null").distinct()
        by_item = narrow.join(now, "key").groupBy("_ord").agg(F.map_from_entries(F.collect_list(F.struct("key", "made"))).alias("_made"))
        rows = items.join(by_item, F.col("ord") == F.col("_ord"), "left")
        made = {name: F.try_element_at("_made", k) for name, k in key.items()}
    out = rows.select(*items.columns, *(F.when(needed, F.coalesce(made[name], text)).otherwise(other).alias(name) for name, (text, needed, other) in parts.items()))
    return out, known.unionByName(sent)
