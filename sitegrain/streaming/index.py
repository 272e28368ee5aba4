"""The page index kept up by a stream of captures: titles, descriptions, first headings and content signatures.

Three steps, each a query of its own that goes on where it stopped:

* ``index_changes`` — keyed by URL, with one state for each indexed value. A
  capture that is newer than the last gives, for every value that changed, the
  retraction of the old key and the addition of the new one; an older capture
  changes nothing.
* ``group_sizes`` — the changes summed up by key, as a streaming aggregation
  in update mode: Spark combines before the shuffle, so that a key that a third
  of all pages share costs a row a task.
* ``duplicates``, ``near_duplicates`` — at any time, what is in a group of two
  and more.

State holds keys' hashes and signatures of pages, never a group: it grows with
the number of URLs, in the state store's files.

Captures that have a ``page`` are keyed by it instead of their URL, where pages
of one URL are pages of their own; ``url`` in the results is then the page.

Defined results: rows without a key don't take part; of captures of one key the
largest ``seq`` counts, and of equal ones the first that came; a null or blank
value is in no group; a page of fewer than five words has no signature; an
empty stream gives an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sitegrain.functions.html import extract_page
from sitegrain.operators.pages import strip_html
from sitegrain.operators.signatures import near_among, signature_of
from sitegrain.plans.dialect import SPARK

VALUES = ("title", "description", "h1", "signature")
CHANGES = "kind string, key string, op int, seq bigint"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def page_values(captures: DataFrame) -> DataFrame:
    """``captures(url, html, seq[, page])`` → ``(url, seq, title, description, h1, signature)``, a stateless projection; html ends here."""
    key = F.col("page" if "page" in captures.columns else "url")
    plain = lambda c: F.nullif(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), F.lit(""))
    read = captures.where(key.isNotNull()).select(key.alias("url"), "seq", extract_page("html", "url").alias("p"), F.expr(strip_html(SPARK, "coalesce(html, '')")).alias("body"))
    signature = F.array_join(signature_of(F.col("body")), ",")
    return read.select("url", "seq", plain(F.col("p.title")).alias("title"), plain(F.col("p.description")).alias("description"), plain(F.get("p.h1", F.lit(0))).alias("h1"), signature.alias("signature"))


class PageIndex(StatefulProcessor):
    """State of one URL: the last capture's number and each of its indexed values."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seq = handle.getValueState("seq", "seq bigint")
        self.values = {v: handle.getValueState(v, "value string") for v in VALUES}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = self.seq.get()[0] if self.seq.exists() else None
        new = None
        for batch in rows:
            for row in batch.itertuples(index=False):
                if last is None or row.seq > last:
                    last, new = int(row.seq), row
        out = []
        if new is not None:
            self.seq.update((last,))
            for value, state in self.values.items():
                old = state.get()[0] if state.exists() else None
                now = getattr(new, value)
                now = None if pd.isna(now) else now
                if now == old:
                    continue
                out += [(value, k, op) for k, op in ((old, -1), (now, 1)) if k is not None]
                if now is None:
                    state.clear()
                else:
                    state.update((now,))
        if out:
            yield pd.DataFrame({"url": [key[0]] * len(out), "kind": [o[0] for o in out], "key": [o[1] for o in out], "op": [o[2] for o in out], "seq": [last or 0] * len(out)})

    def close(self) -> None:
        pass


def index_changes(values: DataFrame) -> DataFrame:
    """``(url, kind, key, op, seq)``: additions (1) and retractions (-1) of titles, descriptions, first headings and signatures."""
    values.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return values.groupBy("url").transformWithStateInPandas(PageIndex(), f"url string, {CHANGES}", "Append", "None")


def group_sizes(changes: DataFrame) -> DataFrame:
    """Members of every key, of a stream of changes in update mode or of a table of them."""
    return changes.where("kind <> 'signature'").groupBy("kind", "key").agg(F.sum("op").alias("n"))


def sizes_sink(folder: str):
    """``foreachBatch`` sink of ``group_sizes``: a batch writes its own folder, so a repeated batch replaces its rows."""
    return lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/sizes/at={number}")


def current_sizes(sizes: DataFrame) -> DataFrame:
    """The last size of every key, of all batches' rows."""
    return sizes.groupBy("kind", "key").agg(F.max_by("n", "batch").alias("n")).where("n > 0")


def members(changes: DataFrame) -> DataFrame:
    """``(url, kind, key)`` that hold now: what was added and not retracted."""
    return changes.groupBy("url", "kind", "key").agg(F.sum("op").alias("n")).where("n > 0").drop("n")


def duplicates(changes: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(url, kind, key, n_others)`` of pages that share a title, description or first heading with others."""
    shared = sizes.where("n > 1").select("kind", "key", F.col("n").alias("n_pages"))
    return members(changes.where("kind <> 'signature'")).join(shared, ["kind", "key"]).select("url", "kind", "key", (F.col("n_pages") - 1).cast("bigint").alias("n_others"))


def near_duplicates(changes: DataFrame) -> DataFrame:
    """``(url, likeness, n_others)`` of pages that others come near to, by the signatures that hold now."""
    signed = members(changes.where("kind = 'signature'")).select(F.col("url").alias("page_id"), F.split("key", ",").cast("array<bigint>").alias("sig"))
    return near_among(signed).select(F.col("page_id").alias("url"), "likeness", "n_others")


def keep_up(captures: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Runs both streams over the captures that are there and returns the changes and the current sizes; called again, they go on.

    The changes are files that the first stream commits once each; the second
    reads them as its source.
    """
    spark = captures.sparkSession
    changes = index_changes(page_values(captures))
    first = changes.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/pages").option("path", f"{folder}/changes").trigger(availableNow=True)
    first.format("parquet").start().awaitTermination()
    schema = changes.schema
    second = group_sizes(spark.readStream.schema(schema).parquet(f"{folder}/changes")).writeStream.outputMode("update")
    second.option("checkpointLocation", f"{folder}/groups").trigger(availableNow=True).foreachBatch(sizes_sink(folder)).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/changes"), current_sizes(spark.read.parquet(f"{folder}/sizes"))
