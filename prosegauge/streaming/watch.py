"""A running audit of a folder: how the number of findings changes, by document and rule, as files come, change and go.

The state is one map of counts for each document; it goes with the document, so it grows with the folder and not with
its history. A document that was there when the watch began is a silent baseline; one that comes later is news with all
its findings; a deleted one is a decrease of each. Files that can't be read leave the state as it is. The source lists
the folder at each trigger, so a change that no event told of is found by the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from prosegauge.functions.lexicon import RULES
from prosegauge.plans.audit import document_counts
from prosegauge.sources import committed
from prosegauge.sources.watch import watch_folder

SCHEMA = "path string, rule string, before int, now int, change int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Changes(StatefulProcessor):
    """(path, rule, before, now, change) of the rules whose number of findings is not what it was."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "rule string", "n int")
        self.seen = handle.getValueState("seen", "yes boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        before = {k[0]: v[0] for k, v in self.counts.iterator()}
        out = []
        for frame in rows:
            for event, silent, counts in zip(frame["event"], frame["silent"], frame["counts"]):
                if event == "error":
                    continue
                now = {} if event == "gone" else {k: v for k, v in dict(counts).items() if v}
                if not (silent and not self.seen.exists()):
                    names = [r for r in RULES if before.get(r, 0) != now.get(r, 0)]
                    out += [(key[0], r, before.get(r, 0), now.get(r, 0), now.get(r, 0) - before.get(r, 0)) for r in names]
                for r in before.keys() - now.keys():
                    self.counts.removeKey((r,))
                for r, n in now.items():
                    if before.get(r) != n:
                        self.counts.updateValue((r,), (n,))
                if event == "gone":
                    self.seen.clear()
                    self.counts.clear()
                else:
                    self.seen.update((True,))
                before = now
        yield pd.DataFrame(out, columns=["path", "rule", "before", "now", "change"])

    def close(self) -> None:
        pass


def changes(events: DataFrame, common: list[str] | None = None, known: list[str] | None = None, rules: list[str] | None = None) -> DataFrame:
    """The changes of a stream of events (path, event, silent, text), as `watch_folder` gives them. Needs the state
    store of `ROCKS`."""
    tagged = events.select(F.struct("path", "event", "silent").alias("doc"), F.when(F.col("event") == "present", F.col("text")).alias("text"))
    counted = document_counts(tagged, common, known, rules).select("doc.*", "counts")
    return counted.groupBy("path").transformWithStateInPandas(Changes(), SCHEMA, outputMode="append", timeMode="none")


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, trigger: dict | None = None, common: list[str] | None = None, known: list[str] | None = None, rules: list[str] | None = None) -> StreamingQuery:
    """Watches a folder and adds its changes to the committed table `out`, once a batch whatever fails. trigger: that of
    the stream, by default all there is now; {"processingTime": "30 seconds"} goes on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    committed.register(spark)
    rows = changes(watch_folder(spark, folder, f"{checkpoint}/listings"), common, known, rules)
    stream = rows.writeStream.format("committed").option("path", out).option("checkpointLocation", f"{checkpoint}/query").outputMode("append")
    return stream.trigger(**(trigger or {"availableNow": True})).start()
