"""I1 as a stream: each address' stored content as keyed state, an outcome for every fetch; and whole crawl runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quillspark.operators.crawl import crawl_errors, crawl_stats, manifest_changes, manifest_state
from quillspark.schemas import MANIFEST

OUTPUT = "pdf_url STRING, ts TIMESTAMP_NTZ, outcome STRING"


class Changes(StatefulProcessor):
    """Whether an address has an entry, and the content hash stored for it.

    Fetches of one micro-batch apply in order of (ts, arrived_at), across its Arrow frames: of an address they are held
    together, so the source's batch (``maxFilesPerTrigger``) bounds them. Fetches of a later micro-batch that are earlier in
    time apply after it. :func:`crawl_run` splits addresses that are too hot for one task by time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", "sha STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.stored.exists()
        held = self.stored.get()[0] if known else None
        before = (known, held)
        out = []
        whole = pd.concat([frame[["ts", "arrived_at", "status", "sha256", "robots_ok", "transport_error"]] for frame in rows])
        for f in whole.sort_values(["ts", "arrived_at"], kind="stable").itertuples(index=False):
            sha = f.sha256 if isinstance(f.sha256, str) else "-"
            if pd.isna(f.robots_ok) or not f.robots_ok or isinstance(f.transport_error, str):
                outcome = "error"
            elif f.status == 304:
                outcome, known = "unchanged", True
            elif f.status != 200:
                outcome = "error"
            else:
                outcome = "unchanged" if held == sha else "updated" if known else "new"
                held, known = sha, True
            out.append((key[0], f.ts, outcome))
        if (known, held) != before:
            self.stored.update((held,))
        yield pd.DataFrame(out, columns=["pdf_url", "ts", "outcome"])

    def close(self) -> None:
        pass


def manifest_stream(fetches: DataFrame) -> DataFrame:
    """Outcome of every fetch of a stream; needs the RocksDB state store. Append mode, state without expiry."""
    return fetches.groupBy("pdf_url").transformWithStateInPandas(statefulProcessor=Changes(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def stored_manifest(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """The newest saved manifest below ``store`` (of a batch under ``before``); empty where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(store)
    system = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    saved = []
    if system.exists(folder):
        for entry in system.listStatus(folder):
            name = entry.getPath().getName()
            if name.startswith("batch=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
                saved.append(int(name.partition("=")[2]))
    saved = [n for n in saved if before is None or n < before]
    return spark.read.schema(MANIFEST).parquet(f"{store}/batch={max(saved)}") if saved else spark.createDataFrame([], MANIFEST)


def crawl_run(fetches: DataFrame, discoveries: DataFrame, store: str, checkpoint: str, site: str, rules: DataFrame | None) -> StreamingQuery | None:
    """Applies a stream of fetches to the manifest below ``store``, which is saved whole after every micro-batch.

    Each batch reads the manifest of the one before and writes its own (``batch=<n>``), its statistics (``stats/batch=<n>``)
    and errors (``errors/batch=<n>``); a batch that is run again writes the same. Without robots ``rules`` nothing is
    fetched or changed: the statistics hold the one error. Run it daily, as it ends when all input is read.
    """
    spark = fetches.sparkSession
    if rules is None:
        spark.createDataFrame([(None, None, "robots.txt unavailable -- aborting run.")], "pdf_url string, ts timestamp_ntz, message string").write.mode("overwrite").parquet(f"{store}/errors/batch=aborted")
        return None

    def apply(batch: DataFrame, number: int) -> None:
        held = stored_manifest(batch.sparkSession, store, number)
        changes = manifest_changes(batch, held).persist()
        crawl_stats(changes, F.lit(number).alias("run")).write.mode("overwrite").parquet(f"{store}/stats/batch={number}")
        crawl_errors(changes).write.mode("overwrite").parquet(f"{store}/errors/batch={number}")
        manifest_state(changes, discoveries, site, held).write.mode("overwrite").parquet(f"{store}/batch={number}")
        changes.unpersist()

    return fetches.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
