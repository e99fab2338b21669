"""Exponentially weighted baseline per tenant over a stream of closed windows.

Counting is left to the built-in windowed aggregate, which pre-aggregates on the map side; the
processor sees one small row per tenant and window, so a tenant with most of the events costs no
more than any other.  Idle windows are a power of the decay, so no timers are needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import events as E
from tidemark.operators import anomaly as N

SCORED = ("tenantId STRING, windowStart BIGINT, n BIGINT, baseline DOUBLE, anomalyScore DOUBLE, "
          "anomalyDetected BOOLEAN")


def _processor(window_ms: int):
    alpha, threshold, score_of = N.ALPHA, N.THRESHOLD, N.score_of

    class Baseline(StatefulProcessor):
        """State per tenant: number of the last window and the average after it."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("baseline", "idx BIGINT, ewma DOUBLE")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            batch = pd.concat(list(rows)).sort_values("windowStart")
            idx, ewma = self.state.get() if self.state.exists() else (None, None)
            out = []
            for start, n in zip(batch["windowStart"], batch["n"]):
                i, n = int(start) // window_ms, int(n)
                if idx is None:
                    base, ewma = None, float(n)
                else:
                    base = ewma * (1 - alpha) ** (i - 1 - idx)
                    ewma = alpha * n + (1 - alpha) ** (i - idx) * ewma
                idx = i
                score = score_of(n, base)
                out.append((key[0], int(start), n, base, score, score >= threshold))
            self.state.update((idx, ewma))
            yield pd.DataFrame(out, columns=["tenantId", "windowStart", "n", "baseline", "anomalyScore",
                                             "anomalyDetected"]).astype({"baseline": "float64"})

        def close(self) -> None:
            pass

    return Baseline()


def window_counts(events: DataFrame, window_ms: int = N.WINDOW_MS, grace: str = "30 seconds") -> DataFrame:
    """Closed windows of CONFIDENTIAL and RESTRICTED events per tenant."""
    counted = (events.where(E.is_enriched("classification")).withColumn("eventTs", E.ts("createdAt"))
               .withWatermark("eventTs", grace)
               .groupBy(F.window("eventTs", f"{window_ms} milliseconds").alias("w"), "tenantId")
               .agg(F.count(F.lit(1)).alias("n")))
    return counted.select("tenantId", F.unix_millis("w.start").alias("windowStart"), "n")


def baseline_scores(counts: DataFrame, window_ms: int = N.WINDOW_MS) -> DataFrame:
    """Streaming twin of ``anomaly.window_scores`` over closed-window counts."""
    return counts.groupBy("tenantId").transformWithStateInPandas(
        statefulProcessor=_processor(window_ms), outputStructType=SCORED, outputMode="append", timeMode="none")
