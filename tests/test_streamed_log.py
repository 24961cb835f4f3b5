"""The streamed log over more files than a batch takes, not in time order."""

import os
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq

from tallyforge.plans import registry


def test_over_200_unordered_files_count_whole(spark, tmp_path):
    log = tmp_path / "events.parquet"
    log.mkdir()
    for i in range(204):  # three batches, the newest files first; the watermark drops rows from the third on
        day = datetime(2024, 6, 1) - timedelta(days=i)
        pq.write_table(pa.table({"ts": pa.array([day, day], pa.timestamp("us")), "event_type": ["a", "b"], "value": [1.0, 2.0]}), log / f"part-{i:03}.parquet")
        os.utime(log / f"part-{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    rows = registry.queries()["streamed_outcomes"](spark, str(tmp_path)).collect()
    assert len(rows) == 408 and sum(r["n"] for r in rows) == 408 and sum(r["total"] for r in rows) == 612
