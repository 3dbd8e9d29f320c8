"""Shared folders and the logs opened from them."""

from types import SimpleNamespace

import pytest

from millrace.plans import log_queries
from millrace.session import discard, scratch, stored, table

SF = "/root/testdata/sf0.001"


def test_a_cluster_without_a_shared_folder_is_refused():
    conf = SimpleNamespace(get=lambda name, default=None: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_discarded_tables_are_gone(spark, tmp_path):
    at = f"file://{tmp_path}/some"
    stored(spark.range(3), at, "numbers")
    discard(spark, at)
    assert not (tmp_path / "some").exists()


def test_log_queries_read_a_table_written_anew(spark, tmp_path):
    events = table(spark, SF, "events")
    query = log_queries.QUERIES["log_runs"]
    counts = []
    for limit in (400, 100):
        events.orderBy("event_id").limit(limit).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        counts.append(sum(r.events for r in query(spark, str(tmp_path)).collect()))
    assert counts == [400, 100]
