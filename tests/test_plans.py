"""Physical-plan properties the design relies on (read from explain output)."""

import io
import re
from contextlib import redirect_stdout

from tests.conftest import SF001
from tokenforge.plans.catalog import QUERIES


def plan(df, mode="formatted"):
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_flagship_prunes_columns_and_shuffles_partials_only(spark):
    p = plan(QUERIES["bucket_histogram"](spark, SF001))
    assert "ReadSchema: struct<text:string>" in p
    nodes = re.findall(r"^\(\d+\) (\w+)", p, re.M)
    assert nodes.count("Exchange") == 1
    assert nodes.count("HashAggregate") == 2      # partial before, final after the exchange


def test_lang_split_prunes_partitions(spark):
    p = plan(QUERIES["scan_lang_split"](spark, SF001))
    assert "PartitionFilters: [isnotnull(lang" in p and "(lang#" in p and "(split#" in p


def test_top_k_is_a_window_group_limit(spark):
    # input already hash-partitioned by run from step numbering: the limit runs
    # without a further shuffle
    p = plan(QUERIES["topk_checkpoints"](spark, SF001), "simple")
    assert "WindowGroupLimit [user_id" in p


def test_computed_filter_is_not_pushed_into_the_scan(spark):
    p = plan(QUERIES["length_filter"](spark, SF001))
    scan = [l for l in p.splitlines() if l.startswith("DataFilters") or "DataFilters:" in l]
    assert all("transform" not in l for l in scan)


def test_keyed_scans_partition_by_key(spark):
    p = plan(QUERIES["running_epoch_loss"](spark, SF001), "simple")
    assert "Window [" in p and "partitioning(user_id" in p
    assert "Window [row_number() windowspecdefinition(ts" not in p   # no keyless global window
