"""Guards on physical plan shapes that the scale design depends on."""

import __spark_entry__ as entry
from conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_global_single_partition_window(spark):
    """The only single-partition step allowed is the offsets window over the per-partition counts of dense_index
    (one row per partition); no data-sized row ever goes through a global window."""
    q = entry.queries()
    for name in ("chunk_rows", "seeded_shuffle", "shard_plan", "paired_batches", "dense_reindex", "prompt_labels"):
        lines = plan(q[name](spark, SF_SMALL)).splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert "keys=[_pid" in lines[i + 1], (name, lines[i + 1])
            if line.strip().startswith(("+- Window", "Window", ":- Window")):
                assert "_pid" in line, (name, line)


def test_previous_row_is_keyed_not_windowed(spark):
    """Rows meet their predecessor through a join on (batch, row) keys, never a batch window."""
    p = plan(entry.queries()["prompt_labels"](spark, SF_SMALL))
    windows = [x for x in p.splitlines() if "windowspecdefinition" in x]
    assert "Join" in p and windows and all("windowspecdefinition(_pid" in x for x in windows)  # partition offsets only


def test_scoring_evaluates_each_step_once(spark):
    p = entry.queries()["wer_filter_keep"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("levenshtein(") == 1
    exchange = plan(entry.queries()["wer_filter_keep"](spark, SF_SMALL))
    below = exchange[exchange.index("Exchange hashpartitioning(doc_id"):]  # the small test table is one split, so it is dealt out
    assert "regexp_replace" not in below and "array_join" not in below


def test_scoring_does_not_shuffle_text_that_has_splits(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs.repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    size = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # one split per file
    try:
        for name in ("wer_filter_keep", "pseudo_label_scores", "cascade"):
            assert "Exchange" not in plan(entry.queries()[name](spark, str(tmp_path))), name
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", size)


def test_partial_aggregation_before_shuffle(spark):
    for name in ("eval_metrics", "trial_stats", "metric_dedup", "corpus_profile"):
        p = plan(entry.queries()[name](spark, SF_SMALL))
        assert "partial_" in p, name


def test_column_pruning_reaches_scan(spark):
    p = plan(entry.queries()["model_ratio"](spark, SF_SMALL))
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_returnflag:string>" in p or \
        "[l_suppkey" in p and "l_shipdate" not in p
