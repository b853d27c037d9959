"""Plan checks: the regex chain runs once; scans are pruned."""

from pyspark.sql import functions as F

from qalam.operators.cleaning import kept
from qalam.plans.cleaning import forum_flagged
from qalam.plans.packing import _encoded
from qalam.operators.pack import doc_offsets

SF = "/root/testdata/sf0.001"


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_kept_rows_do_not_duplicate_the_chain(spark):
    fl = forum_flagged(spark, SF)
    one = _optimized(fl).count("regexp_replace(")
    k = _optimized(kept(fl).select("id", "clean")).count("regexp_replace(")
    assert k <= one, (one, k)


def test_scan_is_pruned(spark):
    plan = doc_offsets(_encoded(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "lang" not in plan.split("ReadSchema")[1].split("\n")[0]


def _window_partition_specs(df):
    """Partition-spec strings of every Window operator in the physical plan."""
    import re
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Window \[.*?\], \[(.*?)\], \[", plan)


def test_offsets_use_partitioned_windows(spark):
    specs = _window_partition_specs(doc_offsets(_encoded(spark, SF)))
    # no window over documents without a partition: the running sums are
    # partitioned by source (bucket totals) and by (source, bucket) (documents)
    assert specs and all(s.strip() for s in specs), specs
    assert any("__r" in s for s in specs)


def test_split_and_blocks_avoid_global_windows(spark):
    from qalam.operators.dialect import stratified_split
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    specs = _window_partition_specs(stratified_split(e, "label", "vec_id"))
    assert specs and all(s.strip() for s in specs), specs


def test_first_n_per_group_limits_before_the_shuffle(spark):
    # L1: a hot dialect is cut to n rows per task before it is shuffled
    import __spark_entry__ as E
    plan = E.queries()["parallel_first_n"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_cleaning_stays_jvm_side(spark):
    # the whole forum profile is projections + one aggregate: no Python, no join
    import __spark_entry__ as E
    plan = E.queries()["forum_funnel"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "Join" not in plan
