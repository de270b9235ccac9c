"""Plans the operators must keep: where predicates land, what moves, what never appears."""

import os
import re

import naive
import pytest
from conftest import ROOT
from pyspark.sql import functions as F

from factloom.model import Attribute
from factloom.operators import fold
from factloom.plans import load, world

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_as_of_bound_is_below_the_shuffle(spark, tmp_path):
    naive.facts(spark, [(1, 1, "a", 5, True)]).write.parquet(str(tmp_path / "f"))
    facts = spark.read.parquet(str(tmp_path / "f"))
    text = plan_of(fold.state(facts, 7))
    assert text.rindex("LessThanOrEqual(tx,7)") > text.rindex("Exchange hashpartitioning")
    assert text.count("Exchange") == 1


def test_fold_pushes_entity_and_value_predicates_to_the_scan(spark, tmp_path):
    naive.facts(spark, [(1, 1, "a", 5, True)]).write.parquet(str(tmp_path / "f"))
    rel = fold.relation(spark.read.parquet(str(tmp_path / "f")), Attribute(1, "x/y", "string"))
    text = plan_of(rel.where("e = 3 AND v = 'a'"))
    assert "EqualTo(e,3)" in text and "EqualTo(v_string,a)" in text
    assert re.search(r"ReadSchema: struct<e:bigint,a:bigint,v_string:string,tx:bigint,op:boolean>", text)


def test_fixed_width_folds_hash_and_wide_reads_shuffle_once(spark, tmp_path):
    naive.facts(spark, [(1, 1, 5, 5, True)], "ref").write.parquet(str(tmp_path / "f"))
    facts = spark.read.parquet(str(tmp_path / "f"))
    a, b = Attribute(1, "x/a", "ref"), Attribute(2, "x/b", "decimal")
    text = plan_of(fold.wide(facts, [a, b]))
    assert text.count("Exchange") == 1 and "SortAggregate" not in text
    assert "SortAggregate" not in plan_of(fold.state(facts))


@pytest.mark.parametrize("name", ["in_transit", "crosswalk", "similar_names", "tier_match", "id_coverage", "jaccard", "near_match", "statement_recall", "list_questions"])
def test_no_product_of_two_tables(spark, name):
    text = plan_of(load().QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_a_relation_scans_its_own_table_and_columns_only(spark):
    text = plan_of(world.store(spark, SMALL).attr("order/status"))
    assert text.count("FileScan") == 1 and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz>" in text


def test_sources_never_pin_lineage_to_one_machine():
    for folder, _, files in os.walk(os.path.join(ROOT, "factloom")):
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f)).read()
                assert "localCheckpoint" not in text and "crossJoin" not in text
                # what the training-data operators broadcast is bounded, and said to be where it is done
                assert "broadcast(" not in text or os.path.basename(folder) == "llm"


def test_hot_entity_stays_spread(spark):
    """A third of all facts on one entity: the fold's shuffle key keeps them apart."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("long").alias("e"), F.lit(7).cast("long").alias("a"),
        F.col("id").cast("string").alias("v_string"), *[F.lit(None).cast(t).alias(c) for c, t in (
            ("v_decimal", "decimal(38,18)"), ("v_boolean", "boolean"), ("v_date", "date"), ("v_instant", "timestamp"), ("v_ref", "bigint"))],
        F.col("id").alias("tx"), F.lit(True).alias("op"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    sizes = [r["count"] for r in fold.state(rows).groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 2 * min(sizes)
