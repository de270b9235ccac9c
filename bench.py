"""Headline measurements on the provided tables; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

`ingest` maps every table to facts and appends them to a parquet log with a snapshot of state;
`stats`, folds and the business questions then read that log, and `plan_write_commit` checks and
commits one batch to it. The rest run on the tables. Each
query is timed after one warm-up run.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from factloom.model import kernel_attributes, registry  # noqa: E402
from factloom.operators import fold, profile  # noqa: E402
from factloom.operators.ingest import plan_write  # noqa: E402
from factloom.plans import load, stored, world  # noqa: E402
from factloom.sources import log  # noqa: E402
from factloom.store import FactLog  # noqa: E402

TABLES = ["canonicalise_one", "asof_fold", "open_order_value", "in_transit", "in_transit_asof", "quarter_totals", "inspections", "crosswalk", "open_value",
          "person_orders", "provenance", "derived_stock", "slipped", "known_by_date", "upsert_diff", "same_as_root", "components", "tier_match", "dup_accounts",
          "column_profile", "id_coverage", "doc_copies", "statement_recall", "similar_names"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    start = time.time()
    fn()
    return round(time.time() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.adaptive.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    out: dict[str, float] = {}
    base = tempfile.mkdtemp(prefix="spark-bench-")

    def ingest(path: str) -> None:
        facts = world.facts(spark, folder)
        log.append_facts(facts, path, world.DAY_TX)
        log.append_attributes(registry(spark, [*kernel_attributes(), *world.ATTRIBUTES, stored.EVIDENCE]), path, 0)
        log.append_transactions(world.transactions(spark, folder), path, world.DAY_TX)
        log.write_state(fold.state(log.scan(spark, path)), path, world.DAY_TX)

    ingest(f"{base}/warm")
    path = f"{base}/store"
    out["ingest"] = timed(lambda: ingest(path))
    store = FactLog.open(spark, path)
    facts = store.log().count()

    def commit() -> None:
        """A planned write by lookups: validation, identity, diff, stamp and append."""
        now = FactLog.open(spark, path)
        plan = plan_write(stored.shipped(spark, folder), now.state(), now.log(), now.attrs, stored.FIRST_NEW)
        log.commit(spark, path, plan, 100, datetime(2002, 1, 1))

    def stats() -> None:
        for df in profile.statistics(store).values():
            run(df)
    on_log = {
        "stats": stats,
        "log_state": lambda: run(store.state()),
        "log_open_value": lambda: run(
            store.wide(["order/customer", "order/status", "order/total"]).where("`order/status` <> 'F'")
            .join(store.attr("customer/segment").withColumnRenamed("e", "c"), F.expr("`order/customer` = c"))
            .groupBy("v").agg(F.sum("`order/total`"))),
        "log_asof_status": lambda: run(store.attr("order/status", as_of="1998-06-30T12:00:00Z")),
        "log_one_entity": lambda: run(store.attr("order/total").where(F.col("e") == 2 * world.WIDTH + 7)),
    }
    for name, fn in on_log.items():
        fn()
        out[name] = timed(fn)
    out["plan_write_commit"] = timed(commit)
    queries = load().QUERIES
    for name in TABLES:
        run(queries[name](spark, folder))
        out[name] = timed(lambda: run(queries[name](spark, folder)))
    print(json.dumps({"metric": "total seconds over headline queries", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out,
                      "sf": folder.rsplit("sf", 1)[-1], "facts": facts, "ingest_facts_per_sec": round(facts / out["ingest"]),
                      "stats_facts_per_sec": round(facts / out["stats"]), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
