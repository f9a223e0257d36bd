"""Command line: store, query, similar, nearest, validate, dump, compare, parameters, ablation, learn, suite."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from trailmark import experiments, model
from trailmark.learn import bmtree, theta
from trailmark.operators import range_query, similarity
from trailmark.plans.indexes import KINDS
from trailmark.session import session, ship
from trailmark.sources import parse, tables, workloads


EXTENTS = {"beijing": model.BEIJING, "chengdu": model.CHENGDU}


def _windows(text: str) -> list[tuple[float, ...]]:
    return [tuple(map(float, w.split(","))) for w in text.split(";") if w.strip()]


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="trailmark", description=__doc__)
    modes = p.add_subparsers(dest="mode", required=True)

    def mode(name: str, *names: str) -> argparse.ArgumentParser:
        m = modes.add_parser(name)
        for n in names:
            m.add_argument(n)
        m.add_argument("--kind", choices=sorted(KINDS), default="shape")
        m.add_argument("--extent", choices=sorted(EXTENTS), default="beijing")
        return m

    mode("store", "text", "table")
    mode("query", "table", "windows")
    for name in ("similar", "nearest"):
        m = mode(name, "table", "queries", "value")
        m.add_argument("--distance", default="frechet")
    mode("validate", "text", "windows")
    mode("compare", "text", "windows", "csv")
    mode("parameters", "text", "windows", "csv")
    mode("ablation", "text", "windows", "csv")
    mode("learn", "text", "windows", "out")
    mode("dump", "text", "windows", "out")
    mode("suite", "config")
    a = p.parse_args(args)
    spark = session()
    ship(spark)
    data = model.trajectories(parse.read_text(spark, a.text)) if hasattr(a, "text") else None
    if a.mode == "store":
        tables.write_table(data, experiments.method(a.kind, EXTENTS[a.extent]), a.table)
    elif a.mode == "query":
        table, index = tables.read_table(spark, a.table)
        range_query.range_queries(table, index, list(enumerate(_windows(a.windows)))).show(100, False)
    elif a.mode in ("similar", "nearest"):
        table, index = tables.read_table(spark, a.table)
        asked = model.trajectories(workloads.query_trajectories(spark, a.queries)).withColumn("qid", F.xxhash64("oid", "tid"))
        asked = asked.select("qid", F.col("oid").alias("q_oid"), F.col("tid").alias("q_tid"), F.col("xs").alias("qxs"), F.col("ys").alias("qys"), *(F.col(c).alias(f"q_{c}") for c in ("xmin", "ymin", "xmax", "ymax")))
        found = similarity.within_indexed(table, index, asked, float(a.value), a.distance) if a.mode == "similar" else similarity.nearest_indexed(table, index, asked, int(a.value), a.distance)
        found.orderBy("qid", "dist").show(100, False)
    elif a.mode == "validate":
        experiments.validate(data, experiments.method(a.kind, EXTENTS[a.extent]), _windows(a.windows)).show(100, False)
    elif a.mode == "dump":
        experiments.dump_validation(data, experiments.method(a.kind, EXTENTS[a.extent]), _windows(a.windows), a.out).groupBy("qid", "verdict").count().show(100, False)
    elif a.mode == "suite":
        text = "\n".join(r.value for r in spark.read.text(a.config, wholetext=True).collect())  # one file
        experiments.run_suite(spark, text, lambda path: model.trajectories(parse.read_text(spark, path)))
    elif a.mode == "compare":
        rows = experiments.comparison(spark, data, {("given", 0): _windows(a.windows)}, sorted(KINDS))
        experiments.write_csv(a.csv, "comparison", rows)
    elif a.mode == "parameters":
        queries, builds = experiments.parameter_study(spark, data, _windows(a.windows))
        experiments.write_csv(a.csv, "parameter", queries)
        experiments.write_csv(f"{a.csv}.build.csv", "build", builds)
    elif a.mode == "ablation":
        experiments.write_csv(a.csv, "ablation", experiments.ablation(spark, data, _windows(a.windows)))
    else:
        extent = EXTENTS[a.extent]
        text = theta.to_text(theta.learn(data, extent)) if a.kind != "bmtree" else bmtree.to_text(bmtree.learn(data, _windows(a.windows), extent), 20)
        with open(a.out, "w") as f:
            f.write(text)


if __name__ == "__main__":
    main()
