import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from trailmark import experiments, model
from trailmark.functions import dp
from trailmark.learn import bmtree, theta
from trailmark.model import BEIJING, with_bounds
from trailmark.operators import range_query, reports, similarity
from trailmark.plans import indexes
from trailmark.plans.ranges import united
from trailmark.session import work_dir
from trailmark.sources import events, orders, parse, tables, workloads
from trailmark.streaming import assemble

MICRO = 1_000_000


def table(spark, rows):
    """Trajectories of (oid, tid, [(x, y), ...]) in degrees."""
    data = [(o, t, None, len(p), [round(x * MICRO) for x, _ in p], [round(y * MICRO) for _, y in p], [0] * len(p)) for o, t, p in rows]
    return with_bounds(spark.createDataFrame(data, "oid bigint, tid string, sid string, n int, xs array<int>, ys array<int>, ts array<int>"))


@pytest.fixture(scope="module")
def odd(spark):
    """Points on cell borders, outside the extent, single and equal points, envelopes over the middle, repeated ids."""
    rng = random.Random(7)
    mid_x, mid_y = (BEIJING.xmin + BEIJING.xmax) / 2, (BEIJING.ymin + BEIJING.ymax) / 2
    rows = [(1, "a", [(mid_x, mid_y)]), (2, "a", [(mid_x - 0.001, mid_y - 0.001), (mid_x + 0.001, mid_y + 0.001)]), (3, "a", [(100.0, 10.0), (130.0, 60.0)]), (4, "a", [(BEIJING.xmin, BEIJING.ymin)] * 3), (5, "a", [(BEIJING.xmax, BEIJING.ymax)]), (5, "a", [(116.0, 40.0)])]
    for i in range(150):
        x, y, size = rng.uniform(115.2, 117.9), rng.uniform(38.9, 41.6), 10 ** rng.uniform(-4, 0.3)
        rows.append((10 + i, "r", [(x + rng.uniform(-size, size), y + rng.uniform(-size, size)) for _ in range(rng.randint(1, 9))]))
    return table(spark, rows).cache()


WINDOWS = [(115.2, 38.9, 117.9, 41.6), (116.55, 40.24, 116.57, 40.26), (116.56, 40.25, 116.56, 40.25), (115.29, 39.0, 115.29, 39.0), (120.0, 50.0, 140.0, 70.0), (90.0, 5.0, 110.0, 20.0), (116.0, 39.5, 116.9, 40.0), (117.82, 41.4, 118.5, 42.0), (10.0, 10.0, 11.0, 11.0)]


def test_all_indexes_agree_with_brute_force(spark, odd):
    made = [indexes.ShapeIndex(resolution=6), indexes.ShapeIndex(resolution=7, alpha=4, beta=2), indexes.XZIndex(resolution=6), indexes.XZPlusIndex(resolution=5, alpha=5, beta=3), indexes.XZStarIndex(resolution=6), indexes.CurveIndex(bits=12), indexes.AdaptiveIndex(resolution=6)]
    made.append(indexes.BMTreeIndex(bmtree.learn(odd, WINDOWS, BEIJING, depth=3)))
    made.append(theta.learn(odd, BEIJING, bits=10, layouts=8))
    want = {q: sorted(map(tuple, range_query.brute_force(odd, w).select("oid", "tid").collect())) for q, w in enumerate(WINDOWS)}
    assert want[0] and want[2] and want[3] and want[4] and not want[8]
    for index in made:
        keyed = index.index(odd)
        keyed = spark.createDataFrame(keyed.collect(), keyed.schema)  # the key is worked out; what is asked for below is the filter
        assert keyed.count() == odd.count(), index
        found = range_query.range_queries(keyed, index, list(enumerate(WINDOWS))).collect()
        for q in want:
            assert sorted((r.oid, r.tid) for r in found if r.qid == q) == want[q], (index, q)
    few = range_query.candidate_counts(keyed, index, list(enumerate(WINDOWS))).collect()
    assert all(len(want[r.qid]) <= r.candidates <= odd.count() for r in few)


def test_batch_join_agrees(spark, odd):
    got = range_query.batch_join(odd, workloads.windows_list(spark, list(enumerate(WINDOWS)))).collect()
    for q, w in enumerate(WINDOWS):
        assert sorted((r.oid, r.tid) for r in got if r.qid == q) == sorted(map(tuple, range_query.brute_force(odd, w).select("oid", "tid").collect()))


def test_many_whole_extent_windows(spark, odd):
    """They have every cell, but only their four outer ones travel."""
    whole = [(q, (115.29, 39.0, 117.83, 41.5)) for q in range(300)]
    want = range_query.brute_force(odd, whole[0][1]).count()
    got = range_query.batch_join(odd, workloads.windows_list(spark, whole)).groupBy("qid").count().collect()
    assert len(got) == 300 and {r["count"] for r in got} == {want}
    index = indexes.ShapeIndex(resolution=5)
    got = range_query.range_queries(index.index(odd), index, whole).groupBy("qid").count().collect()
    assert len(got) == 300 and {r["count"] for r in got} == {want}


def test_similarity_by_key_ranges_loses_nothing(spark, odd):
    keys = spark.createDataFrame([(1, 10, "r"), (2, 5, "a"), (3, 4, "a"), (4, 3, "a"), (5, 60, "r"), (6, 90, "r")], "qid int, oid bigint, tid string")
    q = similarity.as_queries(odd, keys).dropDuplicates(["qid"])  # of an id with two rows, one asks
    q = spark.createDataFrame(q.collect(), q.schema)
    made = [indexes.ShapeIndex(resolution=6), indexes.XZIndex(resolution=6), indexes.XZPlusIndex(resolution=5, alpha=4, beta=3), indexes.XZStarIndex(resolution=7), indexes.CurveIndex(bits=12), indexes.AdaptiveIndex(resolution=6), indexes.BMTreeIndex()]
    every = odd.count()
    for i, index in enumerate(made):
        kind = ("frechet", "hausdorff", "dtw")[i % 3]
        keyed = index.index(odd)
        keyed = spark.createDataFrame(keyed.collect(), keyed.schema)
        want = sorted(map(tuple, similarity.within(odd, q, 0.5, kind).collect()))
        assert sorted(map(tuple, similarity.within_indexed(keyed, index, q, 0.5, kind).collect())) == want
        for k in (0, 3, 500) if not i else (3,):
            want = sorted(map(tuple, similarity.nearest(odd, q, k, kind).collect()))
            assert sorted(map(tuple, similarity.nearest_indexed(keyed, index, q, k, kind).collect())) == want, (index.name, kind, k)
        left = {r.qid: r.candidates for r in similarity.candidate_counts(keyed, index, q, 0.05).collect()}
        assert len(left) == 6 and left[5] < every and all(n <= every for n in left.values())


def test_plans_of_several_windows_are_united():
    index, some = indexes.ShapeIndex(resolution=6), WINDOWS[:8]
    plans = [index.plan(w) for w in some]
    one = united(plans)
    held = lambda ranges, k: any(lo <= k <= hi for lo, hi in ranges)
    for p in plans:
        assert all(held(one.ranges, lo) and held(one.ranges, hi) for lo, hi in p.ranges)
        assert all(held(one.sure, node) or masks[0] in one.masks[node] for node, masks in p.masks.items())
    assert not any(held(one.sure, node) for node in one.masks)


def test_a_node_with_very_many_shapes_is_toured_whole(spark):
    rows = spark.range(1, 5000).selectExpr("1L AS quad", "id * 13 % 65536 AS shape", "1L AS n")
    got = sorted((r.shape_order, r.shape) for r in indexes.shape_orders(rows, "quad").collect())
    left = {s for _, s in got}
    assert [o for o, _ in got] == list(range(4999))
    here = min(left)
    for i, (_, s) in enumerate(got[:400]):
        assert s == here
        left.discard(s)
        here = min(left, key=lambda x: ((x ^ s).bit_count(), x))


def test_side_tables_and_dropping(spark, odd):
    path = work_dir(spark, "side")
    index = indexes.AdaptiveIndex(resolution=6)
    table = tables.write_table(odd, index, path)
    shapes = tables.write_shape_table(table, path)
    assert shapes.agg(F.sum("n")).first()[0] == odd.count()
    assert shapes.groupBy("q_order").agg(F.max("shape_order").alias("m"), F.count("*").alias("c")).where("m <> c - 1").count() == 0
    side = tables.write_index_table(table, path)
    assert side.agg(F.sum("n")).first()[0] == odd.count()
    assert tables.drop_table(spark, path) and not tables.drop_table(spark, path)


def test_suite_from_a_file(spark, small, tmp_path):
    from trailmark.cli import main

    text = model.to_text(events.trajectories(spark.read.parquet(f"{small}/events.parquet")))
    text.write.text(str(tmp_path / "trips"))
    one = text.first().value.split("-")
    windows = [[116.0, 39.5, 116.6, 40.3], [115.5, 39.1, 116.0, 39.9]]
    suite = {"datasets": [{"name": "trips", "path": str(tmp_path / "trips"), "windows": windows, "queries": [[int(one[0]), one[1]]]}], "methods": ["XZSTAR"], "topKValues": [3], "similarityThresholds": [0.2], "outputDir": str(tmp_path / "out")}
    (tmp_path / "suite.json").write_text(json.dumps(suite))
    main(["suite", str(tmp_path / "suite.json")])
    lines = (tmp_path / "out" / "similarity.csv").read_text().splitlines()
    assert lines[0] == experiments.COLUMNS["similarity"] and len(lines) == 3
    rows = [dict(zip(lines[0].split(","), x.split(","), strict=True)) for x in lines[1:]]
    n = text.count()
    assert all(0 < float(r["avg_candidates"]) < n and float(r["avg_row_key_ranges"]) > 0 for r in rows) and float(rows[0]["avg_final_size"]) == 3
    assert (tmp_path / "out" / "comparison.csv").read_text().count("\n") == 2
    with pytest.raises(ValueError):
        experiments.config("{}")
    main(["dump", str(tmp_path / "trips"), "116.0,39.5,116.6,40.3", str(tmp_path / "dump")])
    assert (tmp_path / "dump" / "verdict=correct").exists()
    experiments.write_statistics(str(tmp_path / "s.csv"), [experiments.Measure(float(i), i, 2 * i, 1) for i in range(1, 11)])
    assert (tmp_path / "s.csv").read_text().splitlines()[3] == "candidates,2,20,11,12,14,16,18"


def test_tables_and_their_description_come_back(spark, odd):
    for index in (indexes.ShapeIndex(alpha=4), indexes.CurveIndex(), indexes.AdaptiveIndex(), indexes.BMTreeIndex((indexes.BMNode(1, 1, 2), indexes.BMNode(-1), indexes.BMNode(-1)))):
        path = work_dir(spark, "test")
        tables.write_table(odd, index, path)
        rows, back = tables.read_table(spark, path)
        assert back == index
        assert range_query.range_query(rows, back, WINDOWS[6]).count() == range_query.brute_force(odd, WINDOWS[6]).count()


def test_key_ranges_reach_the_scan(spark, odd):
    index = indexes.CurveIndex()
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = range_query.range_query(tables.write_table(odd, index), index, WINDOWS[6])._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "GreaterThanOrEqual(max_sfc" in pushed and "LessThanOrEqual(idx" in pushed and "LessThanOrEqual(xmin" in pushed


def test_order_files_round_trip(odd):
    index = indexes.AdaptiveIndex().build(odd)
    back = orders.from_json(orders.to_json(index))
    assert back.nodes == index.nodes
    other = orders.curve_order(index, indexes.CurveIndex(bits=8))
    assert sorted(n["quad"] for n in other.nodes) == sorted(n["quad"] for n in index.nodes)
    assert range_query.range_query(other.index(odd), other, WINDOWS[6]).count() == range_query.brute_force(odd, WINDOWS[6]).count()


def test_nearest_edge_cases(spark):
    t = table(spark, [(i, "t", [(116.0 + i / 100, 40.0)]) for i in range(5)] + [(2, "t", [(117.0, 41.0)]), (9, "t", [(116.01, 40.0)])])
    keys = spark.createDataFrame([(1, 0, "t")], "qid int, oid bigint, tid string")
    q = similarity.as_queries(t, keys)
    assert similarity.nearest(t, q, 0, "dtw").count() == 0
    far = similarity.nearest(t, q, 50, "frechet").orderBy("rnk").collect()
    assert [(r.oid, r.dist) for r in far] == [(1, 0.01), (9, 0.01), (2, 0.02), (3, 0.03), (4, 0.04)]
    assert [r.oid for r in similarity.nearest(t, q, 1, "hausdorff").collect()] == [1]
    assert {r.oid for r in similarity.within(t, q, 0.02, "dtw").collect()} == {1, 2, 9}
    assert similarity.within(t, q, 0.0, "frechet").count() == 0


@pytest.mark.parametrize("kind", ["frechet", "hausdorff", "dtw"])
def test_pruning_loses_nothing(spark, odd, kind):
    q = similarity.as_queries(odd, spark.createDataFrame([(1, 10, "r"), (2, 2, "a"), (3, 3, "a")], "qid int, oid bigint, tid string"))
    every = similarity.all_pairs(odd, q, kind).groupBy("qid", "oid", "tid").agg(F.min("dist").alias("dist"))
    want = every.where("dist <= 0.8").collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, similarity.within(odd, q, 0.8, kind).collect()))
    verdicts = reports.compared_distances(every.where("dist <= 0.8"), similarity.within(odd, q, 0.8, kind)).groupBy("verdict").count().collect()
    assert [r.verdict for r in verdicts] == ["correct"]
    for k in (1, 7):
        ranked = sorted((r.dist, r.oid, r.tid) for r in every.where("qid = 1").collect())[:k]
        assert ranked == sorted((r.dist, r.oid, r.tid) for r in similarity.nearest(odd, q, k, kind).where("qid = 1").collect())


def test_layouts(spark):
    lines = [
        "7-a-MULTIPOINT ((-1.5 2.25 1000), (3 -4 2000))",
        "8-b-LINESTRING(1 2, 3 4)",
        "9|c|s|1,2; ;3;5,6",
        "10,d,s,LINESTRING (1 2, 3 4)",
        "11,e,s,MULTIPOINT Z (1 2 5000)",
        "  ",
        "12-f-POINT (1e1 2)",
        "nonsense",
        "x-y-POINT (1 2)",
        "13|g|s|",
        "14-h-POLYGON ((1 2))",
    ]
    df = spark.createDataFrame([(s,) for s in lines] + [(None,)], "value string")
    rows = {r.oid: r for r in parse.parsed(df).collect()}
    assert sorted(rows) == [7, 8, 9, 10, 11, 12]
    assert [tuple(p) for p in rows[7].points] == [(-1.5, 2.25, 1000), (3.0, -4.0, 2000)]
    assert [tuple(p) for p in rows[9].points] == [(1.0, 2.0, None), (5.0, 6.0, None)] and rows[9].sid == "s"
    assert rows[10].layout == "csv" and rows[8].layout == "standard" and rows[12].points[0].x == 10.0
    assert {r.reason for r in parse.rejected(df).collect()} == {"unknown layout", "oid is no number", "no points"}
    t = model.trajectories(parse.parsed(df))
    again = model.trajectories(parse.parsed(model.to_text(t)))
    assert sorted((r.oid, r.xs, r.ys, r.ts) for r in again.collect()) == sorted((r.oid, r.xs, r.ys, r.ts) for r in t.collect())


def test_workloads(spark, tmp_path):
    (tmp_path / "w.txt").write_text("1,2,3,4\nbad\n1,2,3\n5,6,7,8\n")
    (tmp_path / "w.json").write_text('[{"query": "1,2,3,4", "range_meters": 500}, {"query": "5,6,7,8", "range_meters": 1000}]')
    rows = [tuple(r) for r in workloads.windows_text(spark, f"file://{tmp_path}/w.txt").select("qid", "xmin", "ymax").orderBy("qid").collect()]
    assert rows == [(1, 1.0, 4.0), (2, 5.0, 8.0)]
    assert {(r.range_meters, r.xmin) for r in workloads.windows_json(spark, f"file://{tmp_path}/w.json").collect()} == {(500, 1.0), (1000, 5.0)}
    assert workloads.windows_inline(spark, "1,2,3,4; 5,6,7,8").count() == 2
    assert workloads.window_path("b", "skewed", 500) == "b/range/skewed/skewed_500m.txt"


def test_pivots_prefilter_loses_nothing(spark, odd):
    t = dp.with_features(odd)
    for w in WINDOWS[:3]:
        assert range_query.brute_force(t.where(dp.boxes_meet([w[0] - 1e-6, w[1] - 1e-6, w[2] + 1e-6, w[3] + 1e-6])), w).count() == range_query.brute_force(odd, w).count()


def test_polygon_border_counts(spark):
    t = table(spark, [(1, "t", [(116.0, 40.0)]), (2, "t", [(116.5, 40.5)]), (3, "t", [(117.2, 40.1)])])
    assert {r.oid for r in range_query.polygon_query(t, [(116.0, 40.0), (117.0, 40.0), (117.0, 41.0), (116.0, 41.0)]).collect()} == {1, 2}


def test_reports(spark):
    rows = spark.createDataFrame([("a", i, float(i), 1, 2, 3) for i in range(3)] + [("b", 0, 9.0, 1, 2, 3)], "`case` string, seq int, latency_ms double, ranges int, candidates int, finals int")
    means = {r["case"]: r for r in reports.case_means(rows).collect()}
    assert means["a"].avg_latency_ms == 1.5 and means["b"].avg_latency_ms == 9.0 and means["a"].query_count == 2
    assert experiments.statistics([5, 1, 4, 2, 3]) == (1, 5, 3, 3, 3, 4, 4) and experiments.statistics([]) == (0,) * 7


def test_experiments(spark, small, tmp_path):
    data = events.trajectories(spark.read.parquet(f"{small}/events.parquet")).cache()
    windows = [(116.0, 39.5, 116.6, 40.3), (115.5, 39.1, 116.0, 39.9)]
    rows = experiments.comparison(spark, data, {("uniform", 100): windows}, ["shape", "lmsfc"])
    assert len(rows) == 2 and rows[0][-2] == rows[1][-2]  # the same answers
    experiments.write_csv(str(tmp_path / "c.csv"), "comparison", rows)
    assert (tmp_path / "c.csv").read_text().splitlines()[0] == experiments.COLUMNS["comparison"]
    assert len(experiments.ablation(spark, data, windows[:1])) == 4
    queries, builds = experiments.parameter_study(spark, data, windows[:1], resolutions=(6,), min_trajs=(2,))
    assert len(queries) == len(builds) == 2
    assert {r.verdict for r in experiments.validate(data, indexes.XZStarIndex(), windows).collect()} == {"correct"}
    first = data.select("oid", "tid").orderBy("oid", "tid").limit(1).withColumn("qid", F.lit(1)).select("qid", "oid", "tid")
    assert len(experiments.similarity_suite(data, first, ["frechet"], [5], [0.1])) == 2


def test_a_stream_fills_a_table(spark, small, tmp_path):
    p = events.points(spark.read.parquet(f"{small}/events.parquet")).select("oid", F.col("ts").cast("timestamp").alias("ts"), "xi", "yi")
    p.coalesce(1).write.parquet(str(tmp_path / "in"))
    index = indexes.CurveIndex()
    stream = assemble.sessions(spark.readStream.schema(p.schema).parquet(str(tmp_path / "in")), "1 day")
    query = assemble.write_stream(stream, index, str(tmp_path / "table"), str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    rows = spark.read.parquet(str(tmp_path / "table" / "rows"))
    assert 0 < rows.count() <= assemble.sessions(p, "1 day").count() and rows.where("idx > max_sfc").count() == 0


def test_stream_and_batch_agree(spark, small, tmp_path):
    p = events.points(spark.read.parquet(f"{small}/events.parquet")).select("oid", F.col("ts").cast("timestamp").alias("ts"), "xi", "yi")
    p.coalesce(2).write.parquet(str(tmp_path / "in"))
    # the last, late point lets the watermark pass the others
    batch = {(r.oid, r.tid, tuple(r.xs)) for r in assemble.sessions(p, "1 day").collect()}
    stream = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    query = assemble.sessions(stream, "1 day").writeStream.outputMode("append").format("memory").queryName("trips").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.oid, r.tid, tuple(r.xs)) for r in spark.table("trips").collect()}
    assert got and got <= batch
    assert len(list(itertools.chain(batch))) >= len(got)
