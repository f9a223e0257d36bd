"""The library's queries over the event fixture, and SQL that gives the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark import experiments, model
from trailmark.functions import codecs, distance, dp
from trailmark.learn import bmtree, theta
from trailmark.operators import range_query, reports, similarity
from trailmark.plans import indexes, ranges
from trailmark.session import work_dir
from trailmark.sources import events, orders, parse, tables, workloads
from trailmark.sources.workloads import windows_list

WINDOWS = (
    (1, (116.0, 40.0, 116.05, 40.05)),
    (2, (115.8, 39.5, 116.6, 40.3)),
    (3, (115.29, 39.0, 117.83, 41.5)),
    (4, (10.0, 10.0, 11.0, 11.0)),
    (5, (116.5, 38.0, 117.9, 39.4)),
    (6, (116.29, 40.1, 116.29, 41.2)),
)
QUERIES = ((1, 3, "0"), (2, 5, "2"), (3, 8, "1"))
EPS = {"frechet": 0.45, "hausdorff": 0.4, "dtw": 6.0}
K = 10
RESOLUTION = 8
SHAPE = indexes.ShapeIndex(resolution=RESOLUTION)
CURVE = indexes.CurveIndex()
BMTREE = indexes.BMTreeIndex(nodes=tuple(indexes.BMNode(d, left, right) for d, left, right in ((1, 1, 2), (0, 3, 4), (1, 5, 6))) + (indexes.BMNode(-1),) * 4)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.trajectories(_events(spark, sf_dir))


def _key_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUERIES), "qid int, oid bigint, tid string")


def traj_build(spark, sf_dir):
    return trips(spark, sf_dir).select("oid", "tid", "n", F.array_join(F.transform("xs", lambda v: v.cast("string")), ",").alias("xs"), F.array_join(F.transform("ys", lambda v: v.cast("string")), ",").alias("ys"))


def traj_envelope(spark, sf_dir):
    return trips(spark, sf_dir).select("oid", "tid", "xmin", "ymin", "xmax", "ymax", F.round(F.col("xmax") - F.col("xmin"), 9).alias("width"), F.round(F.col("ymax") - F.col("ymin"), 9).alias("height"))


def traj_endpoints(spark, sf_dir):
    return trips(spark, sf_dir).select("oid", "tid", "start_x", "start_y", "end_x", "end_y", F.unix_seconds("start_time").alias("start_s"), F.unix_seconds("end_time").alias("end_s"))


def quantise(spark, sf_dir):
    p = events.points(_events(spark, sf_dir))
    pts = F.array(F.struct((F.col("xi") / F.lit(1e6)).alias("x"), (F.col("yi") / F.lit(1e6)).alias("y"), (F.col("t") * 1000).cast("bigint").alias("t")))
    xs, ys, ts = model.quantised(pts)
    return p.select("event_id", xs[0].alias("x"), ys[0].alias("y"), ts[0].cast("bigint").alias("t"))


def _range(index) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The table is built and stored as the index wants it, then read back and asked."""
        index_ = index() if isinstance(index, type) else index
        stored = tables.write_table(trips(spark, sf_dir), index_)
        return range_query.range_queries(stored, index_, WINDOWS)

    return run


def range_bruteforce(spark, sf_dir):
    t = trips(spark, sf_dir)
    parts = [range_query.brute_force(t, w).select(F.lit(q).alias("qid"), "oid", "tid") for q, w in WINDOWS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def range_batch_join(spark, sf_dir):
    return range_query.batch_join(trips(spark, sf_dir), windows_list(spark, WINDOWS))


def range_polygon(spark, sf_dir):
    return range_query.polygon_query(trips(spark, sf_dir), [(115.8, 39.5), (116.9, 39.7), (116.2, 40.9)]).select("oid", "tid")


def range_count(spark, sf_dir):
    return range_bruteforce(spark, sf_dir).groupBy("qid").agg(F.count("*").alias("n"))


def candidate_count_lmsfc(spark, sf_dir):
    return range_query.candidate_counts(CURVE.index(trips(spark, sf_dir)), CURVE, WINDOWS)


def quad_level(spark, sf_dir):
    return SHAPE.index(trips(spark, sf_dir)).select("oid", "tid", "level")


def quad_code(spark, sf_dir):
    return SHAPE.index(trips(spark, sf_dir)).select("oid", "tid", "quad")


def shape_signature(spark, sf_dir):
    return SHAPE.index(trips(spark, sf_dir)).select("oid", "tid", "shape", "idx")


def shape_stats(spark, sf_dir):
    return reports.shape_counts(SHAPE.index(trips(spark, sf_dir)))


def union_mask(spark, sf_dir):
    return reports.quad_shapes(SHAPE.index(trips(spark, sf_dir)))


def lmsfc_interval(spark, sf_dir):
    return CURVE.index(trips(spark, sf_dir)).select("oid", "tid", F.col("idx").alias("min_sfc"), "max_sfc")


def range_merge(spark, sf_dir):
    e = _events(spark, sf_dir)
    rows = e.select((F.col("user_id") % 50).alias("qid"), ((F.col("event_id") * 7919) % 100_000).alias("lo"), ((F.col("event_id") * 7919) % 100_000 + F.col("event_id") % 90).alias("hi"), (F.col("event_id") % 3 == 0).alias("contained"))
    return ranges.merge_ranges(rows)


def _queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = trips(spark, sf_dir)
    return t, similarity.as_queries(t, _key_frame(spark))


def _pairs(kind: str):
    return lambda spark, sf_dir: similarity.all_pairs(*_queries(spark, sf_dir), kind)


def _similar(kind: str):
    return lambda spark, sf_dir: similarity.within(*_queries(spark, sf_dir), EPS[kind], kind)


def _nearest(kind: str):
    return lambda spark, sf_dir: similarity.nearest(*_queries(spark, sf_dir), K, kind)


def mbr_lower_bound(spark, sf_dir):
    t, q = _queries(spark, sf_dir)
    rows = similarity._paired(t, q, F.lit(True))
    return rows.select("qid", "oid", "tid", F.round(distance.lower_bound(model.points_of("qxs", "qys"), similarity._box()), 9).alias("lb"))


def validate_sets(spark, sf_dir):
    index = CURVE.index(trips(spark, sf_dir))
    found = range_query.range_queries(index, CURVE, WINDOWS[:2])
    # one answer is taken away and one put in, so that all verdicts occur
    found = found.where(~((F.col("qid") == 2) & (F.col("oid") % 7 == 0))).unionAll(found.where("qid = 1").select(F.lit(9).alias("qid"), "oid", "tid"))
    truth = range_bruteforce(spark, sf_dir).where("qid <= 2")
    return reports.compared(truth, found, ["qid", "oid", "tid"]).groupBy("qid", "verdict").agg(F.count("*").alias("n"))


def workload_stats(spark, sf_dir):
    rows = trips(spark, sf_dir).select((F.col("oid") % 10).alias("g"), F.col("n").alias("v"))
    return reports.workload_stats(rows, "g", "v")


def profile_stats(spark, sf_dir):
    rows = _events(spark, sf_dir).select((F.col("event_id") % 3).cast("string").alias("method"), "event_type", (F.col("event_id") % 97).cast("double").alias("value"))
    return reports.profile_stats(rows.withColumnRenamed("event_type", "metric"))


def _text(layout: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = trips(spark, sf_dir)
        deg = lambda v: (v.cast("decimal(20,6)") / 1_000_000).cast("decimal(20,6)").cast("string")
        pairs = F.zip_with("xs", "ys", lambda x, y: F.struct(deg(x).alias("x"), deg(y).alias("y")))
        if layout == "pipe":
            line = F.concat_ws("|", "oid", "tid", F.lit("s1"), F.array_join(F.transform(pairs, lambda p: F.concat(p.x, F.lit(","), p.y)), ";"))
        elif layout == "csv":
            line = F.concat_ws(",", "oid", "tid", F.lit("s1"), F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(pairs, lambda p: F.concat(p.x, F.lit(" "), p.y)), ", "), F.lit(")")))
        else:
            line = F.concat_ws("-", F.col("oid").cast("string"), "tid", model.to_wkt(F.col("xs"), F.col("ys"), F.col("ts")))
        back = model.trajectories(parse.parsed(t.select(line.alias("value"))))
        total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, v: a + v)
        return back.select("oid", "tid", "sid", "n", total("xs").alias("sx"), total("ys").alias("sy"), total("ts").alias("st"))

    return run


def codec_roundtrip(spark, sf_dir):
    t = trips(spark, sf_dir).select("oid", "tid", "xs")
    out = None
    for name in codecs.NAMES:
        c = codecs.encoded(name)("xs")
        rows = t.withColumn("c", c).select(F.lit(name).alias("codec"), F.col("xs").eqNullSafe(codecs.decoded(name)("c")).alias("same"))
        rows = rows.groupBy("codec").agg(F.count("*").alias("n"), F.sum(F.col("same").cast("bigint")).alias("n_same"))
        out = rows if out is None else out.unionAll(rows)
    return out


def dp_pivots(spark, sf_dir):
    return dp.with_features(trips(spark, sf_dir)).select("oid", "tid", "pivots", F.size("pivot_mbrs").alias("n_boxes"))


def shape_order_greedy(spark, sf_dir):
    return indexes.shape_orders(reports.shape_counts(SHAPE.index(trips(spark, sf_dir))), "quad").select("quad", "shape", "n", "shape_order")


def theta_learn(spark, sf_dir):
    best = theta.learn(trips(spark, sf_dir), model.BEIJING, bits=12, layouts=24)
    return spark.createDataFrame([(i, t) for i, t in enumerate(best.theta)], "place int, bit int")


def bmtree_learn(spark, sf_dir):
    nodes = bmtree.learn(trips(spark, sf_dir), [w for _, w in WINDOWS], model.BEIJING, bits=12, depth=4)
    return spark.createDataFrame([(i, n.dim, n.left, n.right, n.child) for i, n in enumerate(nodes)], "id int, dim int, left int, right int, child int")


# -- stored tables and what lies beside them


def range_stored(spark, sf_dir):
    """The table and its index are read back by path alone."""
    path = work_dir(spark, "stored")
    tables.write_table(trips(spark, sf_dir), indexes.XZStarIndex(), path)
    table, index = tables.read_table(spark, path)
    return range_query.range_queries(table, index, WINDOWS)


def range_side_table(spark, sf_dir):
    """By way of the side table of keys."""
    path = work_dir(spark, "stored")
    table = tables.write_table(trips(spark, sf_dir), SHAPE, path)
    side = tables.write_index_table(table, path)
    near = tables.looked_up(table, SHAPE, side, [w for _, w in WINDOWS])
    return range_query.range_queries(near, SHAPE, WINDOWS)


def index_table(spark, sf_dir):
    return tables.write_index_table(SHAPE.index(trips(spark, sf_dir)), work_dir(spark, "side"))


def _order_file(spark: SparkSession, sf_dir: str) -> str:
    path = work_dir(spark, "order")
    orders.write_order(spark, indexes.AdaptiveIndex().build(trips(spark, sf_dir)), path)
    return path


def order_file(spark, sf_dir):
    rows = spark.read.text(_order_file(spark, sf_dir), wholetext=True)
    node = "parent STRUCT<level: INT, ix: BIGINT, iy: BIGINT, element_code: BIGINT, count: BIGINT, alpha: INT, beta: INT>, coverage STRUCT<effective_subtree_count: BIGINT>"
    rows = rows.select(F.explode(F.from_json("value", f"ordering ARRAY<STRUCT<order: BIGINT, {node.replace('parent STRUCT', 'parent: STRUCT').replace('coverage STRUCT', 'coverage: STRUCT')}>>").ordering).alias("o"))
    return rows.select("o.order", "o.parent.level", "o.parent.ix", "o.parent.iy", F.col("o.parent.element_code").alias("quad"), F.col("o.parent.count").alias("n"), "o.parent.alpha", "o.parent.beta", F.col("o.coverage.effective_subtree_count").alias("n_below"))


def order_by_curve(spark, sf_dir):
    index = orders.curve_order(orders.read_order(spark, _order_file(spark, sf_dir)), CURVE)
    return spark.createDataFrame([(n["order"], n["level"], n["quad"]) for n in index.nodes], "order bigint, level int, quad bigint")


def range_order_file(spark, sf_dir):
    """A table keyed by an index that was read from its file and put into a curve's order."""
    index = orders.curve_order(orders.read_order(spark, _order_file(spark, sf_dir)), CURVE)
    return range_query.range_queries(tables.write_table(trips(spark, sf_dir), index), index, WINDOWS)


def curve_file(spark, sf_dir):
    index = theta.from_text(theta.to_text(CURVE), CURVE.extent)
    return spark.createDataFrame(list(enumerate(index.theta)), "bit bigint, place bigint")


def tree_file(spark, sf_dir):
    index = bmtree.from_text(bmtree.to_text(BMTREE.nodes, BMTREE.bits), BMTREE.extent)
    return spark.createDataFrame([(i, n.dim, n.left, n.right) for i, n in enumerate(index.nodes)], "id int, dim int, left_child int, right_child int")


def _lines(spark: SparkSession, sf_dir: str) -> str:
    path = work_dir(spark, "lines")
    model.to_text(trips(spark, sf_dir)).write.text(path)
    return path


def parse_files(spark, sf_dir):
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, v: a + v)
    back = model.trajectories(parse.read_text(spark, _lines(spark, sf_dir)))
    return back.select("oid", "tid", "n", total("xs").alias("sx"), total("ys").alias("sy"))


def parse_rejected(spark, sf_dir):
    """Lines of which some lack what a trajectory needs, and why they are left out."""
    i = F.col("event_id")
    line = F.when(i % 5 == 0, F.concat(F.lit("no layout "), i)).when(i % 5 == 1, F.concat(F.lit("x|t|s|1,2;3,"), i)).when(i % 5 == 2, F.concat(F.lit("7|t|s|one,two;"), i)).when(i % 5 == 3, F.concat(F.lit("7-t-POINT ("), i, F.lit(" 2)"))).otherwise(F.lit("  "))
    return parse.rejected(_events(spark, sf_dir).select(line.alias("value"))).groupBy("reason").agg(F.count("*").alias("n"))


def query_lines(spark, sf_dir):
    return workloads.query_trajectories(spark, _lines(spark, sf_dir)).select("oid", "tid", F.size("points").alias("n"))


def _window_files(layout: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A workload is written, with lines that are none, and read back."""
        path, said = work_dir(spark, "windows"), [",".join(map(str, w)) for _, w in WINDOWS]
        if layout == "inline":
            rows = workloads.windows_inline(spark, "; ".join([*said, " "]))
        elif layout == "json":
            text = json.dumps([{"query": w, "range_meters": 500} for w in [*said, "1,2,3"]])
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
            rows = workloads.windows_json(spark, path)
        else:
            spark.createDataFrame([("\n".join([*said, "1,2,3", "", "a,b,c,d"]),)], "value string").coalesce(1).write.text(path)
            rows = workloads.windows_text(spark, path)
        return rows.select("qid", "xmin", "ymin", "xmax", "ymax")

    return run


# -- similarity by key ranges


def _indexed(index, run: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t, q = _queries(spark, sf_dir)
        index_ = index() if isinstance(index, type) else index
        return run(tables.write_table(t, index_), index_, q)

    return query


def candidate_count_similarity(spark, sf_dir):
    t, q = _queries(spark, sf_dir)
    return similarity.candidate_counts(CURVE.index(t), CURVE, q, EPS["frechet"])


def range_pivots(spark, sf_dir):
    """The covering boxes of the pivots sort out rows before the points are looked at."""
    t = dp.with_features(trips(spark, sf_dir))
    parts = [t.where(dp.boxes_meet(w)).where(range_query.meets(range_query._sides(w))).select(F.lit(q).alias("qid"), "oid", "tid") for q, w in WINDOWS]
    return reduce(DataFrame.unionAll, parts)


# -- reports and experiments


def compared_distances(spark, sf_dir):
    every = similarity.all_pairs(*_queries(spark, sf_dir), "hausdorff")
    found = every.where("oid % 5 <> 0").withColumn("dist", F.col("dist") + F.when(F.col("oid") % 7 == 0, 1.0).otherwise(0.0))
    return reports.compared_distances(every, found).groupBy("qid", "verdict").agg(F.count("*").alias("n"))


def case_means(spark, sf_dir):
    i = F.col("event_id")
    rows = _events(spark, sf_dir).select((i % 400).alias("case"), F.floor(i / 400).alias("seq"), (i % 97).cast("double").alias("latency_ms"), (i % 13).alias("ranges"), (i % 101).alias("candidates"), (i % 7).alias("finals"))
    rows = reports.case_means(rows)
    return rows.select("case", *(F.round(c, 6).alias(c) for c in rows.columns if c.startswith("avg")), "query_count")


def validation_dump(spark, sf_dir):
    rows = experiments.dump_validation(trips(spark, sf_dir), SHAPE, [w for _, w in WINDOWS], work_dir(spark, "dump"))
    return rows.select((F.col("qid") + 1).alias("qid"), "oid", "tid", "verdict")


def experiment_comparison(spark, sf_dir):
    rows = experiments.comparison(spark, trips(spark, sf_dir), {("given", 1000): [w for _, w in WINDOWS]}, ["shape", "xzstar", "lmsfc", "adaptive"])
    return spark.createDataFrame([(r[3], float(r[7]), r[8]) for r in rows], "method string, avg_final double, query_count bigint")


def experiment_parameters(spark, sf_dir):
    queries, builds = experiments.parameter_study(spark, trips(spark, sf_dir), [w for _, w in WINDOWS[:2]], resolutions=(6, 8), min_trajs=(2,))
    return spark.createDataFrame([(b[2], b[3], b[4], b[5], q[8]) for q, b in zip(queries, builds, strict=True)], "study string, resolution int, min_traj int, trajectory_count bigint, query_count bigint")


def experiment_ablation(spark, sf_dir):
    rows = experiments.ablation(spark, trips(spark, sf_dir), [w for _, w in WINDOWS[:2]])
    return spark.createDataFrame([(r[0], r[1], r[2], float(r[8]), r[9]) for r in rows], "variant string, order_source string, adaptive_partition boolean, avg_final double, query_count bigint")


def experiment_similarity(spark, sf_dir):
    t = trips(spark, sf_dir)
    rows = experiments.similarity_suite(t, _key_frame(spark), ["frechet"], [K], [EPS["frechet"]], methods=["shape"])
    return spark.createDataFrame([(r[1], float(r[3]), float(r[9]), r[11]) for r in rows], "query_type string, parameter_value double, avg_final_size double, query_count bigint")


def table_size(spark, sf_dir):
    return reports.table_size(trips(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        traj_build, traj_envelope, traj_endpoints, quantise, range_bruteforce, range_batch_join, range_polygon, range_count, candidate_count_lmsfc,
        quad_level, quad_code, shape_signature, shape_stats, union_mask, lmsfc_interval, range_merge, mbr_lower_bound, validate_sets, workload_stats,
        profile_stats, table_size, codec_roundtrip, dp_pivots, shape_order_greedy, theta_learn, bmtree_learn,
        range_stored, range_side_table, index_table, order_file, order_by_curve, range_order_file, curve_file, tree_file, parse_files, parse_rejected,
        query_lines, candidate_count_similarity, range_pivots, compared_distances, case_means, validation_dump, experiment_comparison,
        experiment_parameters, experiment_ablation, experiment_similarity,
    )
    out = {f.__name__: f for f in plain}
    for name, index in (("shape", SHAPE), ("xz", indexes.XZIndex()), ("xzplus", indexes.XZPlusIndex()), ("xzstar", indexes.XZStarIndex()), ("lmsfc", CURVE), ("bmtree", BMTREE), ("adaptive", indexes.AdaptiveIndex)):
        out[f"range_{name}"] = _range(index)
    for kind in distance.KINDS:
        out |= {f"{kind}_pairs": _pairs(kind), f"similarity_{kind}": _similar(kind), f"topk_{kind}": _nearest(kind)}
    for layout in ("standard", "pipe", "csv_wkt"):
        out[f"parse_{layout}"] = _text(layout.removesuffix("_wkt"))
    for layout in ("text", "json", "inline"):
        out[f"windows_{layout}"] = _window_files(layout)
    for name, index in INDEXED:
        out[f"similarity_{name}"] = _indexed(index, lambda table, index, q: similarity.within_indexed(table, index, q, EPS["frechet"], "frechet"))
        out[f"topk_{name}"] = _indexed(index, lambda table, index, q: similarity.nearest_indexed(table, index, q, K, "frechet"))
    return out


#: Indexes whose similarity queries have a place of their own.
INDEXED = (("shape", SHAPE), ("xzstar", indexes.XZStarIndex()), ("adaptive", indexes.AdaptiveIndex), ("lmsfc", CURVE))


# -- SQL

_PTS = f"""
p AS (SELECT user_id AS oid, CAST(floor((epoch_us(ts) // 1000000 - {events.EPOCH}) / {events.WEEK}.0) AS BIGINT)::VARCHAR AS tid, ts, event_id, epoch_us(ts) // 1000000 AS t,
             115290000 + (user_id * 7919) % 1000 * 2300 + CAST(round(value * 100) AS BIGINT) * 3 AS xi,
             39000000 + (user_id * 104729) % 1000 * 2300 + (event_id * 37) % 1000 * 150 AS yi FROM events),
pts AS (SELECT *, xi / 1e6 AS x, yi / 1e6 AS y FROM p),
w(qid, x0, y0, x1, y1) AS (VALUES {", ".join(f"({q}, {', '.join(f'{v!r}::DOUBLE' for v in w)})" for q, w in WINDOWS)}),
mbr AS (SELECT oid, tid, count(*)::INT AS n, min(xi) AS x0, min(yi) AS y0, max(xi) AS x1, max(yi) AS y1 FROM pts GROUP BY oid, tid),
tr AS (SELECT oid, tid, list({{'x': x, 'y': y}} ORDER BY ts, event_id) AS p FROM pts GROUP BY oid, tid),
hit AS (SELECT DISTINCT qid, oid, tid FROM pts JOIN w ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)"""
_WITH = f"WITH RECURSIVE {_PTS}"


def _sql_fine(v: str, axis: int, bits: int) -> str:
    lo, hi = model.BEIJING.micro()[axis], model.BEIJING.micro()[axis + 2]
    return f"greatest(0, least({(1 << bits) - 1}, CAST(floor(({v} - {lo}) * {1 << bits} / {float(hi - lo)}) AS BIGINT)))"


def _sql_nodes() -> str:
    r, a, b = RESOLUTION, SHAPE.alpha, SHAPE.beta
    fits = ", ".join(f"CASE WHEN (fx1 >> {r - lev}) - (fx0 >> {r - lev}) < {a} AND (fy1 >> {r - lev}) - (fy0 >> {r - lev}) < {b} THEN {lev} ELSE 0 END" for lev in range(r + 1))
    code = " + ".join(f"CASE WHEN level >= {lev} THEN 1 + ((fx0 >> {r - lev} & 1) + 2 * (fy0 >> {r - lev} & 1)) * {(4 ** (r - lev + 1) - 1) // 3} ELSE 0 END" for lev in range(1, r + 1))
    return f"""{_WITH},
f AS (SELECT *, {_sql_fine("x0", 0, r)} AS fx0, {_sql_fine("y0", 1, r)} AS fy0, {_sql_fine("x1", 0, r)} AS fx1, {_sql_fine("y1", 1, r)} AS fy1 FROM mbr),
l AS (SELECT *, greatest({fits}) AS level FROM f),
q AS (SELECT *, ({code})::BIGINT AS quad, (1 << ({r} - level)) AS cw FROM l),
c AS (SELECT DISTINCT q.oid, q.tid, ({_sql_fine("xi", 0, r)} // cw - fx0 // cw) * {b} + {_sql_fine("yi", 1, r)} // cw - fy0 // cw AS bit FROM pts JOIN q ON q.oid = pts.oid AND q.tid = pts.tid),
s AS (SELECT oid, tid, sum(1::BIGINT << bit)::BIGINT AS shape FROM c GROUP BY oid, tid),
node AS (SELECT q.*, shape, (quad << {a * b}) | shape AS idx FROM q JOIN s USING (oid, tid))"""


def _sql_curve() -> str:
    x, y = CURVE.theta[: CURVE.bits], CURVE.theta[CURVE.bits :]
    key = lambda u, v: " | ".join([f"((({u}) >> {i} & 1) << {t})" for i, t in enumerate(x)] + [f"((({v}) >> {i} & 1) << {t})" for i, t in enumerate(y)])
    b = CURVE.bits
    return f"""{_WITH},
f AS (SELECT *, {_sql_fine("x0", 0, b)} AS fx0, {_sql_fine("y0", 1, b)} AS fy0, {_sql_fine("x1", 0, b)} AS fx1, {_sql_fine("y1", 1, b)} AS fy1 FROM mbr),
k AS (SELECT oid, tid, ({key("fx0", "fy0")})::BIGINT AS min_sfc, ({key("fx1", "fy1")})::BIGINT AS max_sfc FROM f)"""


_PAIRS = f"""{_WITH},
qk(qid, oid, tid) AS (VALUES {", ".join(f"({q}, {o}, '{t}')" for q, o, t in QUERIES)}),
q AS (SELECT qid, qk.oid AS qo, qk.tid AS qt, p AS q FROM qk JOIN tr ON tr.oid = qk.oid AND tr.tid = qk.tid),
pair AS (SELECT qid, oid, tid, p, q FROM q JOIN tr ON NOT (oid = qo AND tid = qt))"""


def _sql_distance(kind: str) -> str:
    far = lambda a, b: f"sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"
    if kind == "hausdorff":
        return f"""{_PAIRS},
cell AS (SELECT qid, oid, tid, i, j, {far("p[i]", "q[j]")} AS d FROM pair, unnest(range(1, len(p) + 1)) AS a(i), unnest(range(1, len(q) + 1)) AS b(j)),
pq AS (SELECT qid, oid, tid, max(d) AS d FROM (SELECT qid, oid, tid, i, min(d) AS d FROM cell GROUP BY ALL) GROUP BY qid, oid, tid),
qp AS (SELECT qid, oid, tid, max(d) AS d FROM (SELECT qid, oid, tid, j, min(d) AS d FROM cell GROUP BY ALL) GROUP BY qid, oid, tid),
dist AS (SELECT qid, oid, tid, round(greatest(pq.d, qp.d), 9) AS dist FROM pq JOIN qp USING (qid, oid, tid))"""
    f = (lambda d, m: f"greatest({d}, {m})") if kind == "frechet" else (lambda d, m: f"{d} + {m}")
    inf = "'infinity'::DOUBLE"
    return f"""{_PAIRS},
m(qid, oid, tid, p, q, i, r) AS (SELECT qid, oid, tid, p, q, 0, list_transform(q, lambda v: {inf}) FROM pair
 UNION ALL SELECT qid, oid, tid, p, q, i + 1, list_reduce(list_transform(range(1, len(q) + 1), lambda k: {{
   'd': [CASE WHEN k = 1 THEN {f(far("p[i + 1]", "q[1]"), f"CASE WHEN i = 0 THEN 0.0 ELSE r[1] END")} ELSE {far("p[i + 1]", "q[k]")} END],
   'a': r[k], 'b': CASE WHEN k = 1 THEN {inf} ELSE r[k - 1] END}}),
   lambda acc, v: {{'d': list_append(acc.d, {f("v.d[1]", "least(v.a, v.b, acc.d[len(acc.d)])")}), 'a': v.a, 'b': v.b}}).d
 FROM m WHERE i < len(p)),
dist AS (SELECT qid, oid, tid, round(r[len(r)], 9) AS dist FROM m WHERE i = len(p))"""


def oracle_sql() -> dict[str, str]:
    hit = f"{_WITH} SELECT qid, oid, tid FROM hit"
    out = {f"range_{n}": hit for n in ("bruteforce", "batch_join", "shape", "xz", "xzplus", "xzstar", "lmsfc", "bmtree", "adaptive", "stored", "side_table", "order_file", "pivots")}
    ring = [(115.8, 39.5), (116.9, 39.7), (116.2, 40.9)]
    sides = " AND ".join(f"(x - {x1}) * ({y2} - {y1}) - (y - {y1}) * ({x2} - {x1}) <= 0" for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True))
    out |= {
        "range_polygon": f"{_WITH} SELECT DISTINCT oid, tid FROM pts WHERE {sides}",
        "range_count": f"{_WITH} SELECT qid, count(*) AS n FROM hit GROUP BY qid",
        "traj_build": f"{_WITH} SELECT oid, tid, count(*)::INT AS n, string_agg(xi::VARCHAR, ',' ORDER BY ts, event_id) AS xs, string_agg(yi::VARCHAR, ',' ORDER BY ts, event_id) AS ys FROM pts GROUP BY oid, tid",
        "traj_envelope": f"{_WITH} SELECT oid, tid, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, round(max(x) - min(x), 9) AS width, round(max(y) - min(y), 9) AS height FROM pts GROUP BY oid, tid",
        "traj_endpoints": f"""{_WITH}, o AS (SELECT *, row_number() OVER (PARTITION BY oid, tid ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY oid, tid ORDER BY ts DESC, event_id DESC) AS b FROM pts)
SELECT s.oid, s.tid, s.x AS start_x, s.y AS start_y, e.x AS end_x, e.y AS end_y, s.t AS start_s, e.t AS end_s FROM o s JOIN o e ON s.oid = e.oid AND s.tid = e.tid WHERE s.a = 1 AND e.b = 1""",
        "quantise": f"{_WITH} SELECT event_id, CAST(trunc(x * 1000000) AS INT) AS x, CAST(trunc(y * 1000000) AS INT) AS y, t FROM pts",
        "quad_level": f"{_sql_nodes()} SELECT oid, tid, level FROM node",
        "quad_code": f"{_sql_nodes()} SELECT oid, tid, quad FROM node",
        "shape_signature": f"{_sql_nodes()} SELECT oid, tid, shape, idx FROM node",
        "shape_stats": f"{_sql_nodes()} SELECT quad, shape, count(*) AS n FROM node GROUP BY quad, shape",
        "union_mask": f"{_sql_nodes()} SELECT quad, count(DISTINCT shape) AS n_shapes, bit_or(shape) AS union_mask, count(*) AS n FROM node GROUP BY quad",
        "lmsfc_interval": f"{_sql_curve()} SELECT oid, tid, min_sfc, max_sfc FROM k",
        "candidate_count_lmsfc": f"{_sql_curve()}, c(qid, lo, hi) AS (VALUES {', '.join(f'({q}, {CURVE.interval(w)[0]}, {CURVE.interval(w)[1]})' for q, w in WINDOWS)}) SELECT qid, count(k.oid) AS candidates FROM c LEFT JOIN k ON min_sfc <= hi AND max_sfc >= lo GROUP BY qid",
        "range_merge": """WITH r AS (SELECT user_id % 50 AS qid, event_id * 7919 % 100000 AS lo, event_id * 7919 % 100000 + event_id % 90 AS hi, event_id % 3 = 0 AS contained FROM events),
s AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY qid ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS st FROM r),
i AS (SELECT *, sum(st) OVER (PARTITION BY qid ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isl FROM s)
SELECT qid, min(lo) AS lo, max(hi) AS hi, bool_and(contained) AS contained FROM i GROUP BY qid, isl""",
        "mbr_lower_bound": f"""{_PAIRS}, b AS (SELECT oid, tid, x0 / 1e6 AS x0, y0 / 1e6 AS y0, x1 / 1e6 AS x1, y1 / 1e6 AS y1 FROM mbr),
u AS (SELECT qid, oid, tid, unnest(q) AS v FROM pair),
d AS (SELECT qid, oid, tid, greatest(x0 - v.x, v.x - x1, 0.0) AS dx, greatest(y0 - v.y, v.y - y1, 0.0) AS dy FROM u JOIN b USING (oid, tid))
SELECT qid, oid, tid, round(max(sqrt(dx * dx + dy * dy)), 9) AS lb FROM d GROUP BY qid, oid, tid""",
        "validate_sets": f"""{_WITH}, truth AS (SELECT * FROM hit WHERE qid <= 2),
found AS (SELECT * FROM truth WHERE NOT (qid = 2 AND oid % 7 = 0) UNION ALL SELECT 9, oid, tid FROM truth WHERE qid = 1)
SELECT coalesce(t.qid, f.qid) AS qid, CASE WHEN f.qid IS NULL THEN 'missing' WHEN t.qid IS NULL THEN 'extra' ELSE 'correct' END AS verdict, count(*) AS n
FROM truth t FULL JOIN found f ON t.qid = f.qid AND t.oid = f.oid AND t.tid = f.tid GROUP BY 1, 2""",
        "workload_stats": f"""{_WITH}, g AS (SELECT oid % 10 AS g, list(n::BIGINT ORDER BY n) AS v, sum(n)::BIGINT AS s FROM mbr GROUP BY 1)
SELECT g, v[1] AS min_v, v[len(v)] AS max_v, s // len(v) AS avg_v, v[len(v) // 2 + 1] AS mid_v, v[greatest(floor(len(v) * 0.7::DOUBLE)::INT - 1, 0) + 1] AS p70,
       v[greatest(floor(len(v) * 0.8::DOUBLE)::INT - 1, 0) + 1] AS p80, v[greatest(floor(len(v) * 0.9::DOUBLE)::INT - 1, 0) + 1] AS p90 FROM g""",
        "profile_stats": """WITH r AS (SELECT (event_id % 3)::VARCHAR AS method, event_type AS metric, (event_id % 97)::DOUBLE AS v FROM events),
g AS (SELECT method, metric, list(v ORDER BY v) AS v, avg(v) AS a, max(v) AS m FROM r GROUP BY ALL)
SELECT method, metric, len(v)::INT AS n, v[1] AS min_v, v[len(v)] AS max_v, a AS avg_v, v[ceil(len(v) * 0.5::DOUBLE)::INT] AS p50, v[ceil(len(v) * 0.9::DOUBLE)::INT] AS p90 FROM g WHERE m > 0""",
        "table_size": f"{_WITH} SELECT count(*) AS n_trajectories, sum(n)::BIGINT AS n_points, sum(8 + length(tid) + 12 * n)::BIGINT AS n_bytes FROM mbr",
    }
    for layout, sid, st in (("standard", "NULL::VARCHAR", "sum(t)::BIGINT"), ("pipe", "'s1'", "NULL::BIGINT"), ("csv_wkt", "'s1'", "NULL::BIGINT")):
        out[f"parse_{layout}"] = f"{_WITH} SELECT oid, tid, {sid} AS sid, count(*)::INT AS n, sum(xi)::BIGINT AS sx, sum(yi)::BIGINT AS sy, {st} AS st FROM pts GROUP BY oid, tid"
    for kind in distance.KINDS:
        d = _sql_distance(kind)
        out[f"{kind}_pairs"] = f"{d} SELECT qid, oid, tid, dist FROM dist"
        out[f"similarity_{kind}"] = f"{d} SELECT qid, oid, tid, dist FROM dist WHERE dist <= {EPS[kind]}"
        if kind == "hausdorff":
            out["compared_distances"] = f"""{d},
found AS (SELECT qid, oid, tid, dist + CASE WHEN oid % 7 = 0 THEN 1 ELSE 0 END AS dist FROM dist WHERE oid % 5 <> 0)
SELECT qid, CASE WHEN f.dist IS NULL THEN 'missing' WHEN abs(t.dist - f.dist) > 1e-9 THEN 'mismatch' ELSE 'correct' END AS verdict, count(*) AS n
FROM dist t LEFT JOIN found f USING (qid, oid, tid) GROUP BY ALL"""
        out[f"topk_{kind}"] = f"{d} SELECT * FROM (SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY dist, oid, tid))::INT AS rnk, oid, tid, dist FROM dist) WHERE rnk <= {K}"
    for name, _ in INDEXED:
        out |= {f"similarity_{name}": out["similarity_frechet"], f"topk_{name}": out["topk_frechet"]}
    return out | _more_sql()


def _sql_adaptive() -> str:
    """The kept nodes: of every trajectory's node all ancestors, counted."""
    r = RESOLUTION
    code = " + ".join(f"CASE WHEN lev >= {k} THEN 1 + ((ix >> (lev - {k}) & 1) + 2 * (iy >> (lev - {k}) & 1)) * {(4 ** (r - k + 1) - 1) // 3} ELSE 0 END" for k in range(1, r + 1))
    sub_ = " ".join(f"WHEN {k} THEN {(4 ** (r - k + 1) - 1) // 3}" for k in range(r + 1))
    return f"""{_sql_nodes()},
up AS (SELECT lev::INT AS lev, (fx0 >> ({r} - lev)::INT)::BIGINT AS ix, (fy0 >> ({r} - lev)::INT)::BIGINT AS iy, count(*) AS n FROM node, unnest(generate_series(0, level)) AS t(lev) GROUP BY ALL),
kept AS (SELECT *, ({code.replace("(lev - ", "greatest(0, lev - ")})::BIGINT AS quad, CASE lev {sub_} END AS size FROM up WHERE n >= 4 OR lev = 0),
nodes AS (SELECT row_number() OVER (ORDER BY quad) - 1 AS "order", lev AS level, ix, iy, quad, n, size, CASE WHEN n >= 64 THEN 4 WHEN n >= 8 THEN 3 ELSE 2 END AS alpha FROM kept)"""


def _sql_pivots() -> str:
    """Stretches split at the point farthest from their chord."""
    off = """CASE WHEN p[s] = p[e] THEN sqrt((p[j].x - p[s].x) ** 2 + (p[j].y - p[s].y) ** 2)
      ELSE abs((p[e].x - p[s].x) * (p[j].y - p[s].y) - (p[e].y - p[s].y) * (p[j].x - p[s].x)) / sqrt((p[e].x - p[s].x) ** 2 + (p[e].y - p[s].y) ** 2) END"""
    far = f"list_transform(range(s + 1, e), lambda j: round({off}, 12))"
    split = f"CASE WHEN e - s > 1 AND list_max({far}) > {dp.PRECISION} THEN s + list_position({far}, list_max({far})) END"
    return f"""{_WITH},
st(oid, tid, s, e) AS (SELECT oid, tid, 1::BIGINT, len(p)::BIGINT FROM tr
 UNION ALL SELECT oid, tid, CASE WHEN h = 0 THEN s ELSE k END, CASE WHEN h = 0 THEN k ELSE e END
 FROM (SELECT st.oid, st.tid, s, e, {split} AS k FROM st JOIN tr ON tr.oid = st.oid AND tr.tid = st.tid) AS b, (VALUES (0), (1)) AS halves(h) WHERE k IS NOT NULL),
fin AS (SELECT st.oid, st.tid, s, e FROM st JOIN tr ON tr.oid = st.oid AND tr.tid = st.tid WHERE {split} IS NULL)
SELECT oid, tid, CASE WHEN max(e) = 1 THEN [0] ELSE list_prepend(0, list((e - 1)::INT ORDER BY e)) END AS pivots, count(*)::INT AS n_boxes FROM fin GROUP BY oid, tid"""


def _more_sql() -> dict[str, str]:
    hits = "c AS (SELECT w.qid, count(hit.oid) AS k FROM w LEFT JOIN hit USING (qid) GROUP BY w.qid)"
    b = CURVE.bits
    spread = " | ".join(f"((x >> {i} & 1) << {t}) | ((y >> {i} & 1) << {u})" for i, (t, u) in enumerate(zip(CURVE.theta[:b], CURVE.theta[b:], strict=True)))
    key = lambda x, y: "(" + " | ".join([f"((({x}) >> {i} & 1) << {t})" for i, t in enumerate(CURVE.theta[:b])] + [f"((({y}) >> {i} & 1) << {t})" for i, t in enumerate(CURVE.theta[b:])]) + ")::BIGINT"
    by = EPS["frechet"] + 1e-9 + 1e-6
    cell = lambda v, sign, axis: _sql_fine(f"({v} / 1e6 {sign} {by!r}::DOUBLE) * 1e6", axis, b)
    frechet = _sql_distance("frechet")
    n_queries = len(QUERIES)
    windows = "SELECT * FROM (VALUES " + ", ".join(f"({q}, {', '.join(f'{v!r}::DOUBLE' for v in w)})" for q, w in WINDOWS) + ") AS t(qid, xmin, ymin, xmax, ymax)"
    cells = [(i, n.dim, n.left, n.right) for i, n in enumerate(BMTREE.nodes)]
    return {
        "codec_roundtrip": f"{_WITH} SELECT codec, count(*) AS n, count(*) AS n_same FROM mbr, (VALUES {', '.join(f"('{c}')" for c in codecs.NAMES)}) AS t(codec) GROUP BY codec",
        "shape_order_greedy": f"""{_sql_nodes()},
g AS (SELECT quad, list(DISTINCT shape ORDER BY shape) AS s FROM node GROUP BY quad), sn AS (SELECT quad, shape, count(*) AS n FROM node GROUP BY ALL),
t(quad, here, rest, i) AS (SELECT quad, s[1], s[2:], 0::BIGINT FROM g
 UNION ALL SELECT quad, nx, list_filter(rest, lambda x: x <> nx), i + 1
 FROM (SELECT quad, rest, i, list_min(list_transform(rest, lambda x: (bit_count(xor(x, here))::BIGINT << 32) | x)) & 4294967295 AS nx FROM t WHERE len(rest) > 0))
SELECT t.quad, t.here AS shape, n, i AS shape_order FROM t JOIN sn ON sn.quad = t.quad AND sn.shape = t.here""",
        "dp_pivots": _sql_pivots(),
        "index_table": f"{_sql_nodes()} SELECT idx, count(*) AS n FROM node GROUP BY idx",
        "order_file": f"""{_sql_adaptive()} SELECT a."order", a.level, a.ix, a.iy, a.quad, a.n, a.alpha, a.alpha AS beta, count(*) AS n_below
FROM nodes a JOIN nodes b ON b.quad BETWEEN a.quad AND a.quad + a.size - 1 GROUP BY ALL""",
        "order_by_curve": f"""{_sql_adaptive()}, xy AS (SELECT *, ix << ({RESOLUTION} - level + {b - RESOLUTION}) AS x, iy << ({RESOLUTION} - level + {b - RESOLUTION}) AS y FROM nodes)
SELECT row_number() OVER (ORDER BY k, level, quad) - 1 AS "order", level, quad FROM (SELECT *, {spread} AS k FROM xy)""",
        "curve_file": f"SELECT i AS bit, CASE WHEN i < {b} THEN 2 * i ELSE 2 * (i - {b}) + 1 END AS place FROM range({2 * b}) AS t(i)",
        "tree_file": f"SELECT * FROM (VALUES {', '.join(map(str, cells))}) AS t(id, dim, left_child, right_child)",
        "parse_files": f"{_WITH} SELECT oid, tid, count(*)::INT AS n, sum(xi)::BIGINT AS sx, sum(yi)::BIGINT AS sy FROM pts GROUP BY oid, tid",
        "parse_rejected": "SELECT CASE event_id % 5 WHEN 0 THEN 'unknown layout' WHEN 1 THEN 'oid is no number' ELSE 'no points' END AS reason, count(*) AS n FROM events WHERE event_id % 5 < 3 GROUP BY 1",
        "query_lines": f"{_WITH} SELECT oid, tid, n FROM mbr",
        "windows_text": windows,
        "windows_json": windows,
        "windows_inline": windows,
        "candidate_count_similarity": f"""{_PAIRS},
ask AS (SELECT qid, oid, tid, {key(cell("x0", "-", 0), cell("y0", "-", 1))} AS lo, {key(cell("x1", "+", 0), cell("y1", "+", 1))} AS hi FROM qk JOIN mbr USING (oid, tid)),
rows_ AS (SELECT oid, tid, {key(_sql_fine("x0", 0, b), _sql_fine("y0", 1, b))} AS k0, {key(_sql_fine("x1", 0, b), _sql_fine("y1", 1, b))} AS k1 FROM mbr)
SELECT qid, count(r.oid) AS candidates FROM ask LEFT JOIN rows_ r ON k0 >= lo AND k1 <= hi AND NOT (r.oid = ask.oid AND r.tid = ask.tid) GROUP BY qid""",
        "case_means": """WITH r AS (SELECT event_id % 400 AS "case", event_id // 400 AS seq, (event_id % 97)::DOUBLE AS l, event_id % 13 AS a, event_id % 101 AS b, event_id % 7 AS c FROM events),
k AS (SELECT *, count(*) OVER (PARTITION BY "case") AS n FROM r)
SELECT "case", round(avg(l), 6) AS avg_latency_ms, round(avg(a), 6) AS avg_ranges, round(avg(b), 6) AS avg_candidates, round(avg(c), 6) AS avg_finals, count(*) AS query_count
FROM k WHERE seq > 0 OR n = 1 GROUP BY 1""",
        "validation_dump": f"{_WITH} SELECT qid, oid, tid, 'correct' AS verdict FROM hit",
        "experiment_comparison": f"{_WITH}, {hits} SELECT method, avg(k) AS avg_final, count(*) AS query_count FROM c, (VALUES ('shape'), ('xzstar'), ('lmsfc'), ('adaptive')) AS m(method) WHERE qid > 1 GROUP BY method",
        "experiment_parameters": f"""{_WITH} SELECT study, resolution, min_traj, (SELECT count(*) FROM mbr) AS trajectory_count, 1::BIGINT AS query_count
FROM (VALUES ('resolution', 6, 4), ('resolution', 8, 4), ('min_traj', 8, 2)) AS t(study, resolution, min_traj)""",
        "experiment_ablation": f"""{_WITH}, {hits} SELECT variant, order_source, adaptive_partition, k::DOUBLE AS avg_final, 1::BIGINT AS query_count
FROM c, (VALUES ('base', 'preorder', true), ('theta order', 'lmsfc', true), ('tree order', 'bmtree', true), ('one mask size', 'preorder', false)) AS v(variant, order_source, adaptive_partition) WHERE qid = 2""",
        "experiment_similarity": f"""{frechet}, n AS (SELECT count(*) AS every, count(*) FILTER (dist <= {EPS["frechet"]}) AS near FROM dist), per AS (SELECT sum(least({K}, c)) AS top FROM (SELECT qid, count(*) AS c FROM dist GROUP BY qid))
SELECT 'similarity' AS query_type, {EPS["frechet"]}::DOUBLE AS parameter_value, near / {n_queries}.0::DOUBLE AS avg_final_size, {n_queries}::BIGINT AS query_count FROM n
UNION ALL SELECT 'top_k', {K}::DOUBLE, (top / {n_queries}.0)::DOUBLE, {n_queries}::BIGINT FROM per""",
    }
