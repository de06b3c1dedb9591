"""Queries over the driver's tables, by name, and the SQL that tells their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparstrata.functions.storage import dealt, fresh_path, written
from sparstrata.jobs import sql
from sparstrata.operators import analysis, blocks, counters, features, groups, levels, matrix, pieces, plan_net, schedule, search, solve, tune
from sparstrata.sources import fixtures as fx
from sparstrata.sources import market, market_source

SZ = """sz as (select ns, ns+np_ po, ns+np_+no oc_, ns+np_+no+nc m from (select (select count(*) from supplier) ns, (select count(*) from part) np_, (select count(*) from orders) no, (select count(*) from customer) nc)),
 al as (select unnest(range(m)) r from sz)"""
F1 = f"""{SZ}, f1 as materialized (select i, j, ((n*5+i+j)%7+1)/16.0::double v from (select ns + l_partkey i, l_suppkey j, count(*) n from lineitem, sz group by 1,2
 union all select po + l_orderkey, ns + l_partkey, count(*) from lineitem, sz group by 1,2 union all select oc_ + o_custkey, po + o_orderkey, count(*) from orders, sz group by 1,2)
 union all select r, r, 8.0::double from al)"""
RHS = "rhs as (select r i, ((r%5+1)/8.0)::double b from al)"
SQ = """sq as (select i, j, (((i*7+j)%9+1)/16.0)::double v from (select distinct l_orderkey i, l_partkey j from lineitem))"""
SKEW = "sk as (select distinct cast(case when event_id%4=0 then 0 else event_id//8+1 end as bigint) i, cast(event_id as bigint) j from events)"
PERF = """perf as (select cast(user_id as bigint) matrix, cast(event_id%12 as bigint) plan, min(value)+1 "time" from events group by 1,2)"""
LEV = """p(i,k) as (select r, 0 from al union select o.i, p.k+1 from p join f1 o on o.j=p.i and o.i<>o.j),
 lev as (select i, cast(max(k) as bigint) level from p group by i)"""
ROWS = "rn as materialized (select i, count(*) n from f1 group by i)"
THRESH = """th as materialized (select i, n, case when n>4 then i else st + ((i-st)//32)*32 end g from
 (select i, n, coalesce(max(case when n>4 then i+1 end) over (order by i rows unbounded preceding), 0) st from rn))"""
SOLVE = """with recursive {f1}, {rhs}, y(i,k,v) as (select i, 0, b/8.0::double from rhs union all
 select o.{a}, y.k+1, -sum(o.v*y.v)/8.0::double from y join f1 o on o.{b}=y.i and o.i<>o.j group by o.{a}, y.k)
 select i, sum(v) x from y group by i"""
FORWARD = SOLVE.format(f1=F1, rhs=RHS, a="i", b="j")
# joined one by one: with both at once the plan may begin with a join of all pairs of groups
ENDS = """em as materialized (select o.j, a.g dst from f1 o join th a on a.i=o.i where o.i<>o.j), en as materialized (select b.g src, dst from em join th b on b.i=em.j)"""
GLEV = f"""{ENDS}, ge as materialized (select distinct dst i, src j from en where src<dst), gi as materialized (select distinct dst g from en where src=dst),
 q(i,k) as (select distinct g, 0 from th union select o.i, q.k+1 from q join ge o on o.j=q.i),
 gt as materialized (select th.g, count(*) n_rows, cast(sum(n) as bigint) nnz, (select cast(max(k) as bigint) from q where q.i=th.g) as level,
  cast((case when count(*)>=8 or exists(select 1 from gi where gi.g=th.g) then 1 else 0 end) + (case when sum(n)>256 then 2 else 0 end)
  + (case when exists(select 1 from gi where gi.g=th.g) then 0 else 256 end) as bigint) flags from th group by th.g)"""
GROUPED = f"with recursive {F1}, {ROWS}, {THRESH}, {GLEV}"
PACK = ", pk as (select g, level part, rn//4 pack, rn%4 lane, nnz from (select *, row_number() over (partition by level order by {order}) - 1 rn from gt))"
ORD = """, od as (select part, pack, (row_number() over (order by part, pack)) - 1 ordinal, cast(sum(nnz) as bigint) "load" from pk group by part, pack)"""
SIMPLE, BALANCED = PACK.format(order="g"), PACK.format(order="nnz desc, g")


def _starts(steps: int = 20) -> str:
    """SQL of st(s): 0 and all that nx(s, nxt) reaches from it, by jumps over twice as many groups at each step."""
    parts = ["r0 as materialized (select 0::bigint s)", "j0 as materialized (select s, nxt from nx where nxt <= (select max(i) from rn))"]
    for k in range(steps):
        parts.append(f"r{k + 1} as materialized (select s from r{k} union select j{k}.nxt from r{k} join j{k} using (s))")
        parts.append(f"j{k + 1} as materialized (select a.s, b.nxt from j{k} a join j{k} b on b.s = a.nxt)")
    return ", ".join(parts) + f", st as (select s from r{steps}), gs as (select i, n, max(s) over (order by i rows unbounded preceding) g from rn left join st on st.s = rn.i)"


NODEP = """{with_}, pr as (select i, max(j) p from {entries} where j<i group by i), ct as (select s, min(i) stop from (select i, unnest(range(greatest(0, i-{alpha}+1), p+1)) s from pr where i-p<{alpha}) group by s),
 nx as (select rn.i s, coalesce(ct.stop, rn.i+{alpha}) nxt from rn left join ct on ct.s = rn.i), {starts} select i, n, g from gs"""
BLOCK_SQL = """with sz as (select (select count(*) from supplier) + (select count(*) from part) + (select count(*) from orders) + (select count(*) from customer) m), t as (select unnest(range(8)) k, m//8 n, m from sz)
 select cast(2*k as bigint) block, 'triangle' kind, k*n up, case when k=7 then m else n*(k+1) end down, k*n "left", case when k=7 then m else n*(k+1) end "right" from t
 union all select cast(2*k+1 as bigint), 'rectangle', n*(k+1), case when k+1+((k+1) & (-(k+1))) = 8 then m else n*(k+1+((k+1) & (-(k+1)))) end, n*(k+1-((k+1) & (-(k+1)))), n*(k+1) from t where k<7"""

# a matrix that grows with orders: each customer's orders are a chain
OC = """oc as (select i, rn, c, 8.0::double d, one, three, (i+one)%5+1 v1, (i+three)%5+1 v3 from (select cast(o_orderkey as bigint) i, o_custkey c,
 row_number() over (partition by o_custkey order by o_orderkey) rn, cast(lag(o_orderkey, 1) over (partition by o_custkey order by o_orderkey) as bigint) one,
 cast(lag(o_orderkey, 3) over (partition by o_custkey order by o_orderkey) as bigint) three from orders)),
 oe as (select i, one j, v1::double v from oc where one is not null union all select i, three, v3::double from oc where three is not null union all select i, i, 8.0::double from oc)"""
OLEV = "ol as (select i, rn - 1 as level from oc)"
CHAIN = """, sx(c, rn, i, x, x1, x2) as (select c, rn, i, (i%7+1)/8.0::double, 0.0::double, 0.0::double from oc where rn = 1
 union all select oc.c, oc.rn, oc.i, ((oc.i%7+1) - (oc.v1*sx.x + coalesce(oc.v3, 0)*sx.x2))/8.0::double, sx.x, sx.x1 from sx join oc on oc.c = sx.c and oc.rn = sx.rn + 1)"""
# chains by nation: as many levels as its customers have orders
NC = """nc as (select *, (i+one)%5+1 v1, (i+three)%5+1 v3 from (select cast(o_orderkey as bigint) i, c_nationkey c, row_number() over w rn, lag(o_orderkey, 1) over w one, lag(o_orderkey, 3) over w three
 from orders join customer on c_custkey = o_custkey window w as (partition by c_nationkey order by o_orderkey)))"""
NATION_SOLVE = f"""with recursive {NC}, sx(c, rn, i, x, x1, x2) as (select c, rn, i, (i%7+1)/16.0::double, 0.0::double, 0.0::double from nc where rn = 1
 union all select nc.c, nc.rn, nc.i, ((nc.i%7+1) - (nc.v1*sx.x + coalesce(nc.v3, 0)*sx.x2))/16.0::double, sx.x, sx.x1 from sx join nc on nc.c = sx.c and nc.rn = sx.rn + 1)
 select i, round(x, 9) x from sx"""
RUNS = """runs as (select cast(user_id as bigint) matrix, cast(event_id%12 as bigint) plan, min(value)+1 "time" from events group by 1,2)"""
INFO = "info as (select cast(user_id as bigint) matrix, count(distinct ts) m, count(*)*10 nnz from events group by 1)"
LORD = "o as (select i, row_number() over (order by level, i) - 1 place from lev)"
KNOWN = "kx as (select a.r, al.r i, ((al.r*7+a.r*3)%10+1)::double x from range(3) a(r), al)"


def _l(spark, d):
    return fx.lower_triangle(spark, d)


def _x(spark, d):
    return _vector(spark, fx.size(spark, d))


def _vector(spark, n):
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") % 5 + 1).cast("double").alias("x"))


def _orders(spark, d):
    parts, orders, customers, m = fx.tiers(spark, d)
    return customers - orders


def _events(spark, d):
    return fx.skewed(spark, d).select(F.col("j").alias("i"), (F.col("j") % 5 + 1).cast("double").alias("x"))


def _lower_half(spark, d, right):
    m = fx.size(spark, d)
    return matrix.block(_l(spark, d), m // 2, m, m // 2 if right else 0, m if right else m // 2)


def _levels(spark, d):
    return levels.level_sets(_l(spark, d))


def _rows(spark, d):
    return matrix.row_counts(_l(spark, d))


def _thresh(spark, d):
    return groups.by_threshold(_rows(spark, d), 4)


def _groups(spark, d):
    """The groups of a plan of thresholds; they are one short row each, written before they are looked at more than once."""
    return written(analysis.analyse(_l(spark, d), analysis.Plan()).drop("part"), "groups")


def _packs(spark, d, balanced=False):
    return schedule.packs(_groups(spark, d), 4, balanced=balanced)


def _o(spark, d):
    return fx.order_chain(spark, d)


def _order(spark, d):
    return levels.level_order(_levels(spark, d))


def many_sides(spark, d):
    """Three right-hand sides made from known solutions, solved together."""
    a = dealt(_l(spark, d), "entries", "i")
    return solve.solve_many(a, solve.known_solution(a, fx.size(spark, d), 3)[1])


def known_error(spark, d):
    a = dealt(_l(spark, d), "entries", "i")
    known, b = solve.known_solution(a, fx.size(spark, d), 3)
    return solve.relative_error(solve.solve_many(a, b), known)


def segments(spark, d):
    values = matrix.row_counts(_o(spark, d)).select("i", F.col("n").alias("v"), (F.col("i") % 37 == 5).alias("flag"))
    return matrix.segment_sums(values)


def chosen_score(spark, d):
    """A plan chooser learned from some matrices, scored on the others."""
    runs = tune.informed(fx.run_log(spark, d), fx.matrix_info(spark, d), 100).withColumn("m", F.col("m").cast("double")).withColumn("size", F.log("nnz"))
    train, test = tune.split_by_matrix(runs)
    model = tune.plan_chooser(train, ["m", "size"])
    return tune.score(tune.chosen_plans(model, test.select("matrix", "m", "size").distinct()), test)


def net_score(spark, d):
    """The plan network and the plan chooser, learned from the same matrices and scored on the others."""
    runs = tune.informed(fx.run_log(spark, d), fx.matrix_info(spark, d), 100).withColumn("size", F.log("nnz"))
    train, test = tune.split_by_matrix(runs)
    new = test.select("matrix", "m", "size").distinct()
    net = plan_net.plan_net(train, ["m", "size"])
    by_net = tune.score(plan_net.chosen_by_net(net, new).select("matrix", "plan"), test).select(F.lit("network").alias("model"), "*")
    one = tune.score(tune.chosen_plans(tune.plan_chooser(train, ["m", "size"]), new), test).select(F.lit("regression").alias("model"), "*")
    return by_net.unionByName(one)


def in_sql(text):
    """A query of SQL text over the views of ``order_chain``."""

    def run(spark, d):
        sql.publish(spark, "chain", _o(spark, d), fx.order_sides(spark, d))
        return spark.sql(text)

    return run


def plan_search(spark, d):
    """The log of a search among plans of neighbouring rows: turns of each, and whether its answer is right."""
    plans = [search.Plan("ROW_BLOCK", alpha, by_level) for alpha, by_level in ((64, True), (1024, True), (64, False))]
    log = search.search(_l(spark, d), fx.right_side(spark, d), "tiers", plans, fresh_path(spark, "search"))
    return log.select("matrix", "strategy", "alpha", "by_level", "turns", (F.col("max_error") <= search.TOLERANCE).alias("right"))


def source_round_trip(spark, d):
    """A matrix written and read back through the data source."""
    market_source.register(spark)
    m, path = fx.order_sides(spark, d).count(), fresh_path(spark, "matrix")
    _o(spark, d).write.format("matrix_market").options(m=m, n=m).mode("append").save(path)
    return spark.read.format("matrix_market").load(path)


def group_pattern(spark, d):
    a = dealt(_l(spark, d).select("i", "j"), "entries", "i")
    return groups.by_pattern(a, written(matrix.row_counts(a), "rows"), 8)


def regrouped(spark, d):
    """Groups by level, and the row that each starts at then."""
    table = _groups(spark, d)
    return levels.regrouped(table.select("g", "n_rows"), table.select("g", "level"))


def _blocks(spark, d, depth=3):
    return spark.createDataFrame(solve.block_bounds(fx.size(spark, d), depth), "block long, kind string, up long, down long, left long, right long")


def block_entries(spark, d):
    """Entries of each block: a range join with the short table of bounds."""
    a = _l(spark, d)
    inside = F.expr("i >= up and i < down and j >= left and j < right")
    found = F.broadcast(_blocks(spark, d)).join(a, inside, "left").groupBy("block", "kind").agg(F.count("i").alias("nnz"), F.countDistinct("i").alias("n_rows"))
    return found


QUERIES = {
    "spmv": lambda s, d: matrix.multiply(_l(s, d), _x(s, d)),
    "spmv_long_row_split": lambda s, d: matrix.multiply_split(fx.skewed(s, d).withColumn("v", F.lit(0.5)), _events(s, d), 64),
    "long_rows": lambda s, d: matrix.long_rows(fx.skewed(s, d), 64),
    "row_histogram": lambda s, d: matrix.row_counts(fx.square(s, d)),
    "row_ptr_scan": lambda s, d: matrix.row_pointers(fx.square(s, d), _orders(s, d)),
    "transpose": lambda s, d: matrix.transpose(fx.square(s, d)),
    "triangularise": lambda s, d: matrix.lower_part(fx.square(s, d), _orders(s, d)),
    "sym_expand": lambda s, d: matrix.expand_symmetric(_l(s, d)),
    "dcsr_rows": lambda s, d: matrix.compact_rows(matrix.transpose(fx.square(s, d))),
    "roots_anti_join": lambda s, d: matrix.roots(_l(s, d)),
    "edges_distinct": lambda s, d: matrix.edges(_l(s, d), _thresh(s, d)),
    "level_sets": lambda s, d: _levels(s, d),
    "level_stats": lambda s, d: levels.level_summary(_levels(s, d)),
    "level_nnz": lambda s, d: levels.level_sizes(_l(s, d), _levels(s, d)),
    "level_order": lambda s, d: levels.level_order(_levels(s, d)),
    "permute_levels": lambda s, d: matrix.permuted(_l(s, d), levels.level_order(_levels(s, d))),
    "solve_level_loop": lambda s, d: solve.solve_levels(_l(s, d), fx.right_side(s, d)),
    "solve_neumann": lambda s, d: solve.solve_series(_l(s, d), fx.right_side(s, d)),
    "solve_backward": lambda s, d: solve.solve_backward(_l(s, d), fx.right_side(s, d)),
    "solve_recblock": lambda s, d: solve.solve_blocks(_l(s, d), fx.right_side(s, d), fx.size(s, d), 2),
    "residual_check": lambda s, d: solve.residual(_l(s, d), solve.solve_levels(_l(s, d), fx.right_side(s, d)), fx.right_side(s, d)),
    "group_block": lambda s, d: groups.by_block(_rows(s, d), 8),
    "group_thresh": lambda s, d: _thresh(s, d),
    "group_avg": lambda s, d: groups.by_average(_rows(s, d), 4),
    "group_level_flags": lambda s, d: _groups(s, d),
    "pack_simple": lambda s, d: _packs(s, d),
    "pack_balance": lambda s, d: _packs(s, d, True),
    "worker_rr": lambda s, d: schedule.round_robin(schedule.ordinals(_packs(s, d)), 8),
    "worker_interleaved": lambda s, d: schedule.interleaved(schedule.ordinals(_packs(s, d)), 8),
    "worker_balance": lambda s, d: schedule.least_loaded(schedule.ordinals(_packs(s, d)), 8),
    "worker_imbalance": lambda s, d: schedule.imbalance(schedule.round_robin(schedule.ordinals(_packs(s, d)), 8)),
    "launch_indep": lambda s, d: schedule.launches(schedule.ordinals(_packs(s, d)), "INDEP_LEVEL"),
    "launch_one": lambda s, d: schedule.launches(schedule.ordinals(_packs(s, d)), "ONE_LEVEL"),
    "launch_thresh": lambda s, d: schedule.launches(schedule.ordinals(_packs(s, d)), "THRESH_LEVEL", 8),
    "recblock_entries": block_entries,
    "features11": lambda s, d: features.features(_l(s, d), _levels(s, d)).select(*[F.round(c, 6).alias(c) if c[:3] in ("avg", "cov", "dep") else c for c in ("m", "nnz", "avg_rnnz", "max_rnnz", "cov_rnnz", "avg_lnnz", "max_lnnz", "cov_lnnz", "dep_dist", "n_levels")]),
    "reverse_level": lambda s, d: features.reverse_level(_levels(s, d)).select(F.round("reverse_level", 9).alias("reverse_level")),
    "tell_layout": lambda s, d: matrix.padded_rows(_l(s, d), 32),
    "plan_labels": lambda s, d: tune.labels(fx.perf_log(s, d)),
    "best_plan": lambda s, d: tune.best_plans(fx.perf_log(s, d)),
    "popular_plan": lambda s, d: tune.popular_plan(fx.perf_log(s, d), 3),
    "order_entries": lambda s, d: _o(s, d),
    "order_levels": lambda s, d: levels.level_sets(_o(s, d)),
    "order_level_order": lambda s, d: levels.level_order(levels.level_sets(_o(s, d))),
    "order_row_pointers": lambda s, d: _order_pointers(s, d),
    "order_product": lambda s, d: matrix.multiply(_o(s, d), fx.order_sides(s, d).withColumnRenamed("b", "x")),
    "order_solve": lambda s, d: solve.solve_levels(_o(s, d), fx.order_sides(s, d)).select("i", F.round("x", 9).alias("x")),
    "order_thresh": lambda s, d: groups.by_threshold(matrix.row_counts(_o(s, d)), 2),
    "order_nodep": lambda s, d: groups.by_independence(_o(s, d), matrix.row_counts(_o(s, d)), 8),
    "group_nodep": lambda s, d: groups.by_independence(_l(s, d), _rows(s, d), 8),
    "group_pattern": group_pattern,
    "segment_sums": segments,
    "market_round_trip": lambda s, d: market.market_round_trip(_o(s, d), fx.order_sides(s, d).count()),
    "permute_vector": lambda s, d: matrix.permuted_vector(_x(s, d), _order(s, d)),
    "unpermute_vector": lambda s, d: matrix.permuted_vector(_x(s, d), _order(s, d), back=True),
    "permute_rows": lambda s, d: matrix.permuted_axis(_l(s, d), _order(s, d), "i"),
    "permute_columns": lambda s, d: matrix.permuted_axis(_l(s, d), _order(s, d), "j"),
    "level_order_backward": lambda s, d: levels.level_order(_levels(s, d), backward=True),
    "vector_subtract": lambda s, d: matrix.subtracted(fx.right_side(s, d), matrix.multiply(fx.skewed(s, d).withColumn("v", F.lit(0.5)), _events(s, d))),
    "sub_triangle": lambda s, d: _lower_half(s, d, True),
    "sub_rectangle": lambda s, d: _lower_half(s, d, False),
    "level_graph_nodes": lambda s, d: levels.level_graph(_l(s, d), _levels(s, d), 3)[0],
    "level_graph_edges": lambda s, d: levels.level_graph(_l(s, d), _levels(s, d), 3)[1],
    "regrouped": regrouped,
    "solve_many": many_sides,
    "known_error": known_error,
    "solve_recblock_backward": lambda s, d: solve.solve_blocks_backward(matrix.transpose(_l(s, d)), fx.right_side(s, d), fx.size(s, d), 2),
    "block_methods": lambda s, d: solve.block_methods(_l(s, d), _blocks(s, d)),
    "solve_reordered": lambda s, d: analysis.solve_and_verify(_l(s, d), fx.right_side(s, d), analysis.Plan(reorder=True))[0],
    "plan_parts": lambda s, d: analysis.analyse(_l(s, d), analysis.Plan(by_level=False)),
    "plan_space": lambda s, d: tune.plan_space(s).join(F.broadcast(tune.best_plans(fx.run_log(s, d)).agg(F.count("*").alias("n_matrices"))), F.lit(True)),
    "runs_informed": lambda s, d: tune.informed(fx.run_log(s, d), fx.matrix_info(s, d), 500),
    "runs_complete": lambda s, d: tune.complete(fx.run_log(s, d), 12),
    "run_labels": lambda s, d: tune.labels(fx.run_log(s, d)),
    "run_throughput": lambda s, d: tune.informed(fx.run_log(s, d), fx.matrix_info(s, d), 0).select("matrix", "plan", *features.throughput(F.col("nnz"), F.col("m"), F.col("time"))),
    "chosen_score": chosen_score,
    "source_round_trip": source_round_trip,
    "rows_round_trip": lambda s, d: market.rows_round_trip(_o(s, d), fx.order_sides(s, d).count()),
    "counter_levels": lambda s, d: counters.levels_by_counters(_o(s, d)),
    "counter_solve": lambda s, d: _rounded(counters.solve_by_counters(_o(s, d), fx.order_sides(s, d))),
    "fused_levels": lambda s, d: pieces.levels_fused(fx.nation_chain(s, d))[0],
    "fused_solve": lambda s, d: _rounded(pieces.solve_fused(fx.nation_chain(s, d), fx.order_sides(s, d))[0]),
    "solve_plan_block": lambda s, d: _planned(s, d, "ROW_BLOCK", 64),
    "solve_plan_thresh": lambda s, d: _planned(s, d, "ROW_BLOCK_THRESH", 4),
    "solve_plan_nodep": lambda s, d: _planned(s, d, "ROW_BLOCK_NODEP", 64),
    "solve_plan_parts": lambda s, d: _planned(s, d, "ROW_BLOCK_AVG", 8, by_level=False),
    "solve_blocks_by_method": lambda s, d: blocks.solve_blocks_by_method(_l(s, d), fx.right_side(s, d), fx.size(s, d), 2),
    "plan_search": plan_search,
    "net_score": net_score,
    "sql_levels": in_sql(sql.LEVELS),
    "sql_solve": in_sql(sql.SOLUTION),
    "sql_features": in_sql(sql.FEATURES),
    "order_reverse_level": lambda s, d: features.reverse_level(levels.level_sets(_o(s, d))).select(F.round("reverse_level", 9).alias("reverse_level")),
}


def _rounded(x):
    return x.select("i", F.round("x", 9).alias("x"))


def _planned(spark, d, strategy, alpha, by_level=True):
    """The solution by a plan's groups."""
    return analysis.solve_planned(_l(spark, d), fx.right_side(spark, d), analysis.Plan(strategy, alpha, by_level))[0]


def _order_pointers(spark, d):
    return matrix.row_pointers(_o(spark, d), fx.order_sides(spark, d).count())

ORACLES = {
    "spmv": f"with {F1} select i, sum(v*((j%5)+1)) y from f1 group by i",
    "spmv_long_row_split": f"with {SKEW} select i, sum(0.5::double*((j%5)+1)) y from sk group by i",
    "long_rows": f"with {SKEW} select i, count(*) n from sk group by i having count(*)>64",
    "row_histogram": f"with {SQ} select i, count(*) n from sq group by i",
    "row_ptr_scan": f"with {SQ} select r i, cast(coalesce(sum(n) over (order by r rows between unbounded preceding and 1 preceding),0) as bigint) ptr from (select r, count(sq.i) n from range((select count(*) from orders)) t(r) left join sq on sq.i=r group by r)",
    "transpose": f"with {SQ} select j i, i j, v from sq",
    "triangularise": f"with {SQ} select i, j, v from sq where j<i union all select r, r, cast(count(sq.i)+2 as double) from range((select count(*) from orders)) t(r) left join sq on sq.i=r and sq.j<r group by r",
    "sym_expand": f"with {F1} select i, j, v from f1 union all select j, i, v from f1 where i<>j",
    "dcsr_rows": f"with {SQ} select i, row_number() over (order by i) - 1 as row from (select distinct j i from sq)",
    "roots_anti_join": f"with {F1} select i from f1 group by i having count(*)=1",
    "edges_distinct": f"with {F1}, {ROWS}, {THRESH}, {ENDS} select distinct src, dst from en where src<dst",
    "level_sets": f"with recursive {F1}, {LEV} select i, level from lev",
    "level_stats": f"with recursive {F1}, {LEV} select count(*) n_levels, cast(sum(n) as bigint) n_rows, min(n) least, max(n) most, sum(n)/count(*) parallelism from (select count(*) n from lev group by level)",
    "level_nnz": f"with recursive {F1}, {LEV}, {ROWS} select level, count(*) n_rows, cast(sum(n) as bigint) nnz, max(n) max_row from lev join rn using(i) group by level",
    "level_order": f"with recursive {F1}, {LEV} select i, row_number() over (order by level, i) - 1 place from lev",
    "permute_levels": f"with recursive {F1}, {LEV}, o as (select i, row_number() over (order by level, i) - 1 place from lev) select a.place i, b.place j, v from f1 join o a on a.i=f1.i join o b on b.i=f1.j",
    "solve_level_loop": FORWARD,
    "solve_neumann": FORWARD,
    "solve_recblock": FORWARD,
    "solve_backward": SOLVE.format(f1=F1, rhs=RHS, a="j", b="i"),
    "residual_check": f"""{FORWARD.rsplit("select", 1)[0].rstrip()}, x as (select i, sum(v) x from y group by i), e as (select rhs.i, abs(b - s) e, abs(b) size
 from rhs join (select f1.i, sum(f1.v*x.x) s from f1 join x on x.i=f1.j group by f1.i) p on p.i=rhs.i)
 select max(e) max_error, (select i from e order by e desc, i limit 1) as "at", sum(e)/sum(size) rel_l1 from e""",
    "group_block": f"with {F1}, {ROWS} select i, n, (i//8)*8 g from rn",
    "group_thresh": f"with {F1}, {ROWS}, {THRESH} select i, n, g from th",
    "group_avg": f"with {F1}, {ROWS} select i, n, case when cast(sum(n) over (partition by i//32) as bigint)//count(*) over (partition by i//32) < 4 then (i//32)*32 else i end g from rn",
    "group_level_flags": f"{GROUPED} select g, n_rows, nnz, level, flags from gt",
    "pack_simple": f"{GROUPED}{SIMPLE} select g, part, pack, lane, nnz from pk",
    "pack_balance": f"{GROUPED}{BALANCED} select g, part, pack, lane, nnz from pk",
    "worker_rr": f'{GROUPED}{SIMPLE}{ORD} select part, pack, ordinal, "load", ordinal%8 worker from od',
    "worker_interleaved": f"{GROUPED}{SIMPLE}{ORD} select ordinal, (ordinal%8%2)*4 + (ordinal%8)//2 worker from od",
    "worker_imbalance": f'{GROUPED}{SIMPLE}{ORD} select count(*) n_workers, min(l) least, max(l) most from (select cast(sum("load") as bigint) l from od group by ordinal%8)',
    "launch_indep": f"{GROUPED}{SIMPLE}{ORD} select part, count(*) n_packs, part launch from od group by part",
    "launch_one": f"{GROUPED}{SIMPLE}{ORD} select part, count(*) n_packs, 0::bigint launch from od group by part",
    "launch_thresh": f"{GROUPED}{SIMPLE}{ORD} select part, n_packs, cast(coalesce(sum(case when n_packs>=8 then 1 else 0 end) over (order by part rows between unbounded preceding and 1 preceding),0) as bigint) launch from (select part, count(*) n_packs from od group by part)",
    "recblock_entries": f"with {F1}, bl as ({BLOCK_SQL}) select block, kind, count(f1.i) nnz, count(distinct f1.i) n_rows from bl left join f1 on i>=up and i<down and j>=\"left\" and j<\"right\" group by block, kind",
    "features11": f"with recursive {F1}, {LEV}, r as (select i, count(*) n, cast(sum(i-j) as bigint) dist from f1 group by i), l as (select count(*) n from lev group by level) select * from (select count(*) m, cast(sum(n) as bigint) nnz, round(avg(n),6) avg_rnnz, max(n) max_rnnz, round(stddev_pop(n)/avg(n),6) cov_rnnz, round(sum(dist)/count(*),6) dep_dist from r), (select round(avg(n),6) avg_lnnz, max(n) max_lnnz, round(stddev_pop(n)/avg(n),6) cov_lnnz, count(*) n_levels from l)",
    "reverse_level": f"with recursive {F1}, {LEV} select round(sum(c/(i+1.0::double))/count(*),9) reverse_level from (select a.i, (select count(*) from lev b where b.i<a.i and b.level>a.level) c from lev a)",
    "tell_layout": f"""with {F1}, {ROWS}, w as (select i//32 g, max(n) width from rn group by 1), e as (select *, row_number() over (partition by i order by i=j, j)-1 as "at" from f1), c as (select rn.i, rn.n, w.g, w.width, s.s slot from rn join w on w.g=rn.i//32, lateral (select unnest(range(w.width)) s) s) select c.g, c.slot, c.i%32 lane, coalesce(e.j,0) j, coalesce(e.v,0.0::double) v from c left join e on e.i=c.i and e."at" = case when c.slot=c.width-1 then c.n-1 when c.slot<c.n-1 then c.slot end""",
    "plan_labels": f'with {PERF} select matrix, plan, min("time") over (partition by matrix)/"time" >= 0.85::double good from perf',
    "best_plan": f'with {PERF} select matrix, plan, "time" from (select *, row_number() over (partition by matrix order by "time", plan) r from perf) where r=1',
    "popular_plan": f'with {PERF}, lb as (select matrix, plan, min("time") over (partition by matrix)/"time" >= 0.85::double good from perf where matrix<>3), ch as (select plan from lb group by plan order by count(*) filter (good) desc, plan limit 1) select matrix, plan, ratio from (select *, min("time") over ()/"time" ratio from perf where matrix=3) where plan in (select plan from ch)',
    "order_entries": f"with {OC} select i, j, v from oe",
    "order_levels": f"with {OC}, {OLEV} select i, level from ol",
    "order_level_order": f"with {OC}, {OLEV} select i, row_number() over (order by level, i) - 1 place from ol",
    "order_row_pointers": f"with {OC} select i, cast(coalesce(sum(n) over (order by i rows between unbounded preceding and 1 preceding), 0) as bigint) ptr from (select i, count(*) n from oe group by i)",
    "order_product": f"with {OC} select i, sum(v*(j%7+1)) y from oe group by i",
    "sql_levels": f"with {OC}, {OLEV} select i, level from ol",
    "sql_solve": f"with recursive {OC}{CHAIN} select i, round(x, 9) x from sx",
    "sql_features": f"""with {OC}, {OLEV}, r as (select i, count(*) n, cast(sum(i - j) as bigint) d from oe group by i), l as (select count(*) n from ol group by level)
 select * from (select count(*) m, cast(sum(n) as bigint) nnz, round(avg(n), 6) avg_rnnz, max(n) max_rnnz, round(sum(d) / count(*), 6) dep_dist from r),
 (select count(*) n_levels, round(avg(n), 6) avg_lnnz, max(n) max_lnnz from l)""",
    "order_solve": f"with recursive {OC}{CHAIN} select i, round(x, 9) x from sx",
    "order_thresh": f"""with {OC}, rn as (select i, count(*) n from oe group by i), th as (select i, n, case when n>2 then i else st + ((i-st)//32)*32 end g from
 (select i, n, coalesce(max(case when n>2 then i+1 end) over (order by i rows unbounded preceding), 0) st from rn)) select i, n, g from th""",
    "group_nodep": NODEP.format(with_=f"with {F1}, {ROWS}", entries="f1", alpha=8, starts=_starts()),
    "segment_sums": f"with {OC}, rn as (select i, count(*) n from oe group by i) select cast(seg as bigint) segment, cast(sum(n) as bigint) v from (select n, sum((i%37=5)::int) over (order by i rows unbounded preceding) seg from rn) group by seg",
    "market_round_trip": f"with {OC} select i, j, v from oe",
    "permute_vector": f"with recursive {F1}, {LEV}, {LORD} select place i, (i%5+1)::double x from o",
    "unpermute_vector": f"with recursive {F1}, {LEV}, {LORD} select i, (place%5+1)::double x from o",
    "permute_rows": f"with recursive {F1}, {LEV}, {LORD} select place i, j, v from f1 join o using(i)",
    "permute_columns": f"with recursive {F1}, {LEV}, {LORD} select f1.i, place j, v from f1 join o on o.i=f1.j",
    "level_order_backward": f"with recursive {F1}, {LEV}, {LORD} select i, (select m from sz) - 1 - place place from o",
    "vector_subtract": f"with {SZ}, {SKEW}, {RHS} select i, b - coalesce(y, 0) b from rhs left join (select i, sum(0.5::double*((j%5)+1)) y from sk group by i) using(i)",
    "sub_triangle": f"with {F1} select i-m//2 i, j-m//2 j, v from f1, sz where i>=m//2 and j>=m//2",
    "sub_rectangle": f"with {F1} select i-m//2 i, j, v from f1, sz where i>=m//2 and j<m//2",
    "level_graph_nodes": f"with recursive {F1}, {LEV}, n as (select * from lev where level<3), e as (select f1.j src, f1.i dst from f1 join n a on a.i=f1.j join n b on b.i=f1.i where f1.i<>f1.j) select i, level, (select count(*) from e where dst=i) n_in, (select count(*) from e where src=i) n_out from n",
    "level_graph_edges": f"with recursive {F1}, {LEV}, n as (select * from lev where level<3) select f1.j src, f1.i dst from f1 join n a on a.i=f1.j join n b on b.i=f1.i where f1.i<>f1.j",
    "regrouped": f'{GROUPED} select g, row_number() over (order by level, g) - 1 place, cast(coalesce(sum(n_rows) over (order by level, g rows between unbounded preceding and 1 preceding), 0) as bigint) "first" from gt',
    "solve_many": f"with {SZ}, {KNOWN} select r, i, x from kx",
    "known_error": f"""with recursive {F1}, {KNOWN},
 kb as (select r, f1.i, sum(f1.v*kx.x) b from f1 join kx on kx.i = f1.j group by 1, 2), y(r, i, k, v) as (select r, i, 0, b/8.0::double from kb union all
 select y.r, o.i, y.k+1, -sum(o.v*y.v)/8.0::double from y join f1 o on o.j=y.i and o.i<>o.j group by y.r, o.i, y.k), xs as (select r, i, sum(v) x from y group by r, i)
 select r, max(abs(kx.x-xs.x)) max_error, sum(abs(kx.x-xs.x))/sum(abs(kx.x)) rel_l1 from kx join xs using (r, i) group by r""",
    "source_round_trip": f"with {OC} select i, j, v from oe",
    "rows_round_trip": f"with {OC} select i, j, v from oe",
    "counter_levels": f"with {OC}, {OLEV} select i, level from ol",
    "counter_solve": f"with recursive {OC}{CHAIN} select i, round(x, 9) x from sx",
    "fused_levels": f"with {NC} select i, rn - 1 as level from nc",
    "fused_solve": NATION_SOLVE,
    **dict.fromkeys(("solve_plan_block", "solve_plan_thresh", "solve_plan_nodep", "solve_plan_parts", "solve_blocks_by_method"), FORWARD),
    "plan_search": f"""with recursive {F1}, pl as (select * from (values (64, true, 64), (1024, true, 1024), (64, false, 4096)) t(alpha, by_level, width)),
 qe as materialized (select distinct width, i//width g, j//width h from f1, pl where i<>j), qu(width, g, k) as (select distinct width, i//width, 0 from f1, pl union select u.width, e.g, u.k+1 from qu u join qe e on e.width=u.width and e.h=u.g and e.g<>e.h)
 select 'tiers' matrix, 'ROW_BLOCK' strategy, alpha, by_level, cast((select max(k)+1 from qu where qu.width=pl.width) as bigint) turns, true as "right" from pl""",
    "order_nodep": NODEP.format(with_=f"with {OC}, rn as (select i, count(*) n from oe group by i)", entries="oe", alpha=8, starts=_starts()),
    "order_reverse_level": f"with {OC}, {OLEV} select round(sum(c/(i+1.0::double))/count(*),9) reverse_level from (select a.i, (select count(*) from ol b where b.i<a.i and b.level>a.level) c from ol a)",
    "solve_recblock_backward": SOLVE.format(f1=F1, rhs=RHS, a="j", b="i"),
    "solve_reordered": FORWARD,
    "plan_parts": f"{GROUPED} select g, n_rows, nnz, level, flags, 0::bigint part from gt",
    "plan_space": """select tbs, sws, rp, alpha, lp, ls, ws, rg, (select count(distinct user_id) from events) n_matrices from (select unnest([64,256,1024]) tbs), (select unnest([1,4,8]) sws), (select unnest([0,1,2]) rp),
 (select unnest([1,4,8,16,32]) alpha), (select unnest([0,1]) lp), (select 1 ls), (select unnest([0,1,2]) ws), (select unnest([0,1]) rg) where not (lp=1 and sws>1) and not (lp=1 and rg=1)""",
    "runs_informed": f'with {RUNS}, {INFO} select matrix, plan, "time", m, nnz from runs join info using(matrix) where nnz>=500',
    "runs_complete": f'with {RUNS} select matrix, plan, "time" from runs where matrix in (select matrix from runs group by matrix having count(*)=12)',
    "run_labels": f'with {RUNS} select matrix, plan, min("time") over (partition by matrix)/"time" >= 0.85::double good from runs',
    "run_throughput": f'with {RUNS}, {INFO} select matrix, plan, (2*nnz+m)/1073741824.0::double*1048576.0::double/"time" gflops, nnz*12+m*20 bytes from runs join info using(matrix)',
}
