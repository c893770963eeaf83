"""Queries over the derived graphs, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signet.functions import rounded
from signet.operators import edges as E
from signet.operators import generators, proximity, splits, structure
from signet.operators import laplacian as L
from signet.operators import propagate as P
from signet.sources import derived as D

from . import layers as Y
from . import losses, metrics, models
from .check_sql import Chain, hash_key, r6, uniform

QUERIES: dict = {}
SQL: dict[str, str] = {}


class Fixture:
    """The graph of a folder, its nodes and the vectors that the queries use."""

    def __init__(self, spark: SparkSession, sf_dir: str, graph: str = "g_ev"):
        make = {"g_ev": D.event_graph, "g_supp": D.supply_graph, "g_trade": D.trade_graph}[graph]
        self.spark, self.sf_dir, self.g = spark, sf_dir, make(spark, sf_dir)
        self.nodes = D.endpoints(self.g)

    def size(self) -> int:
        """One more than the largest id."""
        top = self.nodes.agg(F.max("id")).first()[0]
        return 0 if top is None else int(top) + 1

    def features(self, dims: int = 4) -> DataFrame:
        x = self.nodes.select("id", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("pos"))
        return x.select("id", "pos", ((F.pmod(F.col("id") * 7 + F.col("pos") * 3, F.lit(11)) - 5).cast("double") / 10).alias("val"))

    def complex_features(self, dims: int = 3) -> DataFrame:
        x = self.features(dims)
        return x.select("id", "pos", F.col("val").alias("re"), (F.col("val") / 2 + 0.05).alias("im"))

    def assignment(self, k: int = 3) -> DataFrame:
        x = self.nodes.select("id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("pos"))
        raw = x.select("id", "pos", (1 + F.pmod(F.col("id") * 7 + F.col("pos") * 3, F.lit(5))).cast("double").alias("val"))
        total = raw.groupBy("id").agg(F.sum("val").alias("t"))
        return raw.join(total, "id").select("id", "pos", (F.col("val") / F.col("t")).alias("val"))

    def labels(self, classes: int = 3) -> DataFrame:
        return self.nodes.select("id", (F.col("id") % classes).cast("int").alias("y"))

    def pairs(self) -> DataFrame:
        return self.g.select("src", "dst")


def query(name: str, sql: str | None = None, graph: str = "g_ev"):
    def put(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Fixture(spark, sf_dir, graph))
        if sql is not None:
            SQL[name] = sql
        return fn

    return put


def tidy(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in names], *[rounded(F.col(n), digits).alias(n) for n in names])


def long(df: DataFrame) -> DataFrame:
    return tidy(df.select("id", F.col("pos").cast("int").alias("pos"), "val"), "val")


VEC = f"select id, pos, {r6('val')} as val from "
PAIRS = "select src, dst from g"
EDGE = f"select src, dst, {r6('w')} as w from "


def _simple() -> None:
    c = Chain()
    query("edges_derived", c.sql("select src, dst, w from g"))(lambda f: f.g)
    query("edges_supply", Chain("g_supp").sql("select src, dst, w from g"), "g_supp")(lambda f: f.g)
    query("edges_trade", Chain("g_trade").sql("select src, dst, w from g"), "g_trade")(lambda f: f.g)
    query("sign_partition", c.sql("select src, dst, abs(w) as w, case when w > 0 then 'p' else 'n' end as part from g"))(lambda f: E.sign_partition(f.g))
    query("to_unweighted", c.sql("select src, dst, sign(w)::double as w from g"))(lambda f: E.unweighted(f.g, True))
    query("remove_loops", Chain("g_trade").sql("select src, dst, w from g where src <> dst"), "g_trade")(lambda f: E.without_loops(f.g))
    query("add_loops", c.sql("select src, dst, w from g union all select id, id, 1.0::double from nodes"))(lambda f: E.add_loops(f.g, f.nodes))
    query("add_remaining_loops", Chain("g_trade").sql("select src, dst, w from g union all select id, id, 0.5::double from nodes where id not in (select src from g where src = dst)"), "g_trade")(lambda f: E.add_remaining_loops(f.g, f.nodes, 0.5))
    query("coalesce_edges", c.sql("select src, dst, sum(w) as w from (select src, dst, w from g union all select dst, src, w from g) group by src, dst"))(lambda f: E.coalesce(f.g.unionByName(E.reverse(f.g))))
    query("to_undirected", c.sql("select src, dst from g union select dst, src from g"))(lambda f: E.to_undirected(f.g))
    pred = """select lo * hi < 0 as is_signed, (select count(*) from g a full join g b on a.src = b.dst and a.dst = b.src where a.w is distinct from b.w) > 0 as is_directed,
      lo <> hi as is_weighted, coalesce(pl <> ph, false) or coalesce(nl <> nh, false) as is_weighted_signed from (select min(w) lo, max(w) hi, min(w) filter (w > 0) pl, max(w) filter (w > 0) ph, min(w) filter (w < 0) nl, max(w) filter (w < 0) nh from g)"""
    query("graph_predicates", c.sql(pred))(lambda f: E.predicates(f.g))
    query("graph_summary", c.sql(f"select (select count(*) from nodes) as n_nodes, (select count(*) from g) as n_edges, (select count(*) from g where w > 0) as n_pos, (select count(*) from g where w < 0) as n_neg, p.* from ({pred}) p"))(lambda f: E.summary(f.g, f.nodes))
    query("degree_unsigned", c.sql("select id, coalesce((select sum(abs(w)) from g where src = id), 0) as row_sum, coalesce((select sum(abs(w)) from g where dst = id), 0) as col_sum from nodes"))(lambda f: E.degrees(f.g, f.nodes))
    query("degree_signed", c.sql("select id, coalesce((select sum(w) from g where src = id and w > 0), 0) as row_pos, coalesce((select sum(-w) from g where src = id and w < 0), 0) as row_neg, coalesce((select sum(w) from g where dst = id and w > 0), 0) as col_pos, coalesce((select sum(-w) from g where dst = id and w < 0), 0) as col_neg from nodes"))(lambda f: E.signed_degrees(f.g, f.nodes))
    query("edge_probe", c.sql(f"select p.src, p.dst, coalesce(a.w, 0) as w, coalesce(b.w, 0) as w_rev from (select dst as src, src as dst from ({PAIRS})) p left join g a on a.src = p.src and a.dst = p.dst left join g b on b.src = p.dst and b.dst = p.src"))(lambda f: E.probe(E.reverse(f.pairs()), f.g))
    query("induced_subgraph", c.sql("select src, dst, w from g where src % 3 = 0 and dst % 3 = 0"))(lambda f: E.induced(f.g, f.nodes.filter("id % 3 = 0")))
    query("sparsify_topk", c.sql("select src, dst, w from g where abs(w) >= (select coalesce(max(a), 0) from (select abs(w) as a, row_number() over (order by abs(w) desc) as r from g) where r = (select cast(floor(count(*) * count(*) * 0.05) as bigint) from nodes))"))(lambda f: E.sparsify(f.g, f.nodes.count(), 0.05))
    query("adjacency_explode", c.sql("select src, dst, cast(row_number() over (partition by src order by dst) - 1 as integer) as place from g"))(lambda f: f.g.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("links")).select("src", F.posexplode("links").alias("place", "dst")))
    query("edge_scan_encoded", """with raw as (select 'u' || user_id as a, row_number() over (order by ts, event_id) as place from events),
      f as (select a, min(place) as first from raw group by a)
      select a as raw_id, row_number() over (order by first) - 1 as id from f""")(lambda f: _encoded(f))


def _encoded(f: Fixture) -> DataFrame:
    from signet.sources.readers import first_appearance

    ev = D.read(f.spark, f.sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("raw_id"), F.struct("ts", "event_id").alias("at"))
    return first_appearance(ev, "raw_id", "at")


def _matrices() -> None:
    for name, q, norm, degree in (("magnetic_laplacian_sym", 0.25, "sym", "plain"), ("magnetic_laplacian_none", 0.25, None, "plain"), ("magnetic_signed_laplacian", 0.25, "sym", "absolute"), ("magnetic_signed_laplacian_netdeg", 0.25, "sym", "net"), ("magnetic_signed_laplacian_none", 0.1, None, "absolute")):
        graph = "g_trade" if degree == "plain" else "g_supp"
        c = Chain(graph)
        m = c.magnetic(q, norm, degree)
        query(name, c.sql(f"select src, dst, {r6('re')} as re, {r6('im')} as im from {m}"), graph)(lambda f, q=q, norm=norm, degree=degree: tidy(L.magnetic(f.g, f.nodes, q, norm, degree), "re", "im"))
    c = Chain()
    m = c.rescaled(c.magnetic(0.25, "sym", "absolute"))
    query("cheb_rescale", c.sql(f"select src, dst, {r6('re')} as re, {r6('im')} as im from {m}"))(lambda f: tidy(L.chebyshev_scaled(L.magnetic(f.g, f.nodes, 0.25, "sym", "absolute"), f.nodes), "re", "im"))
    edge = lambda name, build, fn, graph="g_ev": _edge_query(name, build, fn, graph)
    edge("conv_norm_rw", lambda c: c.row_norm("g", 0.5), lambda f: L.row_normalized(f.g, f.nodes, 0.5), "g_trade")
    edge("gcn_norm", lambda c: c.sym_norm("g", 1.0), lambda f: L.symmetric_normalized(f.g, f.nodes), "g_trade")
    edge("gcn_norm_improved", lambda c: c.sym_norm("g", 2.0), lambda f: L.symmetric_normalized(f.g, f.nodes, 2.0), "g_trade")
    edge("row_degree_symmetric", lambda c: c.row_sym("g"), lambda f: L.row_degree_symmetric(f.g), "g_trade")
    edge("balance_laplacian", lambda c: c.add("select src, dst, sum(w) as w from (select src, src as dst, w from g where w > 0 union all select src, dst, -w from g) group by src, dst"), lambda f: L.balance(f.g, f.nodes))
    edge("signed_laplacian", lambda c: c.add("select src, dst, sum(w) as w from (select a.src, a.dst, -a.w / (greatest(sqrt(x.d), 1 / 999999999::double) * greatest(sqrt(y.d), 1 / 999999999::double)) as w from g a join dd x on x.id = a.src join dd y on y.id = a.dst union all select id, id, 1.0::double from nodes) group by src, dst"), lambda f: L.signed_laplacian(f.g, f.nodes))
    edge("hermitian_rw", lambda c: c.add("select src, dst, w / sum(abs(w)) over (partition by src) as w from (select src, dst, sum(w) as w from (select src, dst, w from g union all select dst, src, -w from g) group by src, dst having sum(w) <> 0)"), lambda f: L.hermitian_row_normalized(f.g).withColumnRenamed("im", "w"))
    edge("spectral_sign_matrix", lambda c: c.add("select src, dst, sum(v) - 1 as w from (select src, dst, case when w > 0 then 2.0 else 0.0 end::double as v from g union all select dst, src, case when w > 0 then 2.0 else 0.0 end::double from g) group by src, dst"), lambda f: L.spectral_signs(f.g))
    for tag, expr in ((None, "none"), ("sym", "sym"), ("sym_sep", "sym_sep")):
        c = Chain()
        x = c.features(1)
        d = c.add("select id, coalesce((select sum(w) from g where dst = id and w > 0), 0) as p, coalesce((select sum(-w) from g where dst = id and w < 0), 0) as n from nodes")
        t = c.add(f"select count(*)::double as size, 0.25 * avg(p + n) / count(*) as tau from {d}")

        def one(cond: str, scale: str, shift: str, c=c, x=x, d=d, t=t) -> str:
            s = c.add(f"select d.id, {scale} as s, {scale} * x.val as y from {d} d cross join {t} t join {x} x on x.id = d.id")
            return f"select a.id, a.s * (coalesce((select sum(g.w * b.y) from g join {s} b on b.id = g.dst where g.src = a.id and {cond}), 0) + ({shift}) * (select sum(y) from {s})) as val from {s} a cross join {t} t"

        parts = {"none": [one("true", "1.0::double", "t.tau - t.tau")], "sym": [one("true", "1 / sqrt(p + n + size * 2 * tau)", "t.tau - t.tau")], "sym_sep": [one("g.w > 0", "1 / sqrt(p + size * tau)", "t.tau"), one("g.w < 0", "1 / sqrt(n + size * tau)", "-t.tau")]}[expr]
        u = c.add("select id, sum(val) as val from (" + " union all ".join(parts) + ") group by id")
        query(f"reg_adj_matvec_{expr}", c.sql(f"select id, {r6('val')} as val from {u}"))(lambda f, tag=tag: tidy(L.regularized_matvec(f.g, f.nodes, f.features(1).select("id", "val"), tag), "val"))
    # second order
    products = lambda c, e, shared, other: c.add(f"select a.{other} as src, b.{other} as dst, sum(a.w * b.w) as w from {e} a join {e} b on a.{shared} = b.{shared} group by a.{other}, b.{other}")

    def second(c: Chain) -> str:
        p = c.row_norm(c.loops("g", 1.0, False), None)
        a, b = products(c, p, "src", "dst"), products(c, p, "dst", "src")
        return c.row_sym(c.add(f"select src, dst, (x.w + y.w) / 2 as w from {a} x join {b} y using (src, dst)"))

    edge("digcn_second_order", second, lambda f: proximity.second_order(E.unweighted(f.g, False), f.nodes), "u_ev")
    for way, shared, other, end in (("in", "src", "dst", "dst"), ("out", "dst", "src", "src")):
        build = lambda c, shared=shared, other=other, end=end: c.add(f"select a.{other} as src, b.{other} as dst, sum(a.w * b.w / coalesce(case when d.d = 0 then 1 else d.d end, 1)) as w from g a join g b on a.{shared} = b.{shared} left join (select {end} as k, sum(w) as d from g group by {end}) d on d.k = a.{shared} group by a.{other}, b.{other}")
        edge(f"second_order_{way}", build, lambda f, way=way: proximity.in_out_proximity(E.unweighted(f.g, False), way), "u_ev")
    # page rank, fixed numbers of steps
    c, fin = _pagerank_sql(10)
    query("ppr_power", c.sql(f"select id, {r6('val', 8)} as val from {fin}"))(lambda f: tidy(proximity.pagerank(E.unweighted(f.g, False), f.nodes, 0.1, 10, None), "val", digits=8))
    c, fin = _pagerank_sql(10)
    lap = _ppr_lap(c, "u", fin)
    query("ppr_laplacian", c.sql(EDGE + lap))(lambda f: tidy(proximity.pagerank_laplacian(E.unweighted(f.g, False), f.nodes, proximity.pagerank(E.unweighted(f.g, False), f.nodes, 0.1, 10, None)), "w"))
    c, fin = _pagerank_sql(10, loops=True)
    query("digcn_fast_appr", c.sql(EDGE + c.row_sym(_ppr_lap(c, "u", fin))))(lambda f: tidy(proximity.fast_appr(E.unweighted(f.g, False), f.nodes, 0.1, 10, None), "w"))
    c = Chain()
    u = c.add("select src, dst, 1.0::double as w from g")
    a = c.loops(u, 1.0, False)
    p, n = c.row_norm(a, None), "(select count(*) from nodes)"
    x = c.add(f"select id, 1.0::double / {n} as val from nodes")
    for _ in range(10):
        x = c.add(f"select n.id, coalesce(m.m, 0) + (select sum(val) from {x}) * 0.1::double / {n} as val from nodes n left join (select e.dst, sum(0.9::double * e.w * x.val) as m from {p} e join {x} x on x.id = e.src group by e.dst) m on m.dst = n.id")
    x = c.add(f"select id, val / sum(val) over () as val from {x}")
    query("digcn_appr_adj", c.sql(EDGE + c.row_sym(_ppr_lap(c, a, x))))(lambda f: tidy(proximity.appr_directed(E.unweighted(f.g, False), f.nodes, 0.1, 10), "w"))


def _pagerank_sql(steps: int, loops: bool = False) -> tuple[Chain, str]:
    c = Chain()
    u = c.add("select src, dst, 1.0::double as w from g")
    u = c.add(f"select src, dst, w from {c.loops(u, 1.0, False) if loops else u}", "u")
    d = c.add("select id, coalesce((select sum(w) from u where src = id), 0) as d from nodes")
    n, a = "(select count(*) from nodes)", 0.1
    x = c.add(f"select id, 1.0::double / {n} as val from nodes")
    for _ in range(steps):
        b = f"(select sum(case when d.d <> 0 then {a * (1 + a)!r}::double else {(1 - a) / (1 + a) + a * (1 + a)!r}::double end * x.val) from {x} x join {d} d on d.id = x.id)"
        m = f"select e.dst, sum({1 - a}::double * e.w / d.d * x.val) as m from u e join {d} d on d.id = e.src join {x} x on x.id = e.src group by e.dst"
        x = c.add(f"select n.id, coalesce(m.m, 0) + {b} / ({1 + a}::double * {n}) as val from nodes n left join ({m}) m on m.dst = n.id")
    return c, c.add(f"select id, val / sum(val) over () as val from {x}")


def _ppr_lap(c: Chain, e: str, x: str) -> str:
    p = c.row_norm(e, None)
    s = c.add(f"select p.src, p.dst, sqrt(a.val) * p.w / sqrt(b.val) / 2 as w from {p} p join {x} a on a.id = p.src join {x} b on b.id = p.dst")
    return c.add(f"select src, dst, sum(w) as w from (select src, dst, w from {s} union all select dst, src, w from {s}) group by src, dst")


def _edge_query(name: str, build, fn, graph: str) -> None:
    unweighted = graph == "u_ev"
    c = Chain(None if unweighted else graph)
    if unweighted:
        c.add(f"select src, dst, 1.0::double as w from ({D.SQL['g_ev']})", "g")
        c.add(f"select distinct id from ({D.SQL['nodes']})", "nodes")
    if name == "signed_laplacian":
        c.add("select id, coalesce((select sum(abs(w)) from g where dst = id), 0) as d from nodes", "dd")
    out = build(c)
    query(name, c.sql(EDGE + out), "g_ev" if unweighted else graph)(lambda f: tidy(fn(f).select("src", "dst", "w"), "w"))


def _structure() -> None:
    c = Chain()
    adj = c.add("select distinct node, dir, s, nbr from (select src as node, 'out' as dir, sign(w) as s, dst as nbr from g union all select dst, 'in', sign(w), src from g)", "adj")
    cols = ", ".join(f"count(*) filter (u.dir = '{du}' and v.dir = '{dv}' and u.s = {su} and v.s = {sv}) as d{i}_{j}" for i, (du, dv) in enumerate(structure.TRIADS, 1) for j, (su, sv) in enumerate(structure.SIGNS, 1))
    census = c.add(f"select g.src, g.dst, {cols} from g left join adj u on u.node = g.src left join adj v on v.node = g.dst and v.nbr = u.nbr group by g.src, g.dst", "census")
    query("triad_census_16", c.sql(f"select * from {census}"))(lambda f: structure.triad_census(f.g))
    tri = f"select g.src, g.dst, case when g.w < 0 then {' + '.join(structure.UNBALANCED)} else {' + '.join(structure.BALANCED)} end as tri from g join {census} using (src, dst)"
    query("triangle_weight", c.sql(tri))(lambda f: structure.triangle_weights(f.g))
    names = [f"d{i}_{j}" for i in range(1, 5) for j in range(1, 5)]
    parts = []
    for k, op in enumerate((">", "<")):
        parts += [f"select {3 * k} as motif, src, dst from (select src, dst from g where w {op} 0 union select dst, src from g where w {op} 0)", f"select {3 * k + 1}, src, dst from g where w {op} 0", f"select {3 * k + 2}, dst, src from g where w {op} 0"]
        parts += [f"select {6 + 16 * k + i}, g.src, g.dst from g join census using (src, dst) where w {op} 0 and {n} > 0" for i, n in enumerate(names)]
    query("motif_edges_38", c.sql(" union all ".join(parts)))(lambda f: structure.motif_edges(f.g))
    query("signed_adj_lists", Chain().sql(" union all ".join(f"select '{n}_out' as list, src, dst from g where w {op} 0 union all select '{n}_in', dst, src from g where w {op} 0" for n, op in (("pos", ">"), ("neg", "<")))))(lambda f: structure.adjacency_lists(f.g))
    comp = f"with recursive g as (select * from ({D.SQL['g_ev']})), nodes as (select src as id from g union select dst from g), r as (select id as a, id as b from nodes union select r.a, e.dst from r join (select src, dst from g union select dst, src from g) e on e.src = r.b) "
    query("weak_components", comp + "select a as id, min(b) as component from r group by a")(lambda f: structure.weak_components(f.g, f.nodes))
    query("largest_component", comp + ", c as (select a as id, min(b) as c from r group by a), s as (select c, count(*) as n from c group by c order by n desc, c limit 1) select id from c join s using (c)")(lambda f: structure.largest_component(f.g, f.nodes))
    chain = Chain(None)
    chain.add(f"select * from ({D.SQL['g_ev']})", "g")
    ids = chain.add("select id from (select src as id from g union select dst from g)")
    for _ in range(10):
        d = chain.add(f"select id, (select count(*) from g where src = n.id and dst in (select id from {ids})) + (select count(*) from g where dst = n.id and src in (select id from {ids})) as d from {ids} n")
        ids = chain.add(f"select id from {d} where d >= 4")
    query("kcore_peel", chain.sql(f"select id from {ids}"))(lambda f: structure.peel(f.g, f.nodes, 4, 10))
    query("spanning_forest")(lambda f: structure.spanning_forest(f.g, f.nodes))
    query("extract_network")(lambda f: structure.extract_network(f.g, f.nodes, 3)[0])


def _layers() -> None:
    vec = lambda name, build, fn, graph="g_ev": _vec_query(name, build, fn, graph)
    W = models.fixed
    pos = lambda f: E.positive(f.g)
    vec("spmm", lambda c: c.spmm("g", c.features()), lambda f: P.spmm(f.g, f.features()))
    vec("scatter_mean", lambda c: c.mean("true", c.features()), lambda f: P.aggregate(f.g, f.features()))
    vec("dense", lambda c: c.dense(c.features(), 4, 3, 0.1), lambda f: P.dense(f.features(), W(4, 3), [0.1, 0.2, 0.3]))
    vec("softmax", lambda c: c.softmax(c.features()), lambda f: P.softmax(f.features()))
    vec("log_softmax", lambda c: c.softmax(c.features(), True), lambda f: P.softmax(f.features(), True))
    vec("l2_normalize", lambda c: c.l2(c.features()), lambda f: P.l2_normalized(f.features()))
    vec("standardize", lambda c: c.add(f"select id, x.pos, (val - m) / case when s = 0 then 1 else s end as val from {c.features()} x join (select pos, avg(val) as m, stddev_pop(val) as s from {c.steps[-1][0]} group by pos) using (pos)"), lambda f: P.standardized(f.features()))
    vec("drop_feature", lambda c: c.add(f"select id, pos, case when {uniform('3', 'pos')} < 0.5 then 0 else val end as val from {c.features()}"), lambda f: P.drop_features(f.features(), 0.5, 3))
    vec("one_hot", lambda c: c.add("select id, cast(p as integer) as pos, cast(id % 3 = p as double) as val from nodes, (select unnest(range(3)) as p)"), lambda f: P.one_hot(f.labels(), 3))
    for name, expr in (("relu", "greatest(val, 0)"), ("tanh", "tanh(val)"), ("elu", "case when val > 0 then val else exp(val) - 1 end"), ("sigmoid", "1 / (1 + exp(-val))"), ("prelu", "case when val >= 0 then val else 0.25 * val end")):
        vec(f"act_{name}", lambda c, expr=expr: c.act(c.features(), expr), lambda f, name=name: P.activate(f.features(), name))
    c = Chain()
    query("argmax", c.sql(f"select id, cast(arg_min(pos, (-val, pos)) as integer) as pos from {c.features()} group by id"))(lambda f: P.argmax(f.features()))
    c = Chain()
    x = c.features(3)
    query("complex_relu", c.sql(f"select id, pos, {r6('case when val >= 0 then val else 0 end')} as re, {r6('case when val >= 0 then val / 2 + 0.05 else 0 end')} as im from {x}"))(lambda f: tidy(P.complex_relu(f.complex_features()), "re", "im"))
    c = Chain()
    x = c.features()
    query("pair_gather", c.sql(f"select p.src, p.dst, x.pos, {r6('x.val')} as val from ({PAIRS}) p join {x} x on x.id = p.src union all select p.src, p.dst, x.pos + 4, {r6('x.val')} from ({PAIRS}) p join {x} x on x.id = p.dst"))(lambda f: tidy(P.pair_gather(f.pairs(), f.features(), 4), "val"))
    vec("conv_base", lambda c: c.spmm(c.row_norm("g", 0.5), c.features(), "src"), lambda f: Y.conv_base(f.g, f.nodes, f.features()), "g_trade")
    vec("dgcn_conv", lambda c: c.spmm(c.sym_norm("g"), c.features()), lambda f: Y.dgcn_conv(f.g, f.nodes, f.features()), "g_trade")
    vec("gcn_conv", lambda c: c.act(c.spmm(c.sym_norm("g"), c.dense(c.features(), 4, 3)), "val + 0.1 * (pos + 1)"), lambda f: Y.gcn_conv(f.g, f.nodes, f.features(), W(4, 3), [0.1, 0.2, 0.3]), "g_trade")
    vec("digcn_conv", lambda c: c.act(c.spmm(c.row_sym("g"), c.dense(c.features(), 4, 3)), "val + 0.1 * (pos + 1)"), lambda f: Y.digcn_conv(L.row_degree_symmetric(f.g), f.features(), W(4, 3), [0.1, 0.2, 0.3]), "g_trade")
    for k in (1, 2):
        for name, graph, degree in ((f"magnet_conv_k{k}", "g_trade", "plain"), (f"ms_conv_k{k}", "g_ev", "absolute")):
            c = Chain(graph)
            re = c.features(3)
            a, b = c.chebyshev(c.rescaled(c.magnetic(0.25, "sym", degree)), re, c.act(re, "val / 2 + 0.05"), 3, 2, k)
            conv = Y.magnet_conv if degree == "plain" else Y.ms_conv
            query(name, c.sql(f"select a.id, a.pos, {r6('a.val')} as re, {r6('b.val')} as im from {a} a join {b} b using (id, pos)"), graph)(lambda f, k=k, conv=conv: tidy(conv(f.g, f.nodes, f.complex_features(), [W(3, 2)] * (k + 1)), "re", "im"))

    vec("sgcn_conv_first", lambda c: c.sgcn(c.features(), 4, True), lambda f: Y.sgcn_conv(f.g, f.features(), 4, W(8, 2), W(8, 2), True))
    vec("sgcn_conv_deep", lambda c: c.sgcn(c.features(), 4, False), lambda f: Y.sgcn_conv(f.g, f.features(), 4, W(6, 2), W(6, 2), False))
    vec("sgcn_conv_normalized", lambda c: c.l2(c.sgcn(c.features(), 4, True)), lambda f: Y.sgcn_conv(f.g, f.features(), 4, W(8, 2), W(8, 2), True, True))
    alpha, ALPHA = [((p * 7) % 5 - 2) / 10 for p in range(4)], "((p * 7) % 5 - 2) / 10"

    vec("snea_conv_first", lambda c: c.snea(c.features(), 4, True, ALPHA), lambda f: Y.snea_conv(f.g, f.nodes, f.features(), 4, W(4, 2), W(4, 2), alpha, alpha, True))
    vec("snea_conv_deep", lambda c: c.snea(c.features(), 4, False, ALPHA), lambda f: Y.snea_conv(f.g, f.nodes, f.features(), 4, W(2, 2), W(2, 2), alpha, alpha, False))

    def dimpa(c: Chain) -> str:
        x = c.features()
        return c.concat((c.hops("g", x, 2), 4), (c.hops(c.reverse("g"), c.act(x, "val * 2"), 2), 4))

    vec("dimpa", dimpa, lambda f: Y.dimpa(f.g, f.nodes, f.features(), P.scale(f.features(), 2.0), 4), "g_trade")

    def simpa(c: Chain, directed: bool) -> str:
        x, p, n = c.features(), c.positive(), c.negative()
        halves = [*c.simpa_half(p, n, x, c.act(x, "val + 0.1"), 2)]
        if directed:
            halves += c.simpa_half(c.reverse(p), c.reverse(n), c.act(x, "val * 2"), c.act(x, "val - 0.1"), 2)
        return c.concat(*[(h, 4) for h in halves])

    shift = lambda f, by: f.features().withColumn("val", F.col("val") + by)
    xs = lambda f: [f.features(), shift(f, 0.1), P.scale(f.features(), 2.0), shift(f, -0.1)]
    vec("simpa_undirected", lambda c: simpa(c, False), lambda f: Y.simpa(pos(f), E.negative(f.g), f.nodes, xs(f), 4))
    vec("simpa_directed", lambda c: simpa(c, True), lambda f: Y.simpa(pos(f), E.negative(f.g), f.nodes, xs(f), 4, directed=True))


def _vec_query(name: str, build, fn, graph: str) -> None:
    c = Chain(graph)
    out = build(c)
    # eight digits: sums of products of one-digit decimals would often be halves of the sixth
    query(name, c.sql(f"select id, pos, {r6('val', 8)} as val from {out}"), graph)(lambda f: tidy(fn(f).select("id", F.col("pos").cast("int").alias("pos"), "val"), "val", digits=8))


def register() -> None:
    from . import registry_more

    _simple()
    _matrices()
    _structure()
    _layers()
    registry_more.register()


__all__ = ["QUERIES", "SQL", "Fixture", "generators", "hash_key", "losses", "metrics", "query", "register", "splits", "tidy"]
