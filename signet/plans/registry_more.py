"""Queries of splits, samples, generators, objectives, metrics and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from signet.operators import edges as E
from signet.operators import generators as G
from signet.operators import laplacian as L
from signet.operators import propagate as P
from signet.operators import proximity, splits, structure
from signet.operators.iterate import kept
from signet.sources import derived as D

from . import layers as Y
from . import losses, metrics, models
from .check_sql import Chain, hash_key, r6, uniform

LOSS = f"select {r6('loss')} as loss from "
LINK = f"select src, dst, pos, {r6('val')} as val from "


def register() -> None:
    _splits()
    _generators()
    _losses()
    _metrics()
    _models()


def _q():
    from .registry import query, tidy

    return query, tidy


def _splits() -> None:
    query, _ = _q()
    lab = "select id, cast(id % 3 as integer) as y from nodes"
    c = Chain()
    every = c.add(f"select s.s as split, l.id, l.y from ({lab}) l, (select cast(unnest(range(3)) as integer) as s) s")

    def ranked(pool: str, tag: str, by: str) -> str:
        return c.add(f"select *, row_number() over (partition by {by} order by {hash_key('split', repr(tag), 'id')}, id) as r, count(*) over (partition by {by}) as m from {pool}")

    train = c.add(f"select split, id, y from {ranked(every, 'train', 'split')} where r <= floor(m * 0.5)")
    seed = c.add(f"select split, id from {ranked(train, 'seed', 'split')} where r <= floor(m * 0.2)")
    rest = c.add(f"select * from {every} e where not exists (select 1 from {train} t where t.split = e.split and t.id = e.id)")
    val = c.add(f"select split, id, y from {ranked(rest, 'val', 'split')} where r <= 20")
    final = f"""select a.split, a.id, role, s.id is not null as seed from (select split, id, 'train' as role from {train} union all select split, id, 'val' from {val}
      union all select split, id, 'test' from {rest} e where not exists (select 1 from {val} t where t.split = e.split and t.id = e.id)) a left join {seed} s on s.split = a.split and s.id = a.id"""
    query("node_split_global", c.sql(final))(lambda f: splits.node_split(f.labels(), 3, train=0.5, val=20, seed_size=0.2))
    c2 = Chain()
    e2 = c2.add(f"select s.s as split, l.id, l.y, count(*) over (partition by s.s, l.y) as whole from ({lab}) l, (select cast(unnest(range(3)) as integer) as s) s")
    rk = lambda pool, tag: c2.add(f"select *, row_number() over (partition by split, y order by {hash_key('split', repr(tag), 'id')}, id) as r from {pool}")
    t2 = c2.add(f"select split, id, y, whole from {rk(e2, 'train')} where r <= 10")
    s2 = c2.add(f"select split, id from {rk(t2, 'seed')} where r <= 4")
    r2 = c2.add(f"select * from {e2} e where not exists (select 1 from {t2} t where t.split = e.split and t.id = e.id)")
    v2 = c2.add(f"select split, id, y, whole from {rk(r2, 'val')} where r <= floor(whole * 0.2)")
    q2 = c2.add(f"select * from {r2} e where not exists (select 1 from {v2} t where t.split = e.split and t.id = e.id)")
    z2 = c2.add(f"select split, id from {rk(q2, 'test')} where r <= floor(whole * 0.3)")
    query("node_split_per_class", c2.sql(f"select a.split, a.id, role, s.id is not null as seed from (select split, id, 'train' as role from {t2} union all select split, id, 'val' from {v2} union all select split, id, 'test' from {z2}) a left join {s2} s on s.split = a.split and s.id = a.id"))(lambda f: splits.node_split(f.labels(), 3, train_per_class=10, val_per_class=0.2, test_per_class=0.3, seed_per_class=4))
    c = Chain()
    query("sample_per_class", c.sql(f"select id, y from (select *, row_number() over (partition by y order by {hash_key('5', repr('c'), 'id')}, id) as r, m from (select *, count(*) over (partition by y) as m from ({lab})) where id % 4 <> 0) where r <= floor(m * 0.25)"))(lambda f: splits.sample_per_class(f.labels(), 0.25, 5, forbidden=f.nodes.filter("id % 4 = 0")))
    c = Chain()
    query("negative_sampling", c.sql(f"select src, dst from {_sql_unlinked(c)}"))(lambda f: splits.negative_samples(f.g, f.size(), f.g.count()))
    c = Chain()
    query("structured_negatives", c.sql(f"select src, dst, neg from {_sql_negatives(c, 'g')}"))(lambda f: splits.structured_negatives(f.g, f.size()))
    labels = {
        "existence": "select src, dst, case when w <> 0 then 0 else 1 end as label from p",
        "sign": "select src, dst, case when w < 0 then 0 else 1 end as label from p where w <> 0",
        "direction": "select src, dst, 0 as label from p where w <> 0 and r = 0 union all select dst, src, 1 from p where w <> 0 and r = 0",
    }
    labels["three_class_digraph"] = labels["direction"] + " union all select src, dst, 2 from p where w = 0 and r = 0"
    labels["four_class_signed_digraph"] = "select src, dst, case when w > 0 then 0 else 1 end as label from p where w <> 0 and r = 0 union all select dst, src, case when w > 0 then 2 else 3 end from p where w <> 0 and r = 0"
    labels["five_class_signed_digraph"] = labels["four_class_signed_digraph"] + " union all select src, dst, 4 from p where w = 0 and r = 0"
    for task, sql in labels.items():
        c = Chain()
        c.add("select p.src, p.dst, coalesce(a.w, 0) as w, coalesce(b.w, 0) as r from (select src, dst from g union select dst, (src * 7 + dst) % 150 from g) p left join g a on a.src = p.src and a.dst = p.dst left join g b on b.src = p.dst and b.dst = p.src", "p")
        pairs = lambda f: f.g.select("src", "dst").union(f.g.select("dst", (F.col("src") * 7 + F.col("dst")) % 150))
        query(f"link_labels_{task}", c.sql(sql))(lambda f, task=task: splits.link_labels(pairs(f), f.g, task))
        if task in ("direction", "sign", "four_class_signed_digraph"):
            c = Chain()
            kind = "1" if task == "direction" else "case when w > 0 then 1 else 0 end"
            # a share of all edges; in signed tasks the share of a sign in it, rounded half to even
            m = "(select count(*) from g)"
            pos = "(select (count(*) filter (w > 0))::double / count(*) from g)"
            quota = lambda p, task=task: f"floor(m * {p}::double)" if task == "direction" else f"round_even({p}::double * m * case when kind = 1 then {pos} else 1 - {pos} end, 0)"
            c.add(f"select s as split, src, dst, row_number() over (partition by s, kind order by {hash_key('0', 's', 'src', 'dst')}, src, dst) as r, kind, {m} as m from (select *, {kind} as kind from g), (select cast(unnest(range(2)) as integer) as s)", "e")
            c.add(f"select split, src, dst, case when r <= {quota(0.15)} then 'test' when r <= {quota(0.15)} + {quota(0.05)} then 'val' else 'train' end as part from e", "d")
            c.add("select d.split, d.part, d.src, d.dst, a.w, coalesce(b.w, 0) as r from d join g a on a.src = d.src and a.dst = d.dst left join g b on b.src = d.dst and b.dst = d.src where part is not null", "p")
            got = sql.replace("select src, dst,", "select split, part, src, dst,").replace("select dst, src,", "select split, part, dst, src,")
            query(f"link_split_{task}", c.sql(got))(lambda f, task=task: splits.link_split(f.g, f.nodes, 1, task, maintain_connect=False)[0])
            query(f"link_split_{task}_observed", c.sql("select split, src, dst, w from p where part = 'train'"))(lambda f, task=task: splits.link_split(f.g, f.nodes, 1, task, maintain_connect=False)[1])
        else:
            query(f"link_split_{task}")(lambda f, task=task: splits.link_split(f.g, f.nodes, f.size(), task, splits=1)[0])
    query("link_split_connected")(lambda f: splits.link_split(f.g, f.nodes, f.size(), "direction", splits=1)[0])


def _sql_unlinked(c: Chain) -> str:
    """As many distinct pairs of all node numbers as there are edges, linked in neither direction: drawn, then by hash."""
    both = c.add("select src, dst from g union select dst, src from g")
    n, m = "(select max(id) + 1 from nodes)", "(select count(*) from g)"
    draw = lambda tag: f"cast(floor({uniform('0', repr(tag), 'id')} * {n}) as bigint)"
    drawn = c.add(f"select src, dst, min(id) as place from (select {draw('u')} as src, {draw('v')} as dst, id from (select unnest(range(4 * {m})) as id)) where src <> dst group by src, dst")
    found = c.add(f"select src, dst from {drawn} anti join {both} using (src, dst) order by place limit {m}")
    free = c.add(f"select a as src, b as dst from (select unnest(range({n})) as a), (select unnest(range({n})) as b) where a <> b")
    rest = c.add(f"select src, dst, row_number() over (order by {hash_key('0', repr('w'), 'src', 'dst')}, src, dst) as r from {free} anti join {both} using (src, dst) anti join {found} using (src, dst)")
    return c.add(f"select src, dst from {found} union all select src, dst from {rest} where r <= {m} - (select count(*) from {found})")


def _sql_negatives(c: Chain, edges: str) -> str:
    """For each edge the first of six drawn nodes without a link from its source, or one of the free nodes by rank."""
    n = "(select max(id) + 1 from nodes)"
    d = c.add(f"select src, dst, t, cast(floor({uniform('0', 'src', 'dst', 't')} * {n}) as bigint) as neg from {edges}, (select unnest(range(6)) as t)")
    met = c.add(f"select src, dst, arg_min(neg, t) as neg from {d} p where not exists (select 1 from {edges} e where e.src = p.src and e.dst = p.neg) group by src, dst")
    unmet = c.add(f"select src, dst from {edges} anti join {met} using (src, dst)")
    free = c.add(f"select s.src, list(x order by x) as room from (select distinct src from {unmet}) s, (select unnest(range({n})) as x) where not exists (select 1 from {edges} e where e.src = s.src and e.dst = x) group by s.src")
    return c.add(f"select src, dst, neg from {met} union all select src, dst, room[cast(floor({uniform('0', repr('rest'), 'src', 'dst')} * len(room)) as bigint) + 1] from {unmet} join {free} using (src)")


def _sql_nodes(n: int, k: int, ratio: float, seed: int) -> str:
    at, cuts = 0, []
    for size in G.block_sizes(n, k, ratio):
        at += size
        cuts.append(at)
    y = " + ".join(f"case when r >= {c} then 1 else 0 end" for c in cuts[:-1]) or "0"
    return f"select id, cast({y} as integer) as y from (select id, row_number() over (order by {hash_key(str(seed), repr('node'), 'id')}, id) - 1 as r from (select unnest(range({n}))::bigint as id))"


def _generators() -> None:
    query, tidy = _q()
    n, k, p, f0 = 120, 3, 0.2, G.meta_graph("cyclic", 3, 0.1)
    signed = [[-v if (i + j) % 2 else v for j, v in enumerate(row)] for i, row in enumerate(f0)]
    case = lambda m: "case " + " ".join(f"when k = {i} and l = {j} then {float(v)!r}::double" for i, row in enumerate(m) for j, v in enumerate(row)) + " end"

    def chain(prob, seed: int, ratio: float, upper: bool = False) -> Chain:
        c = Chain(None)
        c.add(_sql_nodes(n, k, ratio, seed), "v")
        c.add(f"select * from (select a.id as src, b.id as dst, a.y as k, b.y as l, {uniform(str(seed), 'a.id', 'b.id')} as u from v a, v b where a.id {'<' if upper else '<>'} b.id) where u < {case(prob)}", "e")
        return c

    c = chain([[p * v for v in r] for r in f0], 1, 1.5)
    query("gen_dsbm", c.sql("select src, dst, 1.0::double as w from e"))(lambda f: G.dsbm(f.spark, n, k, p, f0, 1.5, 1)[0])
    query("gen_dsbm_nodes", c.sql("select id, y from v"))(lambda f: G.dsbm(f.spark, n, k, p, f0, 1.5, 1)[1])
    c = chain([[p * abs(v) for v in r] for r in signed], 2, 1.5)
    c.add(f"select src, dst, case when {case(signed)} < 0 then -1.0 else 1.0 end::double as w, row_number() over (order by {hash_key('2', repr('flip'), 'src', 'dst')}, src, dst) as r, count(*) over () as m from e", "s")
    query("gen_sdsbm", c.sql("select src, dst, case when r <= floor(m * 0.1) then -w else w end as w from s"))(lambda f: G.sdsbm(f.spark, n, k, p, signed, 1.5, 0.1, 2)[0])
    c = chain([[0.2] * 3] * 3, 3, 2, True)
    c.add(f"select src, dst, case when (k = l) <> ({uniform('3', repr('sign'), 'src', 'dst')} < 0.1) then 1.0 else -1.0 end::double as w from e", "s")
    query("gen_ssbm", c.sql("select src, dst, w from s union all select dst, src, w from s"))(lambda f: G.ssbm(f.spark, n, k, 0.2, 0.1, seed=3)[0])
    value = {"exp": f"-ln(1 - {uniform('3', repr('value'), 'src', 'dst')})", "uniform": uniform("3", repr("value"), "src", "dst")}
    for kind, v in value.items():
        c2 = chain([[0.2] * 3] * 3, 3, 2, True)
        c2.add(f"select src, dst, case when (k = l) <> ({uniform('3', repr('sign'), 'src', 'dst')} < 0.1) then 1.0 else -1.0 end::double * {v} as w from e", "s")
        query(f"gen_ssbm_{kind}", c2.sql(f"select src, dst, {r6('w')} as w from s union all select dst, src, {r6('w')} from s"))(lambda f, kind=kind: tidy(G.ssbm(f.spark, n, k, 0.2, 0.1, values=kind, seed=3)[0], "w"))
    query("gen_polarized_ssbm")(lambda f: G.polarized(f.spark)[0])
    for style in ("path", "cyclic", "complete", "star", "multipartite"):
        query(f"meta_graph_{style}")(lambda f, style=style: f.spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(G.meta_graph(style, 5, 0.1)) for j, v in enumerate(row)], "k int, l int, f double"))


def _losses() -> None:
    query, tidy = _q()
    one = lambda df: tidy(df, "loss")

    def dots(c: Chain) -> str:
        x = c.features()
        return c.add(f"select g.src, g.dst, g.w, sum(a.val * b.val) as d from g join {x} a on a.id = g.src join {x} b on b.id = g.dst and b.pos = a.pos group by g.src, g.dst, g.w")

    ls = lambda x: f"(-(greatest(-({x}), 0) + ln(1 + exp(-abs({x})))))"
    c = Chain()
    d = dots(c)
    query("loss_product_entropy", c.sql(f"select {r6(f'sum(-{ls('case when w > 0 then d else -d end')})')} as loss from {d}"))(lambda f: one(losses.product_entropy(f.g, f.features())))
    query("loss_link_product", c.sql(f"select {r6(f'-sum(case when w > 0 then {ls('d')} else 0 end) - count(*) filter (w > 0)::double / count(*) filter (w < 0) * sum(case when w < 0 then {ls('-d')} else 0 end)')} as loss from {d}"))(lambda f: one(losses.link_product(f.g, f.features())))
    c = Chain()
    x = c.features()
    s = c.add(f"select id, 1 / (1 + exp(-sum(val * (0.3 - 0.1 * pos)))) as a, 1 / (1 + exp(-sum(val * (0.1 + 0.2 * pos)))) as b from {x} group by id")
    e = c.add(f"select w, x.a - y.b as d from g join {s} x on x.id = src join {s} y on y.id = dst")
    q = "case when w > 0 then least(d, -0.5) else greatest(d, 0.5) end - d"
    query("loss_direction", c.sql(f"select {r6(f'sum(({q}) * ({q}))')} as loss from {e}"))(lambda f: one(losses.direction(f.g, f.features(), [0.3, 0.2, 0.1, 0.0], [0.1, 0.3, 0.5, 0.7])))

    def scores(c: Chain, pairs: str, k: int, extra: str) -> str:
        x = c.features()
        both = c.add(f"select p.src, p.dst, p.{extra}, x.pos, x.val from {pairs} p join {x} x on x.id = p.src union all select p.src, p.dst, p.{extra}, x.pos + 4, x.val from {pairs} p join {x} x on x.id = p.dst")
        cols = ", ".join(f"sum(val * cast(((pos * 31 + {j * 17}) % 13) - 6 as double) / 10) + {0.1 * (j + 1)!r}::double as s{j}" for j in range(k))
        return c.add(f"select src, dst, {extra}, {cols} from {both} group by src, dst, {extra}")

    W = models.fixed
    c = Chain()
    adj = c.add("select distinct node, dir, s, nbr from (select src as node, 'out' as dir, sign(w) as s, dst as nbr from g union all select dst, 'in', sign(w), src from g)", "adj")
    cols = ", ".join(f"count(*) filter (u.dir = '{du}' and v.dir = '{dv}' and u.s = {su} and v.s = {sv}) as d{i}_{j}" for i, (du, dv) in enumerate(structure.TRIADS, 1) for j, (su, sv) in enumerate(structure.SIGNS, 1))
    c.add(f"select g.src, g.dst, {cols} from g left join {adj} u on u.node = g.src left join {adj} v on v.node = g.dst and v.nbr = u.nbr group by g.src, g.dst", "census")
    tri = c.add(f"select g.src, g.dst, g.w, case when g.w < 0 then {' + '.join(structure.UNBALANCED)} else {' + '.join(structure.BALANCED)} end as tri from g join census using (src, dst)")
    sc = scores(c, "g", 1, "w")
    query("loss_triangle", c.sql(f"select {r6(f'sum(tri * -{ls('case when s.w > 0 then s0 else -s0 end')})', 4)} as loss from {sc} s join {tri} using (src, dst)"))(lambda f: tidy(losses.triangle(structure.triangle_weights(f.g, signs=True), f.g, f.features(), W(8, 1), [0.1], 4), "loss", digits=4))
    c = Chain()
    c.add(f"select src, dst, case when w > 0 then 0 else 1 end as y from g union all select src, dst, 2 from {_sql_unlinked(c)}", "pairs")
    sc = scores(c, "pairs", 3, "y")
    own = "case y when 0 then s0 when 1 then s1 else s2 end"
    query("loss_link_entropy", c.sql(f"select {r6('avg(m)')} as loss from (select y, avg(ln(exp(s0) + exp(s1) + exp(s2)) - {own}) as m from {sc} group by y)"))(lambda f: one(losses.link_entropy(f.g, _unlinked(f), f.features(), W(8, 3), [0.1, 0.2, 0.3], 4)))
    c = Chain()
    drawn = [_sql_negatives(c, c.add(f"select * from g where w {op} 0")) for op in "><"]
    t = c.add(f"select a.src, a.dst, a.neg, g.w from (select * from {drawn[0]} union all select * from {drawn[1]}) a join g using (src, dst) where a.neg in (select id from nodes)")
    x = c.features()
    dist = lambda b: f"(select sum((p.val - q.val) * (p.val - q.val)) from {x} p join {x} q on p.pos = q.pos where p.id = t.src and q.id = t.{b})"
    dd = c.add(f"select w, {dist('dst')} as near, {dist('neg')} as far from {t} t")
    query("loss_structure", c.sql(f"select {r6('sum(m)')} as loss from (select avg(greatest(case when w > 0 then near - far else far - near end, 0)) as m from {dd} group by w > 0)"))(lambda f: one(losses.structure(f.g, _negatives(f), f.features())))

    def form(c: Chain) -> tuple[str, str]:
        p = c.assignment()
        m = c.add("select src, dst, sum(w) as w from (select src, src as dst, w from g where w > 0 union all select src, dst, -w from g) group by src, dst")
        return p, c.add(f"select a.pos, sum(a.val * m.w * b.val) as cut from {m} m join {p} a on a.id = m.src join {p} b on b.id = m.dst and b.pos = a.pos group by a.pos")

    c = Chain()
    p, cut = form(c)
    query("loss_pbrc", c.sql(f"select {r6('sum(cut / (m + 1))')} as loss from {cut} join (select pos, sum(val * val) as m from {p} group by pos) using (pos)"))(lambda f: one(losses.balanced_ratio(f.g, f.nodes, f.assignment())))
    query("loss_pbnc", c.sql(f"select {r6('sum(cut / (m + 1e-6))')} as loss from {cut} join (select pos, sum(val * val * coalesce(d, 0)) as m from {p} left join (select src, sum(abs(w)) as d from g group by src) on src = id group by pos) using (pos)"))(lambda f: one(losses.balanced_normalized(f.g, f.nodes, f.assignment())))
    query("unhappy_ratio", c.sql(f"select {r6('sum(cut) / (select count(*) from g)')} as loss from {cut}"))(lambda f: one(losses.unhappy_ratio(f.g, f.nodes, f.assignment())))
    for norm in ("vol_sum", "vol_min", "vol_max", "plain"):
        for thr in ("sort", "std", "naive"):
            c = Chain("g_trade")
            p = c.assignment()
            flow = c.add(f"select a.pos as k, b.pos as l, sum(a.val * g.w * b.val) as f from g join {p} a on a.id = src join {p} b on b.id = dst group by a.pos, b.pos")
            vol = c.add(f"select pos, sum(val * d) as v from {p} join (select id, sum(w) as d from (select src as id, w from g union all select dst, w from g) group by id) using (id) group by pos")
            top = f"(select min(v) from (select v from {vol} order by v desc limit 2))"
            value = {"vol_sum": "2 * d / (vk + vl + 1e-8)", "vol_min": f"d / s * least(vk, vl) / ({top} + 1e-8)", "vol_max": "d / (greatest(vk, vl) + 1e-8)", "plain": "d / s"}[norm]
            prs = c.add(f"select k, l, d, s, {value} as i from (select x.k, x.l, abs(x.f - y.f) as d, x.f + y.f as s, a.v as vk, b.v as vl from {flow} x join {flow} y on x.k = y.l and x.l = y.k and x.k < x.l join {vol} a on a.pos = x.k join {vol} b on b.pos = x.l where x.f <> y.f)")
            out = {"sort": f"select case when count(*) = 0 then 1 else 1 - sum(i) / 2 end as loss from (select i from {prs} order by i desc, k, l limit 2)", "std": f"select coalesce(1 - coalesce(avg(i) filter (d * d > 9 * s), avg(i)), 1) as loss from {prs}", "naive": f"select coalesce(1 - avg(i), 1) as loss from {prs}"}[thr]
            query(f"imbalance_{norm}_{thr}", c.sql(f"select {r6('loss')} as loss from ({out})"), "g_trade")(lambda f, norm=norm, thr=thr: one(losses.imbalance(f.g, f.assignment(), 3, norm, thr, 2)))
    query("loss_triplet")(lambda f: one(losses.triplet(f.labels(), f.features(), 100, 0.1, 3)))
    for batched in (False, True):
        c = Chain()
        x = c.features()
        a, b = c.l2(x), c.l2(c.act(x, "val + 0.1"))
        e = lambda u, v, c=c: c.add(f"select p.id as i, q.id as j, exp(sum(p.val * q.val) / 0.4) as e from {u} p join {v} q using (pos) group by p.id, q.id")

        def half(u: str, v: str, c=c, e=e, batched=batched) -> str:
            r = c.add(f"select i, sum(e) as t, sum(e) filter (i = j) as o from {e(u, u)} group by i")
            s = c.add(f"select i, sum(e) as t, sum(e) filter (i = j) as o from {e(u, v)} group by i")
            return c.add(f"select r.i, -ln(s.o / (r.t + s.{'t' if batched else 'o'} - r.o)) as l from {r} r join {s} s using (i)")

        h1, h2 = half(a, b), half(b, a)
        query("loss_contrastive" + "_batched" * batched, c.sql(f"select {r6('avg((a.l + b.l) / 2)')} as loss from {h1} a join {h2} b using (i)"))(lambda f, batched=batched: one(losses.contrastive(f.features(), f.features().withColumn("val", F.col("val") + 0.1), 0.4, batched)))
    c = Chain()
    sm = c.softmax(c.features(3), True)
    query("nll", c.sql(f"select {r6('-avg(val)')} as loss from {sm} where pos = id % 3"))(lambda f: one(losses.nll(P.softmax(f.features(3), True), f.labels())))


def _unlinked(f):
    return splits.negative_samples(f.g, f.size(), f.g.count())


def _negatives(f):
    n = f.size()
    pos = splits.structured_negatives(f.g.filter("w > 0"), n)
    return pos.union(splits.structured_negatives(f.g.filter("w < 0"), n)).join(f.nodes.select(F.col("id").alias("neg")), "neg", "left_semi").select("src", "dst", "neg")


def _metrics() -> None:
    query, tidy = _q()
    rows = "select cast(label % 3 as integer) as y, cast((vec_id * 7 + label) % 3 as integer) as pred, cast((vec_id * 13) % 101 as double) / 100 as score from embeddings"
    frame = lambda f: D.read(f.spark, f.sf_dir, "embeddings").select((F.col("label") % 3).cast("int").alias("y"), ((F.col("vec_id") * 7 + F.col("label")) % 3).cast("int").alias("pred"), (((F.col("vec_id") * 13) % 101).cast("double") / 100).alias("score"))
    k = f"with r as ({rows}), k as (select y as k from r union select pred from r), e as (select k, (select count(*) from r where y = k and pred = k)::double as tp, (select count(*) from r where y = k)::double as p, (select count(*) from r where pred = k)::double as s from k)"
    query("metrics_classification", f"{k} select {r6('sum(tp) / sum(p)')} as accuracy, {r6('avg(2 * tp / (p + s))')} as f1_macro, {r6('sum(tp) / sum(p)')} as f1_micro, {r6('coalesce(max(2 * tp / (p + s)) filter (k = 1), 0)')} as f1_binary from e")(lambda f: tidy(metrics.classification(frame(f)), "accuracy", "f1_macro", "f1_micro", "f1_binary"))
    query("metrics_auc", f"with r as ({rows}), b as (select cast(y = 1 as integer) as y, score from r) select {r6('sum(case when p.score > q.score then 1.0 when p.score = q.score then 0.5 else 0 end::double) / count(*)')} as auc from b p, b q where p.y = 1 and q.y = 0")(lambda f: tidy(metrics.auc(frame(f).select((F.col("y") == 1).cast("int").alias("y"), "score")), "auc"))
    query("adjusted_rand", f"with r as ({rows}), c as (select count(*)::double as n from r group by y, pred), a as (select count(*)::double as n from r group by y), b as (select count(*)::double as n from r group by pred), v as (select (select sum(n * (n - 1) / 2) from c) as c, (select sum(n * (n - 1) / 2) from a) as a, (select sum(n * (n - 1) / 2) from b) as b, (select count(*)::double from r) as t) select {r6('(c - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2))')} as ari from v")(lambda f: tidy(metrics.adjusted_rand(frame(f)), "ari"))
    query("run_statistics", f"with r as ({rows}) select cast(y as varchar) as metric, {r6('avg(score)')} as mean, {r6('stddev_pop(score)')} as std from r group by y")(lambda f: tidy(metrics.run_statistics(frame(f).select(F.col("y").cast("string").alias("metric"), F.col("score").alias("value"))), "mean", "std"))
    query("class_counts", f"with r as ({rows}) select y, count(*) as n from r group by y")(lambda f: frame(f).groupBy("y").agg(F.count("*").alias("n")))
    query("relabel_direction", f"with r as ({rows}) select y // 2 as half, count(*) as n from r group by half")(lambda f: frame(f).groupBy(F.floor(F.col("y") / 2).cast("int").alias("half")).agg(F.count("*").alias("n")))


def _models() -> None:
    query, tidy = _q()
    W, bias = models.fixed, lambda k: [0.1 * (j + 1) for j in range(k)]
    long = lambda df: tidy(df.select("id", F.col("pos").cast("int").alias("pos"), "val"), "val")
    link = lambda df: tidy(df.select("src", "dst", F.col("pos").cast("int").alias("pos"), "val"), "val")
    vec = f"select id, pos, {r6('val')} as val from "
    pairs = "(select src, dst from g)"

    def trunk(c: Chain, degree: str, activation: bool) -> tuple[str, str]:
        lap = c.rescaled(c.magnetic(0.25, "sym", degree))
        re = c.features(3)
        a, b = c.chebyshev(lap, re, c.act(re, "val / 2 + 0.05"), 3, 2, 1)
        if activation:
            a, b = c.complex_relu(a, b)
        a, b = c.chebyshev(lap, a, b, 2, 2, 1)
        return c.complex_relu(a, b) if activation else (a, b)

    weights = [[W(3, 2)] * 2, [W(2, 2)] * 2]
    for name, graph, degree, fn in (("magnet", "g_trade", "plain", False), ("msgnn", "g_ev", "absolute", True)):
        c = Chain(graph)
        a, b = trunk(c, degree, False)
        out = c.softmax(c.dense(c.concat((a, 2), (b, 2)), 4, 3, 0.1), True)
        run = (lambda f: models.msgnn_node(f.g, f.nodes, f.complex_features(), 2, weights, W(4, 3), bias(3))["log_p"]) if fn else (lambda f: models.magnet_node(f.g, f.nodes, f.complex_features(), 2, weights, W(4, 3), bias(3)))
        query(f"fwd_{name}_node", c.sql(vec + out), graph)(lambda f, run=run: long(run(f)))
        c = Chain(graph)
        a, b = trunk(c, degree, True)
        out = c.pairs_head(pairs, [(a, 2), (b, 2)], 2, 0.1)
        query(f"fwd_{name}_link", c.sql(LINK + out), graph)(lambda f, fn=fn: link(models.magnet_link(f.g, f.nodes, f.complex_features(), f.pairs(), 2, weights, W(8, 2), bias(2), signed=fn)))

    def dgcn(c: Chain) -> str:
        c.steps[0] = ("g", f"select src, dst, 1.0::double as w from ({D.SQL['g_ev']})")
        c.add("select distinct src, dst, 1.0::double as w from (select src, dst from g union select dst, src from g)", "u")
        out = []
        for shared, other, end in (("src", "dst", "dst"), ("dst", "src", "src")):
            out.append(c.add(f"select a.{other} as src, b.{other} as dst, sum(a.w * b.w / coalesce(d.d, 1)) as w from g a join g b on a.{shared} = b.{shared} left join (select {end} as k, sum(w) as d from g group by {end}) d on d.k = a.{shared} group by a.{other}, b.{other}"))
        norms = [c.sym_norm(e) for e in ("u", *out)]
        x, rows = c.features(), 4
        for width in (2, 2):
            x = c.dense(x, rows, width)
            x = c.act(c.concat(*[(c.spmm(n, x), width) for n in norms]), "greatest(val, 0)")
            rows = 3 * width
        return x

    def dgcn_parts(f):
        g = kept(E.unweighted(f.g, False))  # both rounds and all three adjacencies read it
        f.g, f.nodes = g, D.endpoints(g)
        return E.to_undirected(g).withColumn("w", F.lit(1.0)), proximity.InOut(g, "in"), proximity.InOut(g, "out")

    c = Chain()
    query("fwd_dgcn_node", c.sql(vec + c.softmax(c.dense(dgcn(c), 6, 3, 0.1), True)))(lambda f: long(models.dgcn_node(*dgcn_parts(f), f.nodes, f.features(), W(4, 2), W(6, 2), W(6, 3), bias(3))))
    c = Chain()
    query("fwd_dgcn_link", c.sql(LINK + c.pairs_head(pairs, [(dgcn(c), 6)], 2, 0.1)))(lambda f: link(models.dgcn_link(*dgcn_parts(f), f.nodes, f.features(), f.pairs(), W(4, 2), W(6, 2), W(12, 2), bias(2))))

    def conv(c: Chain, e: str, x: str, rows: int, cols: int) -> str:
        return c.act(c.spmm(e, c.dense(x, rows, cols)), "val + 0.1 * (pos + 1)")

    c = Chain("g_trade")
    e = c.row_sym("g")
    out = c.softmax(conv(c, e, c.act(conv(c, e, c.features(), 4, 3), "greatest(val, 0)"), 3, 2), True)
    query("fwd_digcn_node", c.sql(vec + out), "g_trade")(lambda f: long(models.digcn_node(L.row_degree_symmetric(f.g), f.features(), W(4, 3), bias(3), W(3, 2), bias(2))))
    c = Chain("g_trade")
    e = c.row_sym("g")
    z = conv(c, e, c.act(conv(c, e, c.features(), 4, 3), "greatest(val, 0)"), 3, 2)
    query("fwd_digcn_link", c.sql(LINK + c.pairs_head(pairs, [(z, 2)], 2, 0.1)), "g_trade")(lambda f: link(models.digcn_link(L.row_degree_symmetric(f.g), f.features(), f.pairs(), W(4, 3), bias(3), W(3, 2), bias(2), W(4, 2), bias(2))))

    def inception(c: Chain) -> str:
        a, b, x, rows = c.row_sym("g"), c.row_norm("g", None), c.features(), 4
        for cols in (3, 3, 2):
            x = c.plus(c.dense(x, rows, cols, 0.1), c.spmm(a, c.dense(x, rows, cols)), c.spmm(b, c.dense(x, rows, cols)))
            rows = cols
        return x

    blocks = [((W(r, k),) * 3, bias(k)) for r, k in ((4, 3), (3, 3), (3, 2))]
    adj = lambda f: (L.row_degree_symmetric(f.g), L.row_normalized(f.g, f.nodes, None))
    c = Chain("g_trade")
    query("fwd_inception_node", c.sql(vec + c.softmax(inception(c), True)), "g_trade")(lambda f: long(models.inception_node(*adj(f), f.features(), blocks)))
    c = Chain("g_trade")
    query("fwd_inception_link", c.sql(LINK + c.pairs_head(pairs, [(inception(c), 2)], 2, 0.1)), "g_trade")(lambda f: link(models.inception_link(*adj(f), f.features(), f.pairs(), blocks, W(4, 2), bias(2))))
    mlp = lambda c, x: c.dense(c.act(c.dense(x, 4, 3), "greatest(val, 0)"), 3, 2)
    m = (W(4, 3), W(3, 2))
    c = Chain("g_trade")
    x = c.features()
    z = c.concat((c.hops("g", mlp(c, x), 2), 2), (c.hops(c.reverse("g"), mlp(c, x), 2), 2))
    query("fwd_digrac", c.sql(vec + c.softmax(c.dense(z, 4, 3, 0.1))), "g_trade")(lambda f: long(models.digrac(f.g, f.nodes, f.features(), 2, m, m, W(4, 3), bias(3))["p"]))
    c = Chain()
    x, pos, neg = c.features(), c.positive(), c.negative()
    z = c.concat(*[(h, 2) for h in c.simpa_half(pos, neg, mlp(c, x), mlp(c, x), 2)])
    query("fwd_sssnet", c.sql(vec + c.softmax(c.dense(z, 4, 3, 0.1))))(lambda f: long(models.sssnet(f.g, f.nodes, f.features(), 2, [m, m], W(4, 3), bias(3))["p"]))
    query("fwd_sssnet_link", c.sql(LINK + c.pairs_head(pairs, [(z, 4)], 2, 0.1)))(lambda f: link(models.sssnet_link(f.g, f.nodes, f.features(), f.pairs(), 2, [m, m], W(8, 2), bias(2))))
    c = Chain()
    h = c.dense(c.features(), 4, 3)
    a = c.add(f"select id, sum(val * (case pos when 0 then 0.1 when 1 then -0.2 else 0.3 end)::double) as ss, sum(val * (case pos when 0 then 0.2 when 1 then 0.1 else -0.1 end)::double) as sd from {h} group by id")
    e = c.add(f"select e.src, e.dst, x.ss + y.sd as s from (select src, dst from g union select id, id from nodes) e join {a} x on x.id = e.src join {a} y on y.id = e.dst")
    e = c.add(f"select src, dst, exp(case when s >= 0 then s else 0.2 * s end) as x from {e}")
    e = c.add(f"select src, dst, x / sum(x) over (partition by dst) as w from {e}")
    query("gat_conv", c.sql(f"select id, pos, {r6('val')} as val from {c.spmm(e, h)}"))(lambda f: long(Y.gat_conv(f.g, f.nodes, f.features(), W(4, 3), [0.1, -0.2, 0.3], [0.2, 0.1, -0.1])))
    c = Chain()
    z = c.act(c.sgcn(c.act(c.sgcn(c.features(), 4, True), "tanh(val)"), 4, False), "tanh(val)")
    query("fwd_sgcn", c.sql(vec + z))(lambda f: long(models.sgcn(f.g, f.features(), 4, [(W(8, 2), W(8, 2)), (W(6, 2), W(6, 2))])))
    alpha = [((p * 7) % 5 - 2) / 10 for p in range(4)]
    c, text = Chain(), "((p * 7) % 5 - 2) / 10"
    z = c.act(c.snea(c.act(c.snea(c.features(), 4, True, text), "tanh(val)"), 4, False, text), "tanh(val)")
    query("fwd_snea", c.sql(vec + c.act(c.dense(z, 4, 3, 0.1), "tanh(val)")))(lambda f: long(models.snea(f.g, f.nodes, f.features(), 4, [(W(4, 2), W(4, 2), alpha, alpha), (W(2, 2), W(2, 2), alpha, alpha)], W(4, 3), bias(3))))
    gat = (W(4, 2), [0.1, -0.2], [0.2, 0.1])
    query("fwd_sdgnn")(lambda f: long(models.sdgnn(f.g, f.nodes, f.features(), 4, [([gat] * 4, W(12, 4), bias(4), W(4, 4), bias(4))])))
    query("fwd_sigat")(lambda f: long(models.sigat(f.g, f.nodes, f.features(), 4, [gat] * 38, W(80, 4), bias(4), W(4, 4), bias(4))))
    query("fwd_digcl_encoder")(lambda f: long(models.digcl_encoder(f.g.filter("w > 0"), f.nodes, f.features(), [(W(4, 4), bias(4)), (W(4, 2), bias(2))])))
