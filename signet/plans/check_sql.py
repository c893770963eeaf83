"""SQL that checks the queries: chains of common table expressions, written apart from the operators."""

from __future__ import annotations

import math

from signet.sources.derived import SQL as DERIVED


class Chain:
    """Common table expressions in order; each step has a name that later ones use."""

    def __init__(self, graph: str | None = "g_ev"):
        self.steps: list[tuple[str, str]] = []
        if graph:
            self.add(DERIVED[graph], "g")
            self.add(f"select distinct id from ({DERIVED['nodes']})", "nodes")

    def add(self, sql: str, name: str | None = None) -> str:
        name = name or f"t{len(self.steps)}"
        self.steps.append((name, sql))
        return name

    def sql(self, final: str) -> str:
        return "with " + ",\n".join(f"{n} as materialized ({s})" for n, s in self.steps) + f"\n{final}"

    # --- building blocks
    def features(self, dims: int = 4) -> str:
        return self.add(f"select id, cast(p as integer) as pos, cast(((id * 7 + p * 3) % 11) - 5 as double) / 10 as val from nodes, (select unnest(range({dims})) as p)")

    def assignment(self, k: int = 3) -> str:
        raw = self.add(f"select id, cast(p as integer) as pos, cast(1 + (id * 7 + p * 3) % 5 as double) as val from nodes, (select unnest(range({k})) as p)")
        return self.add(f"select id, pos, val / sum(val) over (partition by id) as val from {raw}")

    def loops(self, e: str, fill: float, remaining: bool) -> str:
        if remaining:
            return self.add(f"select src, dst, w from {e} union all select id, id, {fill}::double from nodes where id not in (select src from {e} where src = dst)")
        return self.add(f"select src, dst, sum(w) as w from (select src, dst, w from {e} union all select id, id, {fill}::double from nodes) group by src, dst")

    def row_norm(self, e: str, fill: float | None = 0.5) -> str:
        a = e if fill is None else self.loops(e, fill, True)
        return self.add(f"select src, dst, case when sum(w) over (partition by src) = 0 then 0 else w / sum(w) over (partition by src) end as w from {a}")

    def sym_norm(self, e: str, fill: float = 1.0) -> str:
        a = self.loops(e, fill, True)
        d = self.add(f"select id, coalesce((select sum(w) from {a} where dst = id), 0) as d from nodes")
        d = self.add(f"select id, case when d = 0 then 0 else power(d, -0.5) end as r from {d}")
        return self.add(f"select a.src, a.dst, x.r * a.w * y.r as w from {a} a join {d} x on a.src = x.id join {d} y on a.dst = y.id")

    def row_sym(self, e: str) -> str:
        d = self.add(f"select src as id, case when sum(w) = 0 then 0 else power(sum(w), -0.5) end as r from {e} group by src")
        return self.add(f"select a.src, a.dst, x.r * a.w * coalesce(y.r, 0) as w from {e} a join {d} x on a.src = x.id left join {d} y on a.dst = y.id")

    def spmm(self, e: str, x: str, to: str = "dst", w: str = "w") -> str:
        other = "src" if to == "dst" else "dst"
        return self.add(f"select e.{to} as id, x.pos, sum(e.{w} * x.val) as val from {e} e join {x} x on e.{other} = x.id group by e.{to}, x.pos")

    def dense(self, x: str, rows: int, cols: int, bias: float | None = None) -> str:
        """By the fixed weights; bias: b_j = bias * (j + 1)."""
        b = "" if bias is None else f" + {bias} * (j + 1)"
        return self.add(f"select id, cast(j as integer) as pos, sum(val * cast(((pos * 31 + j * 17) % 13) - 6 as double) / 10){b} as val from {x}, (select unnest(range({cols})) as j) group by id, j")

    def concat(self, *parts: tuple[str, int]) -> str:
        out, at = [], 0
        for x, width in parts:
            out.append(f"select id, cast(pos + {at} as integer) as pos, val from {x}")
            at += width
        return self.add(" union all ".join(out))

    def plus(self, *parts: str) -> str:
        return self.add("select id, pos, sum(val) as val from (" + " union all ".join(f"select id, pos, val from {p}" for p in parts) + ") group by id, pos")

    def act(self, x: str, expr: str) -> str:
        return self.add(f"select id, pos, {expr} as val from {x}")

    def softmax(self, x: str, log: bool = False) -> str:
        m = self.add(f"select id, max(val) as m from {x} group by id")
        t = self.add(f"select x.id, m, sum(exp(val - m)) as t from {x} x join {m} using (id) group by x.id, m")
        return self.add(f"select x.id, pos, {'val - m - ln(t)' if log else 'exp(val - m) / t'} as val from {x} x join {t} using (id)")

    def l2(self, x: str) -> str:
        n = self.add(f"select id, greatest(sqrt(sum(val * val)), 1e-12) as n from {x} group by id")
        return self.add(f"select x.id, pos, val / n as val from {x} x join {n} using (id)")

    def magnetic(self, q: float = 0.25, normalization: str | None = "sym", degree: str = "plain") -> str:
        a = self.add("select src, dst, sum(w) / 2 as a, sum(t) as t, sum(b) / 2 as b from (select src, dst, w, w as t, abs(w) as b from g where src <> dst union all select dst, src, w, -w, abs(w) from g where src <> dst) group by src, dst")
        size = {"plain": "sum(a)", "absolute": "sum(b)", "net": "sum(abs(a))"}[degree]
        d = self.add(f"select n.id, coalesce(s.d, 0) as d from nodes n left join (select src, {size} as d from {a} group by src) s on s.src = n.id")
        ang = f"{2 * math.pi * q!r}::double * t"
        if normalization == "sym":
            r = self.add(f"select id, case when d = 0 then 0 else power(d, -0.5) end as r from {d}")
            return self.add(f"select src, dst, -x.r * a * y.r * cos({ang}) as re, -x.r * a * y.r * sin({ang}) as im from {a} join {r} x on x.id = src join {r} y on y.id = dst union all select id, id, 1.0::double, 0.0::double from nodes")
        return self.add(f"select src, dst, -a * cos({ang}) as re, -a * sin({ang}) as im from {a} union all select id, id, d, 0.0::double from {d}")

    def rescaled(self, lap: str) -> str:
        return self.add(f"select src, dst, re, im from {lap} union all select id, id, -1.0::double, 0.0::double from nodes")

    def chebyshev(self, lap: str, re: str, im: str, rows: int, cols: int, k: int) -> tuple[str, str]:
        """(re, im) of the filter with K = k, the same fixed weights for all terms."""
        chains = {"rr": (re, "re"), "ri": (im, "re"), "ir": (re, "im"), "ii": (im, "im")}
        terms = {c: [x] for c, (x, _) in chains.items()}
        for step in range(1, k + 1):
            for c, (_, part) in chains.items():
                moved = self.spmm(lap, terms[c][-1], w=part)
                if step > 1:
                    moved = self.plus(self.act(moved, "2 * val"), self.act(terms[c][-2], "-val"))
                terms[c].append(moved)
        total = {c: self.plus(*[self.dense(t, rows, cols) for t in terms[c]]) for c in chains}
        return self.plus(total["rr"], self.act(total["ii"], "-val")), self.plus(total["ir"], total["ri"])

    def complex_relu(self, re: str, im: str) -> tuple[str, str]:
        both = self.add(f"select r.id, r.pos, case when r.val >= 0 then r.val else 0 end as re, case when r.val >= 0 then i.val else 0 end as im from {re} r join {im} i on r.id = i.id and r.pos = i.pos")
        return self.add(f"select id, pos, re as val from {both}"), self.add(f"select id, pos, im as val from {both}")

    def pairs_head(self, pairs: str, parts: list[tuple[str, int]], cols: int, bias: float) -> str:
        """Scores of pairs from blocks u, v of each part; the result is (src, dst, pos, val)."""
        out, at = [], 0
        for x, width in parts:
            for end in ("src", "dst"):
                out.append(f"select p.src, p.dst, cast(x.pos + {at} as integer) as pos, x.val from {pairs} p join {x} x on x.id = p.{end}")
                at += width
        both = self.add(" union all ".join(out))
        s = self.add(f"select src, dst, cast(j as integer) as pos, sum(val * cast(((pos * 31 + j * 17) % 13) - 6 as double) / 10) + {bias} * (j + 1) as val from {both}, (select unnest(range({cols})) as j) group by src, dst, j")
        return self.add(f"select src, dst, pos, val - ln(sum(exp(val)) over (partition by src, dst)) as val from {s}")

    def negative(self) -> str:
        return self.add("select src, dst, -w as w from g where w < 0")

    def positive(self) -> str:
        return self.add("select src, dst, w from g where w > 0")

    def reverse(self, e: str) -> str:
        return self.add(f"select dst as src, src as dst, w from {e}")

    def hops(self, e: str, x: str, hops: int, fill: float = 0.5) -> str:
        a, now, parts = self.row_norm(e, fill), x, [x]
        for _ in range(hops):
            now = self.spmm(a, now, to="src")
            parts.append(now)
        return self.plus(*parts)

    def simpa_half(self, pos: str, neg: str, xp: str, xn: str, hops: int, fill: float = 0.5) -> tuple[str, str]:
        ap, an = self.row_norm(pos, fill), self.row_norm(neg, None)
        now, p = xp, [xp]
        for _ in range(hops):
            now = self.spmm(ap, now, to="src")
            p.append(now)
        terms, now = [], xn
        for before in range(hops):
            if before:
                now = self.spmm(ap, now, to="src")
            far = self.spmm(an, now, to="src")
            terms.append(far)
            for _ in range(hops - 1 - before):
                far = self.spmm(ap, far, to="src")
                terms.append(far)
        return self.plus(*p), self.plus(*terms)

    def mean(self, cond: str, x: str) -> str:
        return self.add(f"select e.dst as id, x.pos, avg(x.val) as val from g e join {x} x on e.src = x.id where {cond} group by e.dst, x.pos")

    def attention(self, parts: list[tuple[str, str]], alpha: str, half: int) -> str:
        """parts: (pairs, vectors); alpha: SQL of the weight at position p."""
        rows = []
        for k, (pairs, h) in enumerate(parts):
            s = self.add(f"select id, sum(({alpha.replace('p', 'pos')}) * val) as a, sum(({alpha.replace('p', f'(pos + {half})')}) * val) as b from {h} group by id")
            rows.append(f"select e.dst, {k} as part, exp(tanh(x.a + y.b)) as x from {pairs} e join {s} x on e.src = x.id join {s} y on e.dst = y.id")
        e = self.add(" union all ".join(rows))
        m = self.add(f"select dst, part, sum(x) as x from {e} group by dst, part")
        m = self.add(f"select dst, part, x / sum(x) over (partition by dst) as att from {m}")
        out = " union all ".join(f"select h.id, h.pos, h.val * m.att as val from {m} m join {h} h on h.id = m.dst where m.part = {k}" for k, (_, h) in enumerate(parts))
        return self.add(f"select id, pos, sum(val) as val from ({out}) group by id, pos")

    def sgcn(self, x: str, width: int, first: bool) -> str:
        if first:
            b = self.dense(self.concat((self.mean("e.w > 0", x), width), (x, width)), 2 * width, 2)
            u = self.dense(self.concat((self.mean("e.w < 0", x), width), (x, width)), 2 * width, 2)
        else:
            h = width // 2
            xb, xu = self.add(f"select id, pos, val from {x} where pos < {h}"), self.add(f"select id, cast(pos - {h} as integer) as pos, val from {x} where pos >= {h}")
            b = self.dense(self.concat((self.mean("e.w > 0", xb), h), (self.mean("e.w < 0", xu), h), (xb, h)), 3 * h, 2)
            u = self.dense(self.concat((self.mean("e.w > 0", xu), h), (self.mean("e.w < 0", xb), h), (xu, h)), 3 * h, 2)
        return self.concat((b, 2), (u, 2))

    def snea(self, x: str, width: int, first: bool, alpha: str) -> str:
        pairs = {}
        for op in (">", "<"):
            e = self.add(f"select src, dst from g where w {op} 0 and src <> dst")
            pairs[op] = e, self.add(f"select src, dst from {e} union all select id, id from nodes where id <= (select max(greatest(src, dst)) from {e})")
        if first:
            b = self.attention([(pairs[">"][1], self.dense(x, width, 2))], alpha, 2)
            u = self.attention([(pairs["<"][1], self.dense(x, width, 2))], alpha, 2)
        else:
            h = width // 2
            xb = self.dense(self.add(f"select id, pos, val from {x} where pos < {h}"), h, 2)
            xu = self.dense(self.add(f"select id, cast(pos - {h} as integer) as pos, val from {x} where pos >= {h}"), h, 2)
            b = self.attention([(pairs[">"][1], xb), (pairs["<"][0], xu)], alpha, 2)
            u = self.attention([(pairs[">"][1], xu), (pairs["<"][0], xb)], alpha, 2)
        return self.concat((b, 2), (u, 2))


def uniform(*parts: str) -> str:
    """SQL of the hash-based uniform number; parts are SQL expressions."""
    return f"(cast(concat('0x', substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8)) as bigint) / 4294967296::double)"


def hash_key(*parts: str) -> str:
    return f"md5(concat_ws(':', {', '.join(parts)}))"


def r6(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"
