"""DuckDB SQL of whole-width fits: partial least squares by its recurrences, and linear systems by elimination, a statement a step."""

from __future__ import annotations

#: Samples with their response (element 6), the other elements as rows, and five folds of consecutive samples.
_ROWS = """
n as (select count(*) n from embeddings),
s as (select vec_id sample_idx, (vec_id // ceil(n / 5)::bigint)::int fold, embedding[7]::double y, list_transform(list_concat(embedding[1:6], embedding[8:64]), lambda v: v::double) x from embeddings, n),
l as (select sample_idx, {value} v, generate_subscripts(x, 1) j from s)"""
PLAIN = "unnest(x)"
SNV = "unnest(list_transform(x, lambda v: (v - list_avg(x)) / list_stddev_samp(x)))"


def centred(value: str = PLAIN, whole: bool = False) -> str:
    """e0 and f0: variables and response less the means of the training rows of each fold g (with ``whole`` also of all rows, g -1)."""
    folds = "(select distinct fold g from s" + (" union all select -1)" if whole else ")")
    return (
        _ROWS.format(value=value)
        + f""",
f0 as materialized (select g, sample_idx, fold, fold <> g train, y, y - avg(y) filter (where fold <> g) over (partition by g) f from s, {folds}),
e0 as materialized (select g, sample_idx, train, j, v - avg(v) filter (where train) over (partition by g, j) v from f0 join l using (sample_idx))"""
    )


def pls(components: int) -> str:
    """For each component a: w{a}, t{a} (with its training square tt and y loading q), p{a}, and what is left of both blocks, e{a} and f{a}."""
    out = []
    for a in range(1, components + 1):
        b = a - 1
        out.append(f"""
w{a} as materialized (select g, j, c / sqrt(sum(c * c) over (partition by g)) w from (select e{b}.g, j, sum(v * f) c from e{b} join f{b} using (g, sample_idx) where e{b}.train group by all)),
r{a} as materialized (select e{b}.g, sample_idx, sum(v * w) t from e{b} join w{a} using (g, j) group by all),
t{a} as materialized (select g, sample_idx, t, sum(t * t) filter (where train) over (partition by g) tt, sum(t * f) filter (where train) over (partition by g) / sum(t * t) filter (where train) over (partition by g) q from r{a} join f{b} using (g, sample_idx)),
p{a} as materialized (select e{b}.g, j, sum(v * t) / any_value(tt) p from e{b} join t{a} using (g, sample_idx) where train group by all),
e{a} as materialized (select g, sample_idx, train, j, v - t * p v from e{b} join t{a} using (g, sample_idx) join p{a} using (g, j)),
f{a} as materialized (select g, sample_idx, fold, train, y, f - t * q f from f{b} join t{a} using (g, sample_idx))""")
    return ",".join(out)


def _curve(rows: str, digits: int) -> str:
    return f"select a, round(sqrt(avg(f * f)), {digits}) rmsecv, round(1 - sum(f * f) / (var_pop(y) * count(*)), {digits}) q2 from ({rows}) group by a"


def pls_curve(first: int, last: int, value: str = PLAIN, digits: int = 8) -> str:
    """Errors of ``first`` to ``last`` components, numbered from 1."""
    rows = " union all ".join(f"select {a - first + 1} a, y, f from f{a} where not train" for a in range(first, last + 1))
    return f"with {centred(value)},{pls(last)} {_curve(rows, digits)}"


def pls_explained(components: int) -> str:
    """Shares of the centred sums of squares."""
    parts = " union all ".join(f"select {a} a, (select any_value(tt) from t{a} where g = -1) * (select sum(p * p) from p{a} where g = -1) / (select sum(v * v) from e0 where g = -1) x, (select any_value(tt * q * q) from t{a} where g = -1) / (select sum(f * f) from f0 where g = -1) y" for a in range(1, components + 1))
    return f"with {centred(whole=True)},{pls(components)}, r as ({parts}) select a, round(x, 8) x, round(y, 8) y, round(sum(x) over (order by a), 8) x_total, round(sum(y) over (order by a), 8) y_total from r"


def pls_predictions(components: int) -> str:
    """Of every sample by the fit of all."""
    return f"with {centred(whole=True)},{pls(components)} select sample_idx, round(y - f, 6) + 0.0 p from f{components} where g = -1"


def regression_result(chosen: int, components: int) -> str:
    """The numbers of a model of ``chosen`` components in and out of sample."""
    inside = {
        "n": "count(*)", "rmsec": "sqrt(avg(f * f))", "bias": "avg(f)", "r2": "1 - sum(f * f) / (var_pop(y) * count(*))", "sec": f"sqrt((sum(f * f) - count(*) * avg(f) * avg(f)) / (count(*) - {chosen} - 1))", "r2_pearson": "corr(y, y - f) ** 2",
    }
    held = {"rmsecv": "sqrt(avg(f * f))", "q2": "1 - sum(f * f) / (sum(y * y) - sum(y) ** 2 / count(*))"}
    parts = [f"select 'calibration' part, '{k}' metric, ({v})::double as value from f{chosen} where g = -1" for k, v in inside.items()]
    parts += [f"select 'cross_validation', '{k}', {v} from f{chosen} where not train" for k, v in held.items()]
    parts.append(f"select 'cross_validation', 'rmsecv_std', stddev_samp(r) from (select sqrt(avg(f * f)) r from f{chosen} where not train group by g)")
    parts.append(f"select 'cross_validation', 'rmsecv_fold_' || g, sqrt(avg(f * f)) from f{chosen} where not train group by g")
    parts += [f"select 'cross_validation', 'rmsecv_a{a}', sqrt(avg(f * f)) from f{a} where not train" for a in range(1, components + 1)]
    return f"with {centred(whole=True)},{pls(components)}, r as ({' union all '.join(parts)}) select part, metric, round(value, 8) as value from r"


def eliminated(name: str, width: str, keys: str) -> str:
    """A recursive table that reduces the matrices ``{name}(keys, i, j, v)``, rows and columns from 1, to the identity on their first ``width`` columns, a row a step."""
    of = lambda test, also="": f"max(case when {test} then v end) over (partition by {keys}{also})"
    pivot, across, down = of("i = step + 1 and j = step + 1"), of("j = step + 1", ", i"), of("i = step + 1", ", j")
    return f"{name}_x as (select {keys}, i, j, 0 step, v from {name} union all select {keys}, i, j, step + 1, case when i = step + 1 then v / {pivot} else v - {across} * {down} / {pivot} end from {name}_x where step < {width})"


def ridge_curve(alphas: list[float], digits: int = 6) -> str:
    """Errors of ridge regressions (zero: least squares) by the normal equations of each fold's training rows."""
    grid = ", ".join(f"({k + 1}, {a!r}::double)" for k, a in enumerate(alphas))
    return f"""with recursive {centred()},
grid(a, alpha) as (values {grid}),
xx as materialized (select p.g, p.j i, q.j j, sum(p.v * q.v) v from e0 p join e0 q using (g, sample_idx) where p.train group by all),
m as materialized (select a, g, i, j, v + case when i = j then alpha else 0 end v from xx, grid union all select a, e0.g, j i, 64 j, sum(v * f) v from e0 join f0 using (g, sample_idx), grid where e0.train group by all),
{eliminated("m", "63", "a, g")},
b as materialized (select a, g, i j, v b from m_x where step = 63 and j = 64),
h as (select a, f0.g, sample_idx, any_value(y) y, any_value(f) - sum(v * b) f from e0 join f0 using (g, sample_idx) join b using (g, j) where not f0.train group by all)
{_curve("select a, y, f from h", digits)}"""


def whittaker(lam: float, width: int = 64) -> str:
    """Each sample times the inverse of the identity and ``lam`` times the square of second differences."""
    return f"""with recursive s as (select vec_id sample_idx, list_transform(embedding, lambda v: v::double) x from embeddings),
l as (select sample_idx, unnest(x) v, generate_subscripts(x, 1) j from s),
d as (select k, k + o i, [1, -2, 1][o] c from range({width - 2}) r(k), range(1, 4) q(o)),
dd as (select p.i, q.i j, sum(p.c * q.c) v from d p join d q using (k) group by all),
c as (select i, j from range(1, {width + 1}) r(i), range(1, {width + 1}) q(j)),
m as materialized (select 0 g, i, j, case when i = j then 1.0::double else 0.0 end + {lam!r} * coalesce(v, 0) v from c left join dd using (i, j) union all select 0, i, j + {width}, case when i = j then 1.0::double else 0.0 end from c),
{eliminated("m", str(width), "g")},
inv as materialized (select i, j - {width} j, v w from m_x where step = {width} and j > {width})
select sample_idx, (i - 1)::int var_idx, round(sum(v * w), 6) + 0.0 as value from l join inv using (j) group by all"""


def labelled(folds: bool = True, where: str = "true", y: str | None = None) -> str:
    """All 64 elements less the means of the training rows (e0): of five folds of consecutive samples, or of all rows (g -1); with y also f0."""
    groups = "(select distinct fold g from s)" if folds else "(select -1 g)"
    rows = f"""
n as (select count(*) n from embeddings),
s as (select vec_id sample_idx, (vec_id // ceil(n / 5)::bigint)::int fold, label, {y or "0.0"}::double y, list_transform(embedding, lambda v: v::double) x from embeddings, n where {where}),
l as (select sample_idx, unnest(x) v, generate_subscripts(x, 1) j from s),
f0 as materialized (select g, sample_idx, fold, label, fold <> g train, y, y - avg(y) filter (where fold <> g) over (partition by g) f from s, {groups}),
e0 as materialized (select g, sample_idx, train, j, v - avg(v) filter (where train) over (partition by g, j) v from f0 join l using (sample_idx))"""
    return rows


def dominant(name: str, source: str, squarings: int = 16) -> str:
    """{name}_w: the first eigenvector of each symmetric matrix of ``source`` (g, i, j, v), from a column of its 2 ** squarings-th power and one step more."""
    scaled = lambda table: f"(select g, i, j, v / sum(v) filter (where i = j) over (partition by g) v from {table})"
    out = [f"{name}_0 as materialized {scaled(source)}"]
    for k in range(1, squarings + 1):
        out.append(f"{name}_{k} as materialized {scaled(f'(select p.g, p.i, q.j, sum(p.v * q.v) v from {name}_{k - 1} p join {name}_{k - 1} q on p.g = q.g and p.j = q.i group by all)')}")
    out.append(f"{name}_c as (select g, arg_max(j, v) j from {name}_{squarings} where i = j group by g)")
    out.append(f"{name}_r as (select p.g, p.i, sum(p.v * q.v) u from {source} p join (select g, i, v from {name}_{squarings} join {name}_c using (g, j)) q on p.g = q.g and p.j = q.i group by all)")
    out.append(f"{name}_w as materialized (select g, i j, u / sqrt(sum(u * u) over (partition by g)) w from {name}_r)")
    return ",\n".join(out)


def pca(components: int) -> str:
    """t{a} (g, sample_idx, t) and v{a} (g, l: the sum of squares of the training rows' scores) of each component."""
    out = ["c1 as materialized (select p.g, p.j i, q.j j, sum(p.v * q.v) v from e0 p join e0 q using (g, sample_idx) where p.train group by all)"]
    for a in range(1, components + 1):
        out.append(dominant(f"d{a}", f"c{a}"))
        out.append(f"v{a} as materialized (select m.g, sum(m.v * p.w * q.w) l from c{a} m join d{a}_w p on m.g = p.g and m.i = p.j join d{a}_w q on m.g = q.g and m.j = q.j group by 1)")
        out.append(f"t{a} as materialized (select e0.g, sample_idx, sum(v * w) t from e0 join d{a}_w using (g, j) group by all)")
        if a < components:
            out.append(f"c{a + 1} as materialized (select m.g, m.i, m.j, m.v - l * p.w * q.w v from c{a} m join v{a} using (g) join d{a}_w p on m.g = p.g and m.i = p.j join d{a}_w q on m.g = q.g and m.j = q.j)")
    return ",\n".join(out)


def pca_distances(components: int) -> str:
    of = range(1, components + 1)
    t2, t = " + ".join(f"any_value(t{a}.t * t{a}.t / (v{a}.l / (n - 1)))" for a in of), " + ".join(f"any_value(t{a}.t * t{a}.t)" for a in of)
    joins = " ".join(f"join t{a} using (g, sample_idx) join v{a} using (g)" for a in of)
    return f"with {labelled(False)},\n{pca(components)}\nselect sample_idx, round({t2}, 6) t2, round(sum(v * v) - ({t}), 6) spe from e0 {joins}, n group by sample_idx"


def whole_leverage(components: int) -> str:
    of = range(1, components + 1)
    joins = " ".join(f"join t{a} using (g, sample_idx) join v{a} using (g)" for a in of)
    return f"with {labelled(False)},\n{pca(components)}\nselect sample_idx, round(1.0 / n + {' + '.join(f't{a}.t * t{a}.t / v{a}.l' for a in of)}, 8) leverage from f0 {joins}, n"


def pcr_curve(components: int, digits: int = 6) -> str:
    steps = [f"f{a} as materialized (select g, sample_idx, fold, train, y, f - t * sum(t * f) filter (where train) over (partition by g) / sum(t * t) filter (where train) over (partition by g) f from f{a - 1} join t{a} using (g, sample_idx))" for a in range(1, components + 1)]
    rows = " union all ".join(f"select {a} a, y, f from f{a} where not train" for a in range(1, components + 1))
    return f"with {centred()},\n{pca(components)},\n{', '.join(steps)}\n{_curve(rows, digits)}"


def _scores(components: int) -> str:
    """z: rows of g, sample_idx, a, t with their fold, label and whether they train."""
    return "z as materialized (" + " union all ".join(f"select g, sample_idx, fold, label, train, {a} a, t from f0 join t{a} using (g, sample_idx)" for a in range(1, components + 1)) + ")"


def discriminant(components: int, quadratic: bool = False) -> str:
    """h: sample_idx, fold, observed, predicted of held-out rows."""
    key = "g, label" if quadratic else "g"
    scatter = "select g, label, i, j, sum(u * w) v, any_value(n) n from (select p.g, p.label, p.a i, q.a j, p.t - avg(p.t) over (partition by p.g, p.label, p.a, q.a) u, q.t - avg(q.t) over (partition by p.g, p.label, p.a, q.a) w, count(*) over (partition by p.g, p.label, p.a, q.a) n from z p join z q using (g, sample_idx) where p.train) group by all"
    form = "select g, label, i, j, v / (n - 1) v from k" if quadratic else "select g, i, j, sum(v) / (sum(n) - count(*)) v from k group by g, i, j"
    constant = "(select g, label, -0.5 * sum(ln(v)) c from m_x where step = i - 1 and i = j group by all)" if quadratic else "(select distinct g, label, 0.0 c from k)"
    return f"""with recursive {labelled()},
{pca(components)},
{_scores(components)},
k as materialized ({scatter}),
q as ({form}),
m as materialized (select {key}, i, j, v from q union all select distinct {key}, i, {components} + i j, 1.0 from q union all select distinct q.{key.replace(", ", ", q.")}, q.i, {components} + o.j, 0.0 from q join (select distinct j from q) o on o.j <> q.i),
{eliminated("m", str(components), key)},
inv as materialized (select {key}, i, j - {components} j, v w from m_x where step = {components} and j > {components}),
c as materialized (select g, label, a, avg(t) mean, count(*) size from z where train group by all),
p as (select g, label, ln(any_value(size) / sum(any_value(size)) over (partition by g)) lp from c group by g, label),
r as materialized (select z.g, sample_idx, z.fold, z.label observed, c.label, c.a, t - mean d from z join c on z.g = c.g and z.a = c.a where not z.train),
o as (select x.g, x.sample_idx, x.fold, x.observed, x.label, -0.5 * sum(x.d * w * y.d) f from r x join r y using (g, sample_idx, label) join inv on inv.g = x.g {"and inv.label = x.label " if quadratic else ""}and inv.i = x.a and inv.j = y.a group by all),
h as (select sample_idx, o.fold, observed, arg_min(label, (-(f + lp + c), label)) predicted from o join p using (g, label) join {constant} using (g, label) group by all)"""


def discriminant_rows(components: int, quadratic: bool = False) -> str:
    return discriminant(components, quadratic) + "\nselect sample_idx, fold, observed, predicted from h"


def classifier_numbers(components: int) -> str:
    one = "from (select distinct observed k from h) join h on true group by k"
    own, said = "observed = k", "predicted = k"
    ratios = {
        "n": f"count(*) filter (where {own})", "sensitivity": f"count(*) filter (where {own} and {said}) / nullif(count(*) filter (where {own}), 0)", "specificity": f"count(*) filter (where not ({own}) and not ({said})) / nullif(count(*) filter (where not ({own})), 0)", "precision": f"count(*) filter (where {own} and {said}) / nullif(count(*) filter (where {said}), 0)",
    }
    parts = ["select 'cross_validation' part, 'n' metric, count(*)::double as value from h", "select 'cross_validation', 'accuracy', avg((observed = predicted)::int) from h"]
    parts += [f"select 'class ' || k, '{name}', ({value})::double {one}" for name, value in ratios.items()]
    return discriminant(components) + f", u as ({' union all '.join(parts)}) select part, metric, round(value, 8) as value from u"


def neighbours(components: int, k: int) -> str:
    return f"""with {labelled()},
{pca(components)},
{_scores(components)},
d as (select q.g, q.sample_idx, q.fold, q.label observed, r.sample_idx other, r.label, round(sum((q.t - r.t) * (q.t - r.t)), 12) d from z q join z r using (g, a) where not q.train and r.train group by all),
b as (select *, row_number() over (partition by sample_idx order by d, other) r from d),
v as (select sample_idx, fold, observed, label, count(*) n from b where r <= {k} group by all)
select sample_idx, fold, observed, arg_min(label, (-n, label)) predicted from v group by all"""


def two_classes(components: int) -> str:
    """Partial least squares on 0 and 1, cut at 0.5."""
    last = pls(components).replace("sample_idx, fold, train, y, f - t * q f", "sample_idx, fold, label, train, y, f - t * q f")
    return f"with {labelled(where='label in (0, 1)', y='label')},{last} select sample_idx, fold, label observed, (y - f >= 0.5)::int predicted from f{components} where not train"


def _many(components: int) -> str:
    """b{a}: what is left of the class code (g, sample_idx, k, f), all its columns being taken together."""
    out = ["b0 as materialized (select g, sample_idx, train, k, (label = k)::int - avg((label = k)::int) filter (where train) over (partition by g, k) f from f0, (select distinct label k from f0) o)"]
    for a in range(1, components + 1):
        b = a - 1
        out.append(f"x{a} as materialized (select e{b}.g, j, k, sum(v * f) c from e{b} join b{b} using (g, sample_idx) where e{b}.train group by all)")
        out.append(f"y{a} as materialized (select p.g, p.j i, q.j j, sum(p.c * q.c) v from x{a} p join x{a} q using (g, k) group by all)")
        out.append(dominant(f"d{a}", f"y{a}"))
        out.append(f"r{a} as materialized (select e{b}.g, sample_idx, train, sum(v * w) t from e{b} join d{a}_w using (g, j) group by all)")
        out.append(f"s{a} as materialized (select g, sum(t * t) tt from r{a} where train group by g)")
        out.append(f"p{a} as materialized (select e{b}.g, j, sum(v * t) / any_value(tt) p from e{b} join r{a} using (g, sample_idx) join s{a} using (g) where r{a}.train group by all)")
        out.append(f"q{a} as materialized (select b{b}.g, k, sum(f * t) / any_value(tt) q from b{b} join r{a} using (g, sample_idx) join s{a} using (g) where r{a}.train group by all)")
        out.append(f"e{a} as materialized (select g, sample_idx, e{b}.train, j, v - t * p v from e{b} join r{a} using (g, sample_idx) join p{a} using (g, j))")
        out.append(f"b{a} as materialized (select g, sample_idx, b{b}.train, k, f - t * q f from b{b} join r{a} using (g, sample_idx) join q{a} using (g, k))")
    return ",\n".join(out)


def many_classes(components: int) -> str:
    """The class of largest fitted code of held-out rows."""
    return f"with {labelled()},\n{_many(components)}\nselect sample_idx, fold, label observed, arg_min(k, (-((label = k)::int - b{components}.f), k)) predicted from b{components} join f0 using (g, sample_idx) where not f0.train group by all"


def dummy_rmse(components: int) -> str:
    return f"with {labelled()},\n{_many(components)}\nselect round(sqrt(avg(f * f)), 8) rmse from b{components} where not train"


def many_classes_whole(components: int) -> str:
    """The same of all rows by the fit of all rows."""
    return f"with {labelled(False)},\n{_many(components)}\nselect sample_idx, label observed, arg_min(k, (-((label = k)::int - b{components}.f), k)) predicted from b{components} join f0 using (g, sample_idx) group by all"


def contributions(components: int) -> str:
    """What each variable adds to t2, and its residual."""
    of = range(1, components + 1)
    joins = " ".join(f"join t{a} using (g, sample_idx) join v{a} using (g) join d{a}_w w{a} using (g, j)" for a in of)
    back = " + ".join(f"t{a}.t * w{a}.w" for a in of)
    t2 = " + ".join(f"t{a}.t / (v{a}.l / (n - 1)) * w{a}.w" for a in of)
    return f"with {labelled(False)},\n{pca(components)}, r as (select sample_idx, (j - 1)::int var_idx, v * ({t2}) a, v - ({back}) e from e0 {joins}, n) select sample_idx, var_idx, round(a, 6) + 0.0 t2_part, round(e, 6) + 0.0 residual, round(e * e, 6) residual2 from r"
