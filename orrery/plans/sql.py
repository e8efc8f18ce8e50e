"""DuckDB SQL of the core queries, written apart from the operators."""

from __future__ import annotations

from orrery.plans.queries import K, PERMUTATION, RADIUS_COSINE, RADIUS_L2

X = """x as (select vec_id as id, 'k' || vec_id as key, label, list_transform(embedding::double[], lambda e: e * (1 + vec_id % 7)) as v from embeddings)"""
Y = X + """,
y as (select id, list_transform(list_reverse(list_transform(v, lambda e: e / (1 + id % 7))[1:48]), lambda e: e * (1 + id % 3) + 0.1::double * label) as v from x)"""
PAIR = Y + """,
pair as (select x.id, x.label, x.v[1:48] as x, y.v as y, x.v as whole from x join y using (id))"""


def num(e: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + 0.0"


def long(source: str, with_: str = X, id_: str = "id") -> str:
    """(id, i, x) of a CTE (id, v)."""
    return f"with {with_} select {id_} as id, i::int as i, {num('v[i + 1]')} as x from (select *, unnest(range(0, len(v))) as i from {source})"


UNIT = ", u as (select id, key, label, list_transform(v, lambda e: e / greatest(sqrt(list_inner_product(v, v)), 1e-12::double)) as v from x)"
L2 = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
L1 = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))"
LINF = "list_max(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))"
DOT = "list_inner_product(a.v, b.v)"


def knn(distance: str, order: str, queries: str = "x", rows: str = "x", with_: str = X, out: str = "nbr") -> str:
    return f"""with {with_},
d as (select a.id as query_id, b.id as nbr, b.key as nbr_key, {num(distance)} as distance from {queries} a, {rows} b where a.id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by distance {order}, nbr) as n from d)
select query_id, (n - 1)::int as rank, {out}, distance from r where n <= {K}"""


def within(distance: str, keep: str, rows: str = "x", with_: str = X, out: str = "b.id as nbr") -> str:
    return f"with {with_} select a.id as query_id, {out}, {num(distance)} as distance from {rows} a, {rows} b where a.id % 100 = 0 and {distance} {keep}"


STATS = X + """,
e as (select id, i, v[i + 1] as x from (select id, v, unnest(range(0, len(v))) as i from x)),
s as (select i, avg(x) as mean, case when stddev_samp(x) < 10 * 2.220446049250313e-16::double then 1 else stddev_samp(x) end as sd from e group by i)"""


def stats(e: str) -> str:
    return f"with {STATS} select id, e.i::int as i, {num(e)} as x from e join s using (i)"


def norms(p: int) -> str:
    inner = {1: "list_sum(list_transform(v, lambda e: abs(e)))", 2: "sqrt(list_inner_product(v, v))"}.get(p, f"pow(list_sum(list_transform(v, lambda e: pow(abs(e), {p}))), 1.0::double / {p})")
    return long("(select id, list_transform(v, lambda e: e / n) as v from (select id, v, " + f"greatest({inner}, 1e-12::double) as n from x))")


def anchors(relation: str, rows: str = "x", with_: str = X) -> str:
    return f"with {with_} select a.id, b.id::int as i, {num(relation)} as x from {rows} a, {rows} b where b.id < 10"


def perm(source: list[int]) -> str:
    return long(f"(select id, list_transform({source}, lambda j: v[j + 1]) as v from x)")


COSINE = "(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))))"
_INVERSE = sorted(range(64), key=lambda i: PERMUTATION[i])

#: 2-D orthogonal map that brings x closest to y, in closed form.
PROCRUSTES = PAIR + """,
m as (select sum(x[1] * y[1]) as a, sum(x[1] * y[2]) as b, sum(x[2] * y[1]) as c, sum(x[2] * y[2]) as d from pair),
t as (select a * d - b * c >= 0 as turn, case when a * d - b * c >= 0 then atan2(b - c, a + d) else atan2(b + c, a - d) end as w from m),
r as (select cos(w) as r00, sin(w) as r01, case when turn then -sin(w) else sin(w) end as r10, case when turn then cos(w) else -cos(w) end as r11 from t)"""

LSTSQ = PAIR + """,
g as (select sum(x[1] * x[1]) as p, sum(x[1] * x[2]) as q, sum(x[2] * x[2]) as r, sum(x[1] * y[1]) as a, sum(x[1] * y[2]) as b, sum(x[2] * y[1]) as c, sum(x[2] * y[2]) as d from pair),
w as (select (r * a - q * c) / (p * r - q * q) as w00, (r * b - q * d) / (p * r - q * q) as w01, (p * c - q * a) / (p * r - q * q) as w10, (p * d - q * b) / (p * r - q * q) as w11 from g)"""


def four(names: tuple[str, ...], source: str, with_: str) -> str:
    return f"with {with_} select i::int as i, j::int as j, {num('v')} as value from (" + " union all ".join(f"select {k // 2} as i, {k % 2} as j, {n} as v from {source}" for k, n in enumerate(names)) + ")"


def one(e: str, with_: str = PAIR, source: str = "pair", digits: int = 6) -> str:
    return f"with {with_} select {num(e, digits)} as value from {source}"


_ROW = {
    "l2": "avg(list_distance(x, y))",
    "l1": "avg(list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))))",
    "cosine": "avg(list_inner_product(x, y) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y))))",
    "mse": "sum(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / sum(len(x))",
    "l1_loss": "sum(list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2])))) / sum(len(x))",
    "trace": "sum(list_inner_product(x, y))",
}

CKA_LINEAR = PAIR + """,
ex as (select id, i, whole[i + 1] - avg(whole[i + 1]) over (partition by i) as v from (select id, whole, unnest(range(0, 64)) as i from pair)),
ey as (select id, i, y[i + 1] - avg(y[i + 1]) over (partition by i) as v from (select id, y, unnest(range(0, 48)) as i from pair)),
xy as (select sum(s * s) as h from (select sum(a.v * b.v) as s from ex a join ey b using (id) group by a.i, b.i)),
xx as (select sum(s * s) as h from (select sum(a.v * b.v) as s from ex a join ex b using (id) group by a.i, b.i)),
yy as (select sum(s * s) as h from (select sum(a.v * b.v) as s from ey a join ey b using (id) group by a.i, b.i))"""


def cka_rbf(sigma: str | None) -> str:
    sx = sigma or "(select quantile_disc(dx, 0.5) from d where dx <> 0)"
    sy = sigma or "(select quantile_disc(dy, 0.5) from d where dy <> 0)"
    d = lambda c: f"list_sum(list_transform(list_zip(a.{c}, b.{c}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"""with {PAIR},
d as (select a.id as i, {d('whole')} as dx, {d('y')} as dy from pair a, pair b),
s as (select {sx} as sx, {sy} as sy),
k as (select i, exp(-dx / (2 * sx)) as k, exp(-dy / (2 * sy)) as l from d, s),
r as (select i, sum(k) as sk, sum(l) as sl, sum(k * l) as kl, sum(k * k) as kk, sum(l * l) as ll from k group by i),
t as (select count(*) as n, sum(kl) - 2 * sum(sk * sl) / count(*) + sum(sk) * sum(sl) / (count(*) * count(*)) as xy,
  sum(kk) - 2 * sum(sk * sk) / count(*) + sum(sk) * sum(sk) / (count(*) * count(*)) as xx,
  sum(ll) - 2 * sum(sl * sl) / count(*) + sum(sl) * sum(sl) / (count(*) * count(*)) as yy from r)
select {num('xy / (sqrt(xx) * sqrt(yy))')} as value from t"""


RECORDS = """records as (
  select sample_id as id, lower(trim(split)) as split, title, x as content, y as label, source from (
    select *, row_number() over (partition by sample_id order by ingested_at nulls first, split nulls first, title nulls first, x nulls first, y nulls first) as n from samples)
  where n = 1)"""
_HASH = "md5('42:' || id)"
SUBSET = RECORDS + f""",
ranked as (select *, row_number() over (partition by split order by {_HASH}, id) as n, count(*) over (partition by split) as total from records)"""

CATALOG = "catalog as (select space_id as item_id, properties_json as properties, dim, n_rows from spaces)"
_PROP = "json_extract_string(properties, '$.{}')"
BENCHMARK = CATALOG + f""",
items as (select *, {_PROP.format('dataset')} as dataset from catalog),
names as (select distinct dataset from items where dataset is not null),
splits as (select unnest(['train', 'test']) as split),
corr as (
  select sha256('{{"quality": 0, "split": "' || split || '", "x_dataset": "' || a.dataset || '", "y_dataset": "' || b.dataset || '"}}') as item_id, split, a.dataset as x, b.dataset as y
  from names a, names b, splits),
held as (select item_id, dataset from items where n_rows > 0 and dataset is not null),
fit as (select c.item_id as fit_correspondence, a.item_id as fit_x_space, b.item_id as fit_y_space from corr c join held a on a.dataset = c.x join held b on b.dataset = c.y where split = 'train'),
tests as (
  select case split when 'train' then 0 else 1 end as test, c.item_id as test_correspondence, a.item_id as test_x_space, b.item_id as test_y_space
  from corr c join held a on a.dataset = c.x join held b on b.dataset = c.y),
grid as (
  select fit.*, test_correspondence, test_x_space, test_y_space, estimator, test::int as test, m.metric, m.metric_type
  from fit, tests, (select unnest(['svd', 'lstsq']) as estimator), (values ('l2', 'latent'), ('cosine', 'latent'), ('accuracy', 'downstream')) m(metric, metric_type))"""

TOKENS = X + """,
tok as (select id, t, v[t * 8 + 1:t * 8 + 8] as v, (t + id) % 3 <> 0 as mask from (select id, v, unnest(range(0, 8)) as t from x)),
el as (select id, t, i, v[i + 1] as x from (select id, t, v, unnest(range(0, 8)) as i from tok where mask))"""

ORACLES: dict[str, str] = {
    "knn_l2": knn(L2, "asc"),
    "knn_sql_plan": knn(L2, "asc"),
    "knn_cosine": knn(DOT, "desc", "u", "u", X + UNIT),
    "knn_inner_product": knn(DOT, "desc"),
    "knn_l1": knn(L1, "asc"),
    "knn_linf": knn(LINF, "asc"),
    "knn_by_key": knn(L2, "asc", out="nbr_key"),
    "knn_cosine_untransformed_query": knn(DOT, "desc", "x", "u", X + UNIT),
    "knn_cosine_transformed_query": knn(DOT, "desc", "u", "u", X + UNIT),
    "range_l2": within(L2, f"< {RADIUS_L2}"),
    "range_cosine": within(DOT, f"> {RADIUS_COSINE}", "u", X + UNIT),
    "range_by_key": within(L2, f"< {RADIUS_L2}", out="b.key as nbr_key"),
    "get_vectors_by_offset": long("(select * from u where id % 100 = 0)", X + UNIT),
    "get_vectors_by_key": long("(select * from x where id % 100 = 0)"),
    "contains_keys": "select 'k' || vec_id * 2 as key, vec_id * 2 in (select vec_id from embeddings) as held from embeddings",
    "index_append_offsets": f"with {X}, n as (select max(id) + 1 as n from x), b as (select id, key, v from x union all select n + row_number() over (order by id) - 1, 'new' || id, v from x, n) select id::bigint as id, key, {num('v[1]')} as first from b",
    "space_append": f"with {X}, n as (select max(id) + 1 as n from x), b as (select id, key, v from x union all select n + row_number() over (order by id) - 1, 'new' || id, v from x, n) select id::bigint as id, key, {num('sqrt(list_inner_product(v, v))')} as norm from b",
    "space_slice": long("(select * from x where id >= 10 and id < 400 and (id - 10) % 3 = 0)"),
    "space_introspection": f"with {X} select count(*) as n, min(len(v))::int as dim, count(distinct key) as keys from x",
    "centering": stats("x - mean"),
    "centering_inverse": stats("x + mean"),
    "std_scaling": stats("x / sd"),
    "std_scaling_inverse": stats("x * sd"),
    "standard_scaling": stats("(x - mean) / sd"),
    "standard_scaling_inverse": stats("x * sd + mean"),
    "std_handle_zeros": f"with {STATS} select id, e.i::int as i, {num('case when e.i = 0 then 3.0::double else x / sd end')} as x from e join s using (i)",
    **{f"{n}_roundtrip": long("x") for n in ("centering", "std_scaling", "standard_scaling", "random_isometry", "random_permutation", "sequence")},
    **{f"lp_norm_p{p}": norms(p) for p in (1, 2, 3)},
    "mean_lp_norm": norms(2),
    "mean_lp_norm_inverse": f"with {STATS}, m as (select avg(sqrt(list_inner_product(v, v))) as m from x) select id, i::int as i, {num('x * m')} as x from e, m",
    "isotropic_scaling": long("(select id, list_transform(v, lambda e: e * 2.5::double) as v from x)"),
    "isotropic_scaling_inverse": long("(select id, list_transform(v, lambda e: e * (1 / 2.5::double)) as v from x)"),
    "dim_permutation": perm(PERMUTATION),
    "dim_permutation_inverse": perm(_INVERSE),
    "isometry_apply": long("(select id, list_concat([(v[1] - v[2]) * sqrt(0.5::double), (v[1] + v[2]) * sqrt(0.5::double)], v[3:]) as v from x)"),
    "isometry_inverse": long("(select id, list_concat([(v[1] + v[2]) * sqrt(0.5::double), (v[2] - v[1]) * sqrt(0.5::double)], v[3:]) as v from x)"),
    "rel_cosine": anchors(COSINE),
    "rel_angular": anchors(f"acos(least(greatest({COSINE}, -1), 1)) / pi()"),
    "rel_l1": anchors(L1),
    "rel_euclidean": anchors(f"sqrt({L2})"),
    "rel_lp10": anchors("pow(list_sum(list_transform(list_zip(a.v, b.v), lambda z: pow(abs(z[1] - z[2]), 10))), 0.1::double)"),
    "rel_cob_2anchors": f"""with {X},
a as (select (select v from x where id = 0) as a0, (select v from x where id = 1) as a1),
g as (select id, list_inner_product(a0, a0) as p, list_inner_product(a0, a1) as q, list_inner_product(a1, a1) as r, list_inner_product(v, a0) as b0, list_inner_product(v, a1) as b1 from x, a)
select id, i::int as i, {num('case i when 0 then (r * b0 - q * b1) / (p * r - q * q) else (p * b1 - q * b0) / (p * r - q * q) end')} as x from g, range(0, 2) t(i)""",
    "rel_pipeline_centered_cosine": anchors(COSINE, "c", X + """,
mean as (select list(m order by i) as m from (select i, avg(v[i + 1]) as m from (select v, unnest(range(0, 64)) as i from x where id < 10) group by i)),
c as (select id, list_transform(list_zip(v, m), lambda z: z[1] - z[2]) as v from x, mean)"""),
    "zero_padding": long("(select id, list_concat(v, list_transform(range(0, 16), lambda i: 0::double)) as v from y)", Y),
    "zero_padding_inverse": long("y", Y),
    "procrustes_2d": four(("r00", "r01", "r10", "r11"), "r", PROCRUSTES),
    "lstsq_2d": four(("w00", "w01", "w10", "w11"), "w", LSTSQ),
    "translate_2d": f"with {PROCRUSTES} select id, i::int as i, {num('case i when 0 then x[1] * r00 + x[2] * r10 else x[1] * r01 + x[2] * r11 end')} as x from pair, r, range(0, 2) t(i)",
    "certify_procrustes_orthogonal": "select a.i::int as i, b.i::int as j, case when a.i = b.i then 1.0::double else 0.0::double end as value from range(0, 48) a(i), range(0, 48) b(i)",
    "certify_lstsq_normal_eq": "select a.i::int as i, b.i::int as j, 0.0::double as value from range(0, 64) a(i), range(0, 48) b(i)",
    **{f"metric_{m}": one(e) for m, e in _ROW.items()},
    "compare_many": f"with {PAIR} select 0::int as other, {num(_ROW['l2'])} as l2, {num(_ROW['cosine'])} as cosine from pair union all select 1::int, {num('avg(list_distance(x, x))')}, {num('avg(list_inner_product(x, x) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(x, x))))')} from pair",
    "cka_linear": f"with {CKA_LINEAR} select {num('xy.h / (sqrt(xx.h) * sqrt(yy.h))')} as value from xy, xx, yy",
    "cka_rbf": cka_rbf(None),
    "cka_rbf_sigma": cka_rbf("9.0::double"),
    "svcca_1d": f"""with {PAIR}, c as (select var_samp(x[1]) as vx, var_samp(y[1]) as vy, covar_samp(x[1], y[1]) as c from pair), m as (select *, vx + 1e-6::double as mx, vy + 1e-6::double as my from c)
select {num('abs(c) / sqrt(mx * my) / sqrt((vx / mx + 1e-6::double) * (vy / my + 1e-6::double))')} as value from m""",
    "accuracy_argmax": f"with {X} select {num('avg((list_position(v[1:10], list_max(v[1:10])) - 1 = label)::int)')} as value from x",
    "label_counts": "select label, count(*) as n from embeddings group by label",
    "uniform_sample": "select vec_id as id, 'k' || vec_id as key from embeddings order by md5('42:' || vec_id), vec_id limit 50",
    "uniform_sample_paired": f"with {PAIR} select id, {num('x[1]')} as x, {num('y[1]')} as y from pair order by {_HASH}, id limit 50",
    "stratified_sample": f"with {X} select id, label from x qualify row_number() over (partition by label order by {_HASH}, id) <= 5",
    "dataset_subset": f"with {SUBSET} select id, split, n - 1 as sample_id from ranked where n <= floor(total * 0.25::double)",
    "train_val_split": f"with {RECORDS} select id, case when row_number() over (order by {_HASH}, id) <= ceil(count(*) over () * 0.1::double) then 'val' else 'train' end as part from records",
    "correspondence_gather": f"with {Y} select b.id, {num('x.v[1]')} as x, {num('y.v[1]')} as y from x b join x on x.id = (b.id * 3) % 100 join y on y.id = b.id % 77",
    "identity_correspondence": f"with {PAIR} select id, {num('sqrt(list_inner_product(whole, whole))')} as x, {num('sqrt(list_inner_product(y, y))')} as y from pair",
    "correspondence_noise": "select count(*) as pairs, count(*) as xs, count(*) as ys, floor(count(*) * 0.1::double)::bigint as moved from embeddings",
    "dataset_view_join": f"with {PAIR} select d.doc_id as sample_id, d.source, d.n_chars, {num('sqrt(list_inner_product(whole, whole))')} as x, {num('sqrt(list_inner_product(y, y))')} as y from pair join documents d on d.doc_id = pair.id",
    "catalog_ids": "select space_id as item_id, sha256(properties_json) = space_id as ok from spaces",
    "catalog_prefix_lookup": "select space_id as item_id, dim from spaces where starts_with(space_id, (select min(space_id) from spaces)[1])",
    "catalog_property_filter": f"with {CATALOG} select item_id, n_rows from catalog where {_PROP.format('dataset')} = 'dbpedia_like' and {_PROP.format('pool')} = 'mean'",
    "catalog_absent_property": f"with {CATALOG} select item_id from catalog where {_PROP.format('pool')} is null",
    "catalog_add_conflicts": "select distinct space_id as item_id from spaces where space_id in (select sha256(properties_json) from spaces) or space_id in (select sha256(replace(properties_json, '\"revision\": 0', '\"revision\": 9')) from spaces)",
    "catalog_properties": f"with {CATALOG} select item_id, {', '.join(_PROP.format(p) + ' as ' + p for p in ('dataset', 'encoder', 'layer', 'pool'))} from catalog",
    "correspondence_grid_rows": "select x_dataset, y_dataset, q / 10::double as quality, split from (select unnest(['trec', 'imdb']) as x_dataset), (select unnest(['trec', 'imdb', 'amazon']) as y_dataset), range(0, 10) r(q), (select unnest(['train', 'test']) as split)",
    "resolve_benchmark": f"with {BENCHMARK} select * from grid",
    "experiments_summary": f"with {BENCHMARK} select count(*) as experiments, " + ", ".join(f"count(distinct {c}) as {c}s" for c in ("fit_correspondence", "fit_x_space", "fit_y_space", "test_correspondence", "test_x_space", "test_y_space", "estimator")) + ", count(distinct metric || metric_type) as metrics from grid",
    "experiment_export": f"with {CATALOG} select {', '.join(_PROP.format(p) + ' as ' + p for p in ('dataset', 'encoder', 'layer'))}, n_rows as score from catalog",
    "pool_token": f"with {TOKENS} select id, (dense_rank() over (partition by id order by t) - 1)::int as token, i::int as i, {num('x')} as x from el",
    "pool_mean": f"with {TOKENS} select id, i::int as i, {num('avg(x)')} as x from el group by 1, 2",
    "pool_sum": f"with {TOKENS} select id, i::int as i, {num('sum(x)')} as x from el group by 1, 2",
    "pool_cls": long("(select id, v[1:8] as v from x)"),
    "map_features": f"with {RECORDS} select id, content as text, label as target, content from records",
    "dbpedia_text": f"with {RECORDS} select id, title || '. ' || regexp_replace(trim(content, '\"'), '^\\s+|\\s+$', '', 'g') as x, label as y from records",
    "feature_select": f"with {SUBSET} select n - 1 as sample_id, split, title || '. ' || regexp_replace(trim(content, '\"'), '^\\s+|\\s+$', '', 'g') as x, label as y from ranked where n <= floor(total * 0.5::double)",
    "class_names": f"with {RECORDS} select (row_number() over (order by label) - 1)::int as i, label as name from (select distinct label::varchar as label from records where split = 'train' and label is not null)",
}

from orrery.plans.stored_sql import ORACLES as _STORED  # noqa: E402

ORACLES |= _STORED
