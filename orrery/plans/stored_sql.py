"""DuckDB SQL of the queries in stored.py, written apart from the operators."""

from __future__ import annotations

from orrery.plans.queries import K
from orrery.plans.sql import BENCHMARK, L2, RECORDS, SUBSET, UNIT, X, _HASH, _PROP, knn, long, num

_NORM = "sqrt(list_inner_product(v, v))"
_STATE0 = "select {i} as i, j::int as j, 0.0 as value from range(0, {n}) r(j)"
_WORDS = "list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda w: length(w) > 0)"
_CODED = f"""{RECORDS},
tok as (select id, unnest(list_filter({_WORDS}, lambda w: length(w) > 1)) as w from records where content is not null),
el as (select id, d, sum(case when substring(md5('0:0:' || w), d::int, 1) < '8' then 1.0::double else -1.0::double end) as s, count(*) as n from tok, range(1, 17) r(d) group by all),
mean as (select id, sum(s / n * (s / n)) as q, sum(s * s) as t from el group by id),
coded as (select r.id, sqrt(coalesce(q, 0)) as mean, sqrt(coalesce(t, 0)) as total from records r left join mean using (id) where content is not null)"""
#: (processed columns, source of the text or image, label columns) over `ranked`.
_HALF = "from ranked where n <= floor(total * 0.5::double)"
_BYTES = "octet_length(encode(coalesce(content, '')))::int as bytes"
_CLASS = "names as (select label, (row_number() over (order by label::varchar) - 1)::int as c from (select distinct label from records where split = 'train' and label is not null))"

_IMDB_SPLIT = f"""{RECORDS}, {_CLASS},
known as (select * exclude (split), case when split = 'val' then 'unsupervised' else split end as split from records),
parts as (
  select id, content, label, case when split = 'train' then case when row_number() over (partition by split order by {_HASH}, id) <= ceil(count(*) over (partition by split) * 0.1::double) then 'val' else 'train' end else split end as split
  from known where split <> 'unsupervised'),
ranked as (select *, row_number() over (partition by split order by {_HASH}, id) as n, count(*) over (partition by split) as total from parts)"""

ORACLES = {
    "bimap_lookup": "with k as (select vec_id, 'k' || vec_id as key from embeddings), w as (select vec_id * 2 as y from embeddings) select w.y, k.key as x, 'x' as side from w left join k on k.vec_id = w.y union all select k.vec_id as y, 'k' || w.y as x, 'y' as side from w left join k on k.key = 'k' || w.y",
    "bimap_grow": "select 'k' || vec_id as key, vec_id % 2 = 0 or vec_id % 4 < 2 as held from embeddings",
    "knn_padded": f"""with {X}, d as (select a.id as query_id, b.id as nbr, {num(L2)} as distance from x a, x b where a.id % 100 = 0 and b.id < 3),
r as (select query_id, nbr, distance, row_number() over (partition by query_id order by distance, nbr) - 1 as rank from d),
p as (select id as query_id, rank from x, range(0, {K}) g(rank) where id % 100 = 0)
select p.query_id, p.rank::int as rank, coalesce(nbr, -1) as nbr, distance from p left join r using (query_id, rank)""",
    "range_l2_ranked": f"with {X}, d as (select a.id as query_id, b.id as nbr, {L2} as distance from x a, x b where a.id % 100 = 0 and {L2} < 9.0::double) select query_id, count(*) as n, (count(*) - 1)::int as last, arg_min(nbr, round(distance, 9) + nbr * 1e-15::double) as nearest from d group by 1",
    "search_result_arrays": f"""with {X}, d as (select a.id as query_id, b.id as nbr, b.key, {num(L2)} as distance from x a, x b where a.id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by distance, nbr) as n from d)
select query_id, string_agg(nbr::varchar, ' ' order by n) as offsets, string_agg(key, ' ' order by n) as keys from r where n <= 3 group by 1""",
    "index_stored": knn("list_inner_product(a.v, b.v)", "desc", queries="u", rows="u", with_=X + UNIT),
    "index_grown_by_rows": "select i as offset, 'a' || i as key, i::double as first from range(0, 5) r(i) union all select 5, 'late', 9.0::double",
    "space_stored": f"with {X} select id, key, {num(_NORM)} as norm, 'x' as name, 'train' as split from x",
    "space_key_tsv": f"with {X} select id, key, {num(_NORM)} as norm from x",
    "space_equality": "select * from (values ('same', true), ('near', true), ('far', false), ('shorter', false)) t(\"case\", equal)",
    "space_sample_transform": long(f"(select id, list_transform(v, lambda e: e / {_NORM}) as v from x order by md5('42:' || id), id limit 50)"),
    "vector_sources": "select unnest(['parquet', 'key_tsv']) as reader",
    "identity_and_inverse": f"with {X}, m as (select avg(v[1]) as m from x) select id, {num('v[1]')} as back, {num('v[1] - m')} as centred, {num('v[1]')} as same from x, m",
    "simple_transform": long("(select id, list_transform(v, lambda e: (e - top) * 2) as v from x, (select max(list_max(v)) as top from x))"),
    "random_isometry_certified": f"with {X} select id, {num(_NORM, 5)} as norm, true as moved from x",
    "random_permutation_certified": "select vec_id as id, true as same_elements, true as moved from embeddings",
    "certify_svd_align": _STATE0.format(i=0, n=3),
    "certify_lstsq_align": _STATE0.format(i=0, n=1),
    "certify_lstsq_ortho_align": _STATE0.format(i=0, n=3),
    "certify_sgd_affine_align": "select true as falls, true as better_than_mean",
    "certify_procrustes": "select vec_id as id, 0.0::double as error from embeddings",
    "unpaired_spaces": "select row_number() over (order by md5('5:' || vec_id), vec_id) - 1 as offset, 'k' || vec_id as key from embeddings",
    "svcca_invariance": "select * from (values ('svcca', 1.0::double), ('cka_linear', 1.0::double)) t(measure, value)",
    "correspondence_stored": "select vec_id as pos, vec_id as x_id, vec_id as y_id from (select vec_id, row_number() over (order by md5('42:' || vec_id), vec_id) as n, count(*) over () as total from embeddings) where n <= total // 2",
    "correspondence_catalog": """select sha256('{"quality": ' || q || ', "split": "' || split || '", "x_dataset": "' || x || '", "y_dataset": "trec"}') as item_id, x as x_dataset, 'trec' as y_dataset, split
from (select unnest(['trec', 'imdb']) as x), (select unnest(['0.0', '0.5']) as q), (select unnest(['train', 'test']) as split)""",
    "catalog_changes": f"select distinct space_id as item_id, {_PROP.format('pool').replace('properties', 'properties_json')} as pool from spaces where (n_rows > 0 or space_id < '5') and coalesce({_PROP.format('pool').replace('properties', 'properties_json')}, '') <> 'mean'",
    "json_stored": """select '{"a": null, "b": [1, 2]}' as text""",
    "benchmark_stored": f"with {BENCHMARK} select count(*) as experiments, " + ", ".join(f"count(distinct {c}) as {c}s" for c in ("fit_correspondence", "fit_x_space", "fit_y_space", "test_correspondence", "test_x_space", "test_y_space", "estimator")) + ", count(distinct metric || metric_type) as metrics from grid",
    "process_trec": f"with {SUBSET} select n - 1 as sample_id, split, content as text, label % 6 as coarse_label, label as fine_label {_HALF}",
    "process_ag_news": f"with {SUBSET}, {_CLASS} select n - 1 as sample_id, split, content as text, c as label from ranked left join names using (label) where n <= floor(total * 0.5::double)",
    "process_imdb": f"with {_IMDB_SPLIT} select n - 1 as sample_id, split, content as text, c as label from ranked left join names using (label) where n <= floor(total * 0.5::double)",
    "process_mnist": f"with {SUBSET} select n - 1 as sample_id, split, {_BYTES}, label {_HALF}",
    "process_fashion_mnist": f"with {SUBSET} select n - 1 as sample_id, split, {_BYTES}, label {_HALF}",
    "process_cifar10": f"with {SUBSET} select n - 1 as sample_id, split, {_BYTES}, label {_HALF}",
    "process_cifar100": f"with {SUBSET} select n - 1 as sample_id, split, {_BYTES}, label % 20 as coarse_label, label as fine_label {_HALF}",
    "dataset_stored": f"with {SUBSET}, half as (select split, title || '. ' || regexp_replace(trim(content, '\"'), '^\\s+|\\s+$', '', 'g') as x {_HALF}) select split, count(*) as n, sum(length(x))::bigint as chars, 'dbpedia_14' as name, 0.5::double as perc, 'en' as language from half group by split",
    "f_beta": f"""with {RECORDS}, r as (select label as t, label + id % 2 as p from records where label is not null), c as (select t as class from r union select p from r),
s as (select class, (select count(*) from r where t = class) as support, (select count(*) from r where p = class) as predicted, (select count(*) from r where p = class and t = class) as hits from c)
select class, support, {num('case when predicted = 0 then 0 else hits / predicted end')} as precision, {num('case when support = 0 then 0 else hits / support end')} as recall, {num('case when 4 * support + predicted = 0 then 0 else 5 * hits / (4 * support + predicted) end')} as f_beta from s""",
    "encode_append": f"with {_CODED} select id, 16 as dim, {num('mean', 4)} as norm from coded",
    "encode_poolers": f"with {_CODED} select 'mean' as pooler, id, 16 as dim, {num('mean', 4)} as norm from coded union all select 'sum', id, 16, {num('total', 4)} from coded",
    "encode_images": "select distinct sample_id as id, 2 as dim, true as in_range from samples",
    "column_model": long("(select id, list_transform(v, lambda e: -e) as v from x)"),
}
