"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

_POOL = """
pool as (
  select sample_id, y from (
    select sample_id, lower(trim(split)) as split, y, row_number() over (partition by sample_id order by (ingested_at is null), ingested_at, y) as n
    from samples where sample_id is not null)
  where n = 1 and split = 'train' and y between 0 and 13),
counts as (select y, count(*) as available from pool group by y),
asked as (
  select t.target_id, t.y, t.target_share, t.pool_frac, t.min_rows, coalesce(c.available, 0) as available, (select count(*) from pool) as pool_rows
  from sample_targets t left join counts c using (y))"""

_SEATS = f"""
with {_POOL},
ranked as (select sample_id, y, row_number() over (partition by y order by md5('17:' || sample_id), sample_id) as rank_no from pool),
seats as (
  select a.target_id, r.sample_id, r.y, r.rank_no, a.pool_frac, a.pool_rows,
    row_number() over (partition by a.target_id order by (case when r.rank_no <= a.min_rows then 0 else 1 end), (r.rank_no - 0.5::double) / a.target_share, r.y) as place,
    r.rank_no <= a.min_rows as floor_row
  from asked a join ranked r on a.y = r.y where a.target_share > 0 or r.rank_no <= a.min_rows),
kept as (select target_id, sample_id, y, rank_no from seats where place <= floor(pool_frac * pool_rows + 1e-9) or floor_row)"""

ORACLES = {
    "p5_found": f"with {_POOL} select target_id, y::bigint as y from asked where available < greatest(min_rows, target_share * pool_frac * pool_rows)",
    "p5_sample": f"{_SEATS} select target_id, sample_id, y, rank_no from kept",
    "p5_report": f"""{_SEATS}, got as (select target_id, y, count(*) as seats from kept group by 1, 2)
select a.target_id, a.y, a.min_rows, a.available, coalesce(g.seats, 0) as seats, a.available < greatest(a.min_rows, a.target_share * a.pool_frac * a.pool_rows) as short
from asked a left join got g on a.target_id = g.target_id and a.y = g.y""",
    "p7_found": """
with item_words as (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from eval_items),
grams as (select distinct item_id, array_to_string(w[i:i + 12], ' ') as gram from (select item_id, w, unnest(range(1, len(w) - 11)) as i from item_words)),
doc_words as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents),
windows as (select doc_id, array_to_string(w[i:i + 12], ' ') as gram from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from doc_words))
select distinct doc_id, item_id from windows join grams using (gram)""",
}

ORACLES["p1_varied_subset"] = """
with rows_ as (
  select v.vec_id, v.space_id, v.sample_id, s.dim, s.n_subset as k, v.vector as u
  from (select * from space_vectors qualify row_number() over (partition by vec_id order by added_at) = 1) v join spaces s using (space_id)
  where v.vector is not null and len(v.vector) = s.dim and s.n_subset > 0
    and not list_contains(list_transform(v.vector, lambda x: isnan(x)), true) and list_max(list_transform(v.vector, lambda x: abs(x))) > 0),
coords as (select space_id, vec_id, dim, unnest(range(0, dim::bigint)) as i, unnest(u) as x from rows_),
halves as (select * from (values (0, 0, 2), (1, 2, 4), (2, 1, 3)) h(j, low, high)),
strongest as (
  select space_id, vec_id, dim, j, i, (x > 0)::int as positive from coords join halves on i >= dim * low // 4 and i < dim * high // 4
  qualify row_number() over (partition by vec_id, j order by abs(x) desc, x desc, i) = 1),
bins as (select space_id, vec_id, g, j, (g * 3 + j) * 2 * dim + 2 * (i >> (5 - g)) + positive as bin from strongest, range(0, 6) r(g)),
counted as (select *, count(*) over (partition by space_id, bin) as n from bins),
cells as (select space_id, vec_id, g, arg_max(bin, n * 1000000 - bin) as cell from counted group by all),
grids as (select space_id, max(g) as g from (select space_id, g, count(distinct cell) as occupied from cells group by all) join spaces using (space_id) where occupied <= 1.5 * n_subset group by 1),
placed as (select r.space_id, r.vec_id, r.sample_id, r.k, coalesce(c.cell, -1)::varchar as cell from rows_ r left join grids using (space_id) left join cells c on c.vec_id = r.vec_id and c.g = grids.g),
ranked as (select *, row_number() over (partition by space_id, cell order by md5(vec_id::varchar), vec_id) as rank_no from placed),
turns as (select *, row_number() over (partition by space_id order by rank_no, md5(cell), cell) as turn from ranked)
select space_id, vec_id, sample_id, cell, rank_no from turns where turn <= k"""

_LINKS = """
sets as (
  select sample_id, list_distinct(regexp_extract_all(lower(x), '[a-z0-9]+')) as ws from (select sample_id, any_value(x) as x from samples where x is not null group by 1)),
long_sets as (select sample_id, ws, len(ws) as n from sets where len(ws) >= 8),
held as (select sample_id, n, unnest(ws) as word from long_sets),
df as (select word, count(*) as df from held group by 1),
ordered as (select h.sample_id, h.n, h.word, row_number() over (partition by h.sample_id order by d.df, h.word) as k from held h join df d using (word)),
prefix as (select sample_id, n, word from ordered where k <= n - ceil(0.8::double * n - 1e-9) + 1),
pairs as (select distinct a.sample_id as a, b.sample_id as b from prefix a join prefix b on a.word = b.word and a.sample_id < b.sample_id and b.n >= 0.8::double * a.n - 1e-9 and a.n >= 0.8::double * b.n - 1e-9),
sizes as (select p.a, p.b, len(list_intersect(x.ws, y.ws)) as c, x.n as na, y.n as nb from pairs p join long_sets x on x.sample_id = p.a join long_sets y on y.sample_id = p.b),
links as (select a, b from sizes where c >= 0.8::double * (na + nb - c) - 1e-9)"""

ORACLES["p3_found"] = f"""
with {_LINKS},
sides as (select distinct sample_id, lower(trim(split)) = 'train' as train from samples where lower(trim(split)) in ('train', 'val', 'test'))
select distinct l.a as sample_id_a, l.b as sample_id_b from links l join sides x on x.sample_id = l.a join sides y on y.sample_id = l.b where x.train <> y.train"""

ORACLES["p4_found"] = f"""
with recursive {_LINKS},
both_ways as (select a, b from links union select b, a from links),
reach(node, seen) as (select a, a from both_ways union select r.node, e.b from reach r join both_ways e on e.a = r.seen)
select min(seen) as group_id, node as sample_id from reach group by node"""

_VALID = """
valid as (
  select v.vec_id, v.space_id, v.vec_offset, v.label, v.vector::double[] as v
  from (select * from space_vectors where vec_id is not null qualify row_number() over (partition by vec_id order by added_at nulls first) = 1) v join spaces s using (space_id)
  where v.vector is not null and len(v.vector) = s.dim and not list_contains(list_transform(v.vector, lambda x: isnan(x)), true) and list_max(list_transform(v.vector, lambda x: abs(x))) > 0)"""

_SCORE = """case {m} when 'cosine' then round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 9)
    when 'l2' then round(-list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) else round(list_inner_product(a.v, b.v), 9) end"""

ORACLES["p6_found"] = f"""
with {_VALID},
scored as (
  select q.query_id, b.vec_id, q.k, {_SCORE.format(m='q.metric')} as score
  from search_queries q join valid a on a.vec_id = q.vec_id and a.space_id = q.space_id join valid b on b.space_id = a.space_id and b.vec_id <> a.vec_id),
ranked as (select query_id, vec_id, k, row_number() over (partition by query_id order by score desc, vec_id) as n from scored)
select query_id, vec_id from ranked where n <= k"""

ORACLES["p6_missed"] = ORACLES["p6_found"].replace("select query_id, vec_id from ranked where n <= k", """, truth as (select r.query_id, r.vec_id, v.vec_offset from ranked r join valid v using (vec_id) where n <= k),
had as (select distinct query_id, nbr_offset from search_results)
select t.query_id, t.vec_id from truth t left join had h on h.query_id = t.query_id and h.nbr_offset = t.vec_offset where h.query_id is null""")

ORACLES["p2_found"] = f"""
with {_VALID},
u as (select vec_id, space_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as v from valid),
near as (select a.vec_id as a, b.vec_id as b from u a join u b using (space_id) where list_inner_product(a.v, b.v) >= 0.6::double),
l1 as (select a, min(b) as l from near group by a),
l2 as (select n.a, min(l) as l from near n join l1 on l1.a = n.b group by n.a),
l3 as (select n.a, min(l) as l from near n join l2 on l2.a = n.b group by n.a),
l4 as (select n.a, min(l) as l from near n join l3 on l3.a = n.b group by n.a),
parts as (select l, i, sum(v[i + 1]) as s from (select l, v, unnest(range(0, len(v))) as i from u join l4 on l4.a = u.vec_id) group by l, i),
mean as (select l, list(s order by i) as m from parts group by l),
cos as (select m.l, u.vec_id, list_inner_product(u.v, m.m) / sqrt(list_inner_product(m.m, m.m)) as c from mean m join u on u.space_id = (select space_id from u w where w.vec_id = m.l) where list_inner_product(u.v, m.m) / sqrt(list_inner_product(m.m, m.m)) >= 0.5::double),
good as (select l from cos group by l having count(*) >= 5 and min(c) >= 0.75::double)
select distinct min(vec_id) over (partition by l) as cluster_id, vec_id from cos where l in (select l from good)"""

ORACLES["p3_counts"] = ORACLES["p3_found"].replace("sides as (select distinct sample_id, lower(trim(split)) = 'train' as train from samples where", "sides as (select distinct sample_id, lower(trim(split)) = 'train' as train, lower(trim(split)) as split from samples where").replace("select distinct l.a as sample_id_a, l.b as sample_id_b from links", """, src as (select sample_id, min(source) as source from samples group by 1), found as (
select distinct case when x.train then l.b else l.a end as held_id, case when x.train then l.a else l.b end as train_id, case when x.train then y.split else x.split end as split from links""").replace("where x.train <> y.train", """where x.train <> y.train)
select f.split, s.source, count(*) as pairs, count(distinct held_id) as held_records from found f join src s on s.sample_id = f.held_id group by 1, 2""")

#: Tokens are counted as words and signs: any usual tokenizer gives the same rows.
ORACLES["p8_found"] = """
with sizes as (select source, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]|[^A-Za-z0-9\\s]')) as n from documents where source is not null),
per as (select source, sum(n) as n from sizes group by 1)
select m.mix_id, m.source from mix_targets m left join per using (source) where m.max_repeats * coalesce(per.n, 0) < m.weight * m.budget_share * (select sum(n) from per)"""

ORACLES["p9_found"] = """
with w as (select doc_id, md5(substring(text, i::int, 300)) as h from (select doc_id, text, unnest(range(1, len(text) - 298)) as i from documents where len(text) >= 300)),
g as (select h, list(distinct doc_id) as ids from w group by h having count(distinct doc_id) > 1)
select distinct a as doc_id_a, b as doc_id_b from (select a, unnest(ids) as b from (select ids, unnest(ids) as a from g)) where a < b"""

ORACLES["p6_neighbours"] = f"""
with {_VALID},
kinds as (select space_id, coalesce(metric, 'cosine') as metric from spaces),
scored as (
  select a.vec_id as query_id, b.vec_id, b.vec_offset as nbr_offset, q.metric, {_SCORE.format(m='q.metric')} as score
  from valid a join kinds q using (space_id) join valid b on b.space_id = a.space_id and b.vec_id <> a.vec_id where a.vec_id % 100 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from scored)
select query_id, (n - 1)::int as rank_no, nbr_offset, round(case when metric = 'l2' then -score else score end, 6) + 0.0 as distance from ranked where n <= 10"""

_CLUSTERS = ORACLES["p2_found"][: ORACLES["p2_found"].index("select distinct min(vec_id)")]
ORACLES["p2_clusters"] = f"""{_CLUSTERS.rstrip()},
named as (select l, min(vec_id) as cluster_id from cos where l in (select l from good) group by l),
one as (select cluster_id, min(l) as l from named group by cluster_id),
members as (select o.cluster_id, c.vec_id, round(c.c, 6) as c, v.space_id, v.label from one o join cos c using (l) join valid v using (vec_id)),
labels as (select space_id, cluster_id, label, count(*) as n from members group by all),
per as (
  select space_id, cluster_id, sum(n)::bigint as size, count(*) filter (label >= 0) as n_labels, arg_max(label, n * 100000 - label) filter (label >= 0) as main_label, max(n) filter (label >= 0) as most
  from labels group by all),
best as (select cluster_id, list(vec_id order by n) as typical from (select *, row_number() over (partition by cluster_id order by c desc, vec_id) as n from members) where n <= 5 group by 1)
select space_id, cluster_id, size, n_labels, main_label, most / size as main_share, typical from per join best using (cluster_id)"""

ORACLES["p9_shared_amounts"] = """
with w as (select doc_id, i, md5(substring(text, i::int, 300)) as h from (select doc_id, text, unnest(range(1, len(text) - 298)) as i from documents where len(text) >= 300)),
g as (select h from w group by h having count(distinct doc_id) > 1),
s as (select doc_id, i, lag(i) over spot as before, lead(i) over spot as after from w where h in (select h from g) window spot as (partition by doc_id order by i))
select s.doc_id, any_value(len(d.text)) as n_chars, sum(least(300, coalesce(after - i, 300)))::bigint as shared_chars, sum(least(300, coalesce(after - i, 300))) / any_value(len(d.text)) as shared_part,
  count(*) filter (before is null or i > before + 300) as n_spans
from s join documents d on d.doc_id = s.doc_id group by s.doc_id"""
