"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontamination, fingerprints, interpolation, jaccard, mixing, passages, quality, sharding, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_partition_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op8_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score(table(spark, sf_dir, "documents"))


def op4_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(table(spark, sf_dir, "documents"))


def op10_redirect_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op2_virtual_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_schedule_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         md5('mix:' || coalesce(cast(doc_id as varchar), '')) as h
  from documents),
per_source as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as nth from sized group by source),
weighed as (
  select *, case (nth - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w, cast(2 * source_size as bigint) as cap from per_source),
ranked as (
  select *, cast(cap as double) / w as ratio, sum(source_size) over () as total, sum(w) over () as all_w from weighed),
leveled as (
  select *, (total * 1.5::double
     - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
     / (all_w - coalesce(sum(w) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0)) as lev
  from ranked),
goals as (
  select source, source_size, least(cast(cap as double), coalesce((select arg_min(lev, ratio) from leveled where lev <= ratio) * w, cast(cap as double))) as target from leveled),
plan as (
  select *, cast(floor(target) as bigint) as goal, greatest(1, cast(ceil(all_t / 65536) as bigint)) as block
  from (select *, row_number() over (order by source nulls last) as nth, sum(target) over () as all_t,
          sum(target) over (order by source nulls last rows between unbounded preceding and current row) as hi from goals)),
points as (select k, k * '0.6180339887498949'::double as p from range(65536) t(k)),
slots as (
  select nth, k, row_number() over (partition by nth order by k) - 1 as nr
  from points join plan on all_t > 0 and p - floor(p) >= (hi - target) / all_t and p - floor(p) < hi / all_t),
placed as (
  select s.*, p.source_size, p.target, p.goal, p.nth, p.block,
         row_number() over (order by s.doc_id) as row,
         cast(coalesce(sum(s.size) over (partition by s.source order by h, doc_id, s.size rows between unbounded preceding and 1 preceding), 0) as bigint) as start
  from sized s join plan p on s.source is not distinct from p.source),
spread as (select *, unnest(range(start // block, (start + size - 1) // block + 1)) as nr from placed where size > 0),
firsts as (
  select row, min(coalesce(k, 65536 + nr)) as first_slot from spread left join slots using (nth, nr)
  where least(start + size, (nr + 1) * block, source_size, goal) > greatest(start, nr * block) group by row)
select doc_id, cast(size as bigint) as size, source_size, target, source,
  cast(case when source_size = 0 then 0 else (goal // source_size) * size + greatest(0, least(size, goal % source_size - start)) end as bigint) as taken,
  cast(first_slot as bigint) as first_slot
from placed left join firsts using (row)
"""

def op6_winnowed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
cut as (select item, w, least(len(w), 10) as n from iw where len(w) > 0),
windows as (select distinct item, n, array_to_string(w[s:s + n - 1], ' ') as k from (select *, unnest(range(1, len(w) - n + 2)) as s from cut)),
grams as (
  select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') as k
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from dw, (select distinct n from windows) where len(w) >= n)),
met as (select g.doc_id, g.s, g.n, x.item from grams g join windows x on g.n = x.n and g.k = x.k),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from met) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as l from (select distinct doc_id, item from met) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw d left join pos using (doc_id) left join its using (doc_id)
"""

OP7_SQL = r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) end as s from d),
cls as (select list_sort(s) as s, min(doc_id) as class_id, len(any_value(s)) as n from sets where len(s) > 0 group by 1),
tok as (select class_id, n, unnest(s) as t from cls),
df as (select t, count(*) as f from tok group by t),
ranked as (select class_id, n, k.t, row_number() over (partition by class_id order by f, k.t) as r from tok k join df on k.t = df.t),
pre as (select class_id, n, t from ranked where r <= n - ceil(n * 0.9) + 1),
cand as (select distinct x.class_id as a, y.class_id as b from pre x join pre y on x.t = y.t and x.class_id < y.class_id and least(x.n, y.n) * 100 >= 90 * greatest(x.n, y.n)),
hit as (select c.a, c.b, x.n as na, y.n as nb, len(list_intersect(x.s, y.s)) as i from cand c join cls x on x.class_id = c.a join cls y on y.class_id = c.b),
link as (select a, b from hit where 100 * i >= 90 * (na + nb - i) union select b, a from hit where 100 * i >= 90 * (na + nb - i)),
reach(node, other) as (select class_id, class_id from cls union select r.node, l.b from reach r join link l on l.a = r.other),
comp as (select node, min(other) as component_id from reach group by node)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(c.class_id, s.doc_id) as class_id, coalesce(m.component_id, s.doc_id) as component_id
from sets s left join cls c on len(s.s) > 0 and list_sort(s.s) = c.s left join comp m on m.node = c.class_id
"""

OP10_SQL = r"""
with recursive l as (
  select url, unnest([regexp_extract(regexp_extract(html, '<link[^>]+rel=["'']?canonical["'']?[^>]*>'), 'href=["'']?([^"''\s>]+)', 1),
                      regexp_extract(regexp_extract(html, '<meta[^>]+http-equiv=["'']?refresh["'']?[^>]*>'), 'url=["'']?([^"''\s>]+)', 1)]) as target from pages),
u as (select url, page_id, true as page from pages union all select url, null, false from l where contains(target, '://') union all select target, null, false from l where contains(target, '://')),
p as (select *, case when contains(coalesce(url, ''), '://') then split_part(substr(url, strpos(url, '://') + 3), '#', 1) else '' end as rest from u),
h as (
  select *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
rules(verdict, rh, rp) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit as (
  select host, path, arg_max(rh || rp, length(rh) + length(rp)) as rule, arg_max(verdict, length(rh) + length(rp)) as verdict
  from (select distinct host, path from h) join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by host, path),
n as (
  select h.*, f.rule, f.verdict, case when h.host <> '' then h.host || regexp_replace(h.path, '/+$', '') || regexp_extract(rest, '\?.*$', 0, 's') end as node
  from h left join fit f on h.host = f.host and h.path = f.path),
name as (select distinct url, node from n where node is not null),
edge as (select a.node as x, b.node as y from l join name a on a.url = l.url join name b on b.url = l.target),
sym as (select x, y from edge union select y, x from edge),
reach(node, other) as (select node, node from name union select r.node, b.y from reach r join sym b on b.x = r.other),
said as (select r.node, bool_or(n.verdict = 'block') and not bool_or(n.verdict = 'allow') as bad from reach r join n on n.node = r.other where n.verdict is not null group by r.node)
select page_id, host, path, rule, coalesce(verdict, case when bad then 'block' else 'allow' end) as verdict from n left join said using (node) where page
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_crf_toxicity": op1_crf_toxicity,
    "op2_virtual_slot_shards": op2_virtual_slot_shards,
    "op3_schedule_mix": op3_schedule_mix,
    "op4_kneser_ney_quality": op4_kneser_ney_quality,
    "op5_chained_passages": op5_chained_passages,
    "op6_winnowed_decontamination": op6_winnowed_decontamination,
    "op7_partition_jaccard": op7_partition_jaccard,
    "op8_scaled_sketch": op8_scaled_sketch,
    "op9_deleted_interpolation": op9_deleted_interpolation,
    "op10_redirect_verdicts": op10_redirect_verdicts,
}

ORACLES: dict[str, str] = {"op3_schedule_mix": OP3_SQL, "op6_winnowed_decontamination": OP6_SQL, "op7_partition_jaccard": OP7_SQL, "op10_redirect_verdicts": OP10_SQL}
