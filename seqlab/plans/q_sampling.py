"""Queries: hash rank, splits, folds, undersampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlab.operators import sampling as D
from seqlab.plans.catalog import register
from seqlab.plans.q_order import SECTIONS_CTE, sectioned
from seqlab.sources.readers import read_table
from seqlab.session import materialize

SEED = 42
ORD_SQL = ("select o_orderkey, o_orderstatus, cast(o_orderstatus = 'F' as integer) as y, o_totalprice, "
           "o_orderpriority from orders")


def orders(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_orderstatus", (F.col("o_orderstatus") == "F").cast("int").alias("y"),
                    "o_totalprice", "o_orderpriority")


@register("D9_hash_shuffle_rank", "select o_orderkey, row_number() over (order by md5('42:' || o_orderkey), "
          "o_orderkey) as rank from orders")
def d9_hash_shuffle_rank(spark, sf_dir):
    return D.hash_rank(orders(spark, sf_dir).select("o_orderkey"), "o_orderkey", SEED)


@register("P2_hash_rank_by_class", "select o_orderkey, o_orderstatus, row_number() over (partition by "
          "o_orderstatus order by md5('42:' || o_orderkey), o_orderkey) as rank from orders")
def p2_hash_rank_by_class(spark, sf_dir):
    return D.hash_rank(orders(spark, sf_dir).select("o_orderkey", "o_orderstatus"), "o_orderkey", SEED,
                       by=["o_orderstatus"])


D1_SQL = """with o as (select o_orderkey, o_orderstatus as cls, row_number() over (partition by o_orderstatus
       order by md5('42:' || o_orderkey), o_orderkey) as rk from orders),
c as (select cls, count(*) as n from o group by cls),
t as (select ceil(0.33::double * sum(n)) as nt, sum(n) as ntot from c),
b as (select cls, n, nt * n / ntot as ex, floor(nt * n / ntot) as base, nt from c, t),
k as (select *, ex - base as rem, nt - sum(base) over () as extra from b),
a as (select cls, base + case when row_number() over (order by rem desc, cls) <= extra then 1 else 0 end as n_test
      from k)
select o_orderkey, cls as o_orderstatus, case when rk <= n_test then 'test' else 'train' end as side
from o join a using (cls)"""


@register("D1_stratified_split", D1_SQL)
def d1_stratified_split(spark, sf_dir):
    o = orders(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    return D.stratified_split(o, "o_orderkey", "o_orderstatus", 0.33, SEED)


D2_SQL = f"""with {SECTIONS_CTE},
g as (select id, case when section > 0 then 's' || section else 'r' || id end as grp from sec),
gs as (select grp, row_number() over (order by md5('42:' || grp), grp) as grk, count(*) over () as ng
       from (select distinct grp from g) t)
select g.id, case when grk <= floor(0.75 * ng) then 'train' else 'test' end as side from g join gs using (grp)"""


def _sections_once(spark, sf_dir, *more):
    """The narrow section table, computed once: every step of a split reads it again."""
    return materialize(sectioned(spark, sf_dir).select("id", *more, "section"))


@register("D2_group_split", D2_SQL)
def d2_group_split(spark, sf_dir):
    s = _sections_once(spark, sf_dir)
    return D.group_split(s, "id", "section", 0.75, SEED).select("id", "side")


D3_CTE = f"""{SECTIONS_CTE},
cutoff as (select (max(section) * 15 + 17) // 18 as cut from sec),
p as (select id, label, section, case when section <= cut then 'train' else 'test' end as side
      from sec, cutoff where section > 0),
f as (select case when count(*) > 0 then count(*) filter (where side = 'train') * 1.0 / count(*) else 0.75 end
      as f from p),
n as (select id, label, section, row_number() over (order by md5('42:' || id), id) as rk,
      count(*) over () as n0 from sec where section = 0),
split as (select id, label, section, side from p
          union all
          select id, label, section, case when rk <= floor(n0 * (select f from f)) then 'train' else 'test' end
          from n)"""


def _d3(spark, sf_dir):
    s = _sections_once(spark, sf_dir, "label")
    train, test = D.section_ranges(s.agg(F.max("section")).first()[0])
    return D.section_range_split(s, "id", "label", "section", train, test, SEED)


@register("D3_section_range_split", f"with {D3_CTE} select id, side from split")
def d3_section_range_split(spark, sf_dir):
    return _d3(spark, sf_dir).select("id", "side")


@register("D10_split_summary", f"with {D3_CTE} select side, count(*) as n, count(*) filter (where label = 1) "
          "as n_label_1, count(*) filter (where label = 0) as n_label_0, count(distinct case when section > 0 "
          "then section end) as n_sections from split group by side")
def d10_split_summary(spark, sf_dir):
    return D.split_summary(_d3(spark, sf_dir), "side", "label", "section")


@register("D10_split_sections", f"with {D3_CTE} select distinct side, section from split where section > 0")
def d10_split_sections(spark, sf_dir):
    return D.split_sections(_d3(spark, sf_dir), "side", "section")


@register("D4_stratified_kfold", "select o_orderkey, cast((row_number() over (partition by o_orderstatus order by "
          "md5('42:' || o_orderkey), o_orderkey) - 1) % 5 as integer) as fold from orders")
def d4_stratified_kfold(spark, sf_dir):
    o = orders(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    return D.stratified_kfold(o, "o_orderkey", "o_orderstatus", 5, SEED).select("o_orderkey", "fold")


D5_SQL = f"""with {SECTIONS_CTE},
r as (select section, row_number() over (order by n_samples desc, md5('42:' || section)) - 1 as r0 from sizes),
sf as (select section, cast(case when (r0 // 5) % 2 = 0 then r0 % 5 else 4 - r0 % 5 end as integer) as fold
       from r)
select s.id, sf.fold from sec s join sf using (section) where s.section > 0
union all
select id, cast((row_number() over (order by md5('42:' || id), id) - 1) % 5 as integer) as fold
from sec where section = 0"""


@register("D5_stratified_group_kfold", D5_SQL)
def d5_stratified_group_kfold(spark, sf_dir):
    s = _sections_once(spark, sf_dir)
    return D.stratified_group_kfold(s, "id", "section", 5, SEED).select("id", "fold")


D6_SQL = f"""with o as ({ORD_SQL}), c as (select y, count(*) as n from o group by y)
select min(n) as minority, max(n) as majority, cast(floor(min(n) * 1.0::double) as bigint) as level from c"""


@register("D6_undersample_level", D6_SQL)
def d6_undersample_level(spark, sf_dir):
    return D.undersample_level(D.class_counts(orders(spark, sf_dir), "y"), ratio=1.0)


D7_CTE = f"""o as ({ORD_SQL}),
c as (select y, count(*) as n from o group by y),
lv as (select cast(floor(min(n) * 1.0::double) as bigint) as level from c),
rk as (select o_orderkey, y, row_number() over (partition by y order by md5('42:' || o_orderkey), o_orderkey)
       as rk from o)"""


@register("D7_undersample", f"with {D7_CTE} select o_orderkey, y from rk, lv where rk <= level")
def d7_undersample(spark, sf_dir):
    return D.undersample(orders(spark, sf_dir).select("o_orderkey", "y"), "o_orderkey", "y", ratio=1.0, seed=SEED)


@register("U3_undersample_complement", f"with {D7_CTE} select o_orderkey, y from rk, lv where rk > level")
def u3_undersample_complement(spark, sf_dir):
    o = orders(spark, sf_dir).select("o_orderkey", "y")
    return D.complement(o, D.undersample(o, "o_orderkey", "y", ratio=1.0, seed=SEED), "o_orderkey")


@register("D7_undersample_ratio_0_5", f"""with o as ({ORD_SQL}),
c as (select y, count(*) as n from o group by y),
lv as (select cast(floor(min(n) * 0.5::double) as bigint) as level from c),
rk as (select o_orderkey, y, row_number() over (partition by y order by md5('42:' || o_orderkey), o_orderkey)
       as rk from o)
select y, count(*) as n from rk, lv where rk <= level group by y""")
def d7_undersample_ratio_half(spark, sf_dir):
    s = D.undersample(orders(spark, sf_dir).select("o_orderkey", "y"), "o_orderkey", "y", ratio=0.5, seed=SEED)
    return s.groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@register("D3_dropped_sections", f"with {SECTIONS_CTE} select section, count(*) as n_dropped from sec "
          "where section > 0 and section not between 1 and 18 group by section")
def d3_dropped_sections(spark, sf_dir):
    s = sectioned(spark, sf_dir).select("id", "section")
    return D.unlisted_sections(s, "section", range(1, 16), range(16, 19))
