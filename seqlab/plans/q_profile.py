"""Queries: histograms, pair counts, profile, scaling, majority baseline."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from seqlab.operators import metrics as M
from seqlab.operators.profile import column_profile, pair_counts, standardize
from seqlab.operators.sampling import stratified_split
from seqlab.operators.stats import histogram, uniform_bin_sql
from seqlab.plans.catalog import register
from seqlab.plans.q_metrics import costs_sql, rates_sql
from seqlab.sources.readers import read_table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lineitem(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(*[(F.col(f) + F.lit(0.0)).alias(f) for f in FEATURES],
                     (F.col("l_returnflag") == "R").cast("int").alias("y"), "l_orderkey", "l_linenumber")


LI_SQL = ("select " + ", ".join(f"{f} + 0.0 as {f}" for f in FEATURES)
          + ", cast(l_returnflag = 'R' as integer) as y, l_orderkey, l_linenumber from lineitem")

A21_SQL = f"""with li as ({LI_SQL}), b as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi, count(*) as n from li),
x as (select {uniform_bin_sql('li.l_extendedprice', 'b.lo', 'b.hi', 30)} as bin, y from li, b),
c as (select bin, count(*) as n, count(*) filter (where y = 1) as n_class_1, count(*) filter (where y = 0) as n_class_0
      from x group by bin),
g as (select cast(range as integer) as bin from range(30))
select g.bin, round(g.bin * ((b.hi - b.lo) / 30.0) + b.lo, 6) as bin_lo,
  round(case when g.bin = 29 then b.hi else (g.bin + 1) * ((b.hi - b.lo) / 30.0) + b.lo end, 6) as bin_hi,
  coalesce(c.n, 0) as n, coalesce(c.n_class_1, 0) as n_class_1, coalesce(c.n_class_0, 0) as n_class_0,
  round(coalesce(c.n, 0) / (b.n * ((b.hi - b.lo) / 30.0)), 6) as density
from g cross join b left join c on g.bin = c.bin"""


@register("A21_histogram_by_class", A21_SQL)
def a21_histogram_by_class(spark, sf_dir):
    h = histogram(_lineitem(spark, sf_dir), "l_extendedprice", 30, cls="y")
    return h.select("bin", *[F.round(c, 6).alias(c) for c in ("bin_lo", "bin_hi")], "n", "n_class_1",
                    "n_class_0", F.round("density", 6).alias("density"))


def _a24_sql() -> str:
    lohi = ", ".join(f"min({f}) as lo_{f}, max({f}) as hi_{f}" for f in FEATURES)
    bins = ", ".join(f"{uniform_bin_sql(f'li.{f}', f'b.lo_{f}', f'b.hi_{f}', 10)} as b_{f}" for f in FEATURES)
    parts = " union all ".join(
        f"select '{a}' as x_col, '{b}' as y_col, b_{a} as x_bin, b_{b} as y_bin, y as cls from x"
        for a, b in combinations(FEATURES, 2))
    return (f"with li as ({LI_SQL}), b as (select {lohi} from li), x as (select y, {bins} from li, b), "
            f"u as ({parts}) select x_col, y_col, x_bin, y_bin, cls, count(*) as n from u group by all")


@register("A24_pair_counts", _a24_sql())
def a24_pair_counts(spark, sf_dir):
    return pair_counts(_lineitem(spark, sf_dir), FEATURES, "y", 10)


A25_COLS = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
            ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
            ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]


@register("A25_column_profile", " union all ".join(
    f"select '{c}' as column_name, '{t}' as data_type, count({c}) as non_null from lineitem" for c, t in A25_COLS))
def a25_column_profile(spark, sf_dir):
    return column_profile(read_table(spark, sf_dir, "lineitem"))


M1_SQL = (f"with li as ({LI_SQL}), st as (select " + ", ".join(
    f"avg({f}) as m_{f}, stddev_pop({f}) as s_{f}" for f in FEATURES) + " from li) select l_orderkey, l_linenumber, "
    + ", ".join(f"round(case when s_{f} = 0 then 0.0 else ({f} - m_{f}) / s_{f} end, 6) + 0.0 as z_{f}"
                for f in FEATURES) + " from li, st")


@register("M1_standardize", M1_SQL)
def m1_standardize(spark, sf_dir):
    z = standardize(_lineitem(spark, sf_dir), FEATURES, "_z")
    return z.select("l_orderkey", "l_linenumber",
                    *[(F.round(f + "_z", 6) + F.lit(0.0)).alias(f"z_{f}") for f in FEATURES])


M3_SQL = f"""with o as (select o_orderkey, cast(o_orderstatus = 'F' as integer) as y from orders),
r as (select *, row_number() over (partition by y order by md5('42:' || o_orderkey), o_orderkey) as rk from o),
c as (select y, count(*) as n from o group by y),
t as (select ceil(0.33::double * sum(n)) as nt, sum(n) as ntot from c),
b as (select y, n, nt * n / ntot as ex, floor(nt * n / ntot) as base, nt from c, t),
k as (select *, ex - base as rem, nt - sum(base) over () as extra from b),
a as (select y, base + case when row_number() over (order by rem desc, y) <= extra then 1 else 0 end as n_test from k),
s as (select r.o_orderkey, r.y, case when rk <= n_test then 'test' else 'train' end as side from r join a using (y)),
maj as (select y as majority from s where side = 'train' group by y order by count(*) desc, y limit 1),
cm as (select count(*) filter (where y = 0 and majority = 0) as tn, count(*) filter (where y = 0 and majority = 1) as fp,
       count(*) filter (where y = 1 and majority = 0) as fn, count(*) filter (where y = 1 and majority = 1) as tp
       from s, maj where side = 'test')
select (select majority from maj) as majority, tn, fp, fn, tp, {rates_sql()}, {costs_sql()} from cm"""


@register("M3_majority_baseline", M3_SQL)
def m3_majority_baseline(spark, sf_dir):
    from seqlab.plans.models import majority_label
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    split = stratified_split(o, "o_orderkey", "y", 0.33, 42)
    maj = majority_label(split.where(F.col("side") == "train"), "y")
    test = split.where(F.col("side") == "test").crossJoin(F.broadcast(maj))
    cm = M.confusion_counts(test, "y", "majority").crossJoin(F.broadcast(maj))
    out = cm.select("majority", "tn", "fp", "fn", "tp", *M.rates(), *M.cost_columns())
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])
