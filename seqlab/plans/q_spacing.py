"""Queries: spacing, gaps, coverage, order and ECDF."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlab.functions.exprs import is_finite
from seqlab.operators import spacing as SP
from seqlab.operators.order import global_rank
from seqlab.operators.stats import uniform_bin_sql
from seqlab.plans.catalog import register
from seqlab.sources.readers import RECORDS_SQL, records

GAP = 600.0  # seconds: the gap threshold used on the event stand-in

SPACED_CTE = f"""
rec as ({RECORDS_SQL}),
sp as (select *, lag(pos) over (order by pos, id) as prev_pos, lag(id) over (order by pos, id) as prev_id,
       pos - lag(pos) over (order by pos, id) as diff from rec),
d as (select diff, id from sp where diff is not null)
"""


def spaced(spark, sf_dir):
    return SP.with_spacing(records(spark, sf_dir), "pos", "id")


@register("W2_spacing", f"with {SPACED_CTE} select id, pos, prev_pos, diff from sp")
def w2_spacing(spark, sf_dir):
    return spaced(spark, sf_dir).select("id", "pos", "prev_pos", "diff")


@register("W3_gaps", f"with {SPACED_CTE} select prev_pos as gap_start, pos as gap_end, diff as gap_length "
          f"from sp where diff > {GAP}")
def w3_gaps(spark, sf_dir):
    return SP.gaps(spaced(spark, sf_dir), "pos", GAP)


W4_SQL = f"""with {SPACED_CTE},
seg as (select *, cast(sum(case when diff > {GAP} then 1 else 0 end)
        over (order by pos, id rows between unbounded preceding and current row) as bigint) as segment from sp)
select pos, id, 0 as is_separator, value, segment from seg
union all
select prev_pos as pos, prev_id as id, 1 as is_separator, cast(null as double) as value, segment - 1 as segment
from seg where diff > {GAP}"""


@register("W4_segments", W4_SQL)
def w4_segments(spark, sf_dir):
    return SP.segments(records(spark, sf_dir), "pos", "id", GAP, "value")


W7_SQL = f"""with {SPACED_CTE}
select diff, id, round(row_number() over (order by diff, id) * 100.0 / count(*) over (), 6) as ecdf_pct from d"""


@register("W7_spacing_ecdf", W7_SQL)
def w7_spacing_ecdf(spark, sf_dir):
    d = spaced(spark, sf_dir).where(F.col("diff").isNotNull()).select("diff", "id")
    return SP.ecdf(d, "diff", "id").withColumn("ecdf_pct", F.round("ecdf_pct", 6))


@register("T1_sort_desc", f"with rec as ({RECORDS_SQL}) select id, pos, "
          "row_number() over (order by pos desc, id) as row_idx from rec")
def t1_sort_desc(spark, sf_dir):
    return global_rank(records(spark, sf_dir).select("id", "pos"), "pos", "id", descending=True)


T2_SQL = f"""with {SPACED_CTE}
select cast(row_number() over (order by diff desc, pos) as integer) as gap_rank, prev_pos as gap_start, pos as gap_end, diff
from sp where diff is not null order by diff desc, pos limit 20"""


@register("T2_top20_gaps", T2_SQL)
def t2_top_gaps(spark, sf_dir):
    return SP.top_gaps(spaced(spark, sf_dir), "pos", 20)


@register("T7_head", f"with rec as ({RECORDS_SQL}) select id, pos, label from rec order by pos, id limit 5")
def t7_head(spark, sf_dir):
    return records(spark, sf_dir).orderBy("pos", "id").limit(5).select("id", "pos", "label")


A17_SQL = f"""with {SPACED_CTE}
select count(diff) as n, round(avg(diff), 6) as mean, round(median(diff), 6) as median,
       round(stddev_samp(diff), 6) as std, min(diff) as min, max(diff) as max from d"""


@register("A17_spacing_stats", A17_SQL)
def a17_spacing_stats(spark, sf_dir):
    st = SP.spacing_stats(spaced(spark, sf_dir), "id")
    return st.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")], "min", "max")


A18_SQL = f"""with {SPACED_CTE},
q as (select quantile_cont(diff, [0.5, 0.75, 0.9, 0.95, 0.99, 0.995, 0.999]) as qs from d),
v as (select unnest([50.0, 75.0, 90.0, 95.0, 99.0, 99.5, 99.9]::double[]) as percentile, unnest(qs) as value from q)
select percentile, round(value, 6) as value, (select count(*) from d where d.diff > v.value) as n_above from v"""


@register("A18_spacing_percentiles", A18_SQL)
def a18_spacing_percentiles(spark, sf_dir):
    out = SP.spacing_percentiles(spaced(spark, sf_dir), "id")
    return out.select("percentile", F.round("value", 6).alias("value"), "n_above")


A19_SQL = f"""with {SPACED_CTE},
st as (select avg(diff) as m, stddev_samp(diff) as s, quantile_cont(diff, 0.25) as q1,
       quantile_cont(diff, 0.75) as q3, quantile_cont(diff, 0.95) as p95, quantile_cont(diff, 0.99) as p99,
       quantile_cont(diff, 0.995) as p995 from d),
th as (select 'Mean + 2*Std' as method, m + 2 * s as threshold from st
       union all select 'Mean + 3*Std', m + 3 * s from st
       union all select 'Q3 + 1.5*IQR (Outliers)', q3 + 1.5 * (q3 - q1) from st
       union all select 'Q3 + 3*IQR (Extreme outliers)', q3 + 3 * (q3 - q1) from st
       union all select '95th percentile', p95 from st
       union all select '99th percentile', p99 from st
       union all select '99.5th percentile', p995 from st)
select method, round(threshold, 6) as threshold,
       (select count(*) from d where d.diff > th.threshold) as n_gaps,
       round((select coalesce(sum(diff), 0) from d where d.diff > th.threshold), 6) as total_gap_length
from th"""


@register("A19_gap_thresholds", A19_SQL)
def a19_gap_thresholds(spark, sf_dir):
    out = SP.gap_thresholds(spaced(spark, sf_dir), "id")
    return out.select("method", F.round("threshold", 6).alias("threshold"), "n_gaps",
                      F.round("total_gap_length", 6).alias("total_gap_length"))


A20_SQL = f"""with {SPACED_CTE},
med as (select median(diff) as m from d where diff <= {GAP}),
agg as (select max(pos) - min(pos) as total_length,
        coalesce(sum(diff) filter (where diff > {GAP}), 0) as gap_len,
        count(*) filter (where diff > {GAP}) as num_gaps,
        count(*) filter (where label = 1) as num_label_points,
        count(*) filter (where label = 0) as num_other_points,
        count(*) as num_data_points from sp)
select round(total_length, 6) as total_length, round(total_length - gap_len, 6) as data_coverage,
       round(case when total_length > 0 then (total_length - gap_len) * 100.0 / total_length else 0 end, 6)
         as coverage_percentage,
       num_gaps, num_label_points, num_other_points,
       round(coalesce(num_label_points * (select m from med), 0), 6) as label_length, num_data_points
from agg"""


@register("A20_coverage_summary", A20_SQL)
def a20_coverage_summary(spark, sf_dir):
    out = SP.coverage_summary(spaced(spark, sf_dir), "pos", "id", "label", GAP)
    rounded = ("total_length", "data_coverage", "coverage_percentage", "label_length")
    return out.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in out.columns])


A22_SQL = f"""with {SPACED_CTE},
cut as (select quantile_cont(diff, 0.99) as c from d),
t as (select diff from d where diff <= (select c from cut)),
b as (select min(diff) as lo, max(diff) as hi, count(*) as n from t),
x as (select {uniform_bin_sql('t.diff', 'b.lo', 'b.hi', 100)} as bin from t, b),
c as (select bin, count(*) as n from x group by bin),
g as (select cast(range as integer) as bin from range(100))
select g.bin, round(g.bin * ((b.hi - b.lo) / 100.0) + b.lo, 6) as bin_lo,
       round(case when g.bin = 99 then b.hi else (g.bin + 1) * ((b.hi - b.lo) / 100.0) + b.lo end, 6) as bin_hi,
       coalesce(c.n, 0) as n,
       round(coalesce(c.n, 0) / (b.n * ((b.hi - b.lo) / 100.0)), 6) as density
from g cross join b left join c on g.bin = c.bin"""


@register("A22_truncated_histogram", A22_SQL)
def a22_truncated_histogram(spark, sf_dir):
    h = SP.truncated_histogram(spaced(spark, sf_dir), "id", 99.0, 100)
    return h.select("bin", F.round("bin_lo", 6).alias("bin_lo"), F.round("bin_hi", 6).alias("bin_hi"), "n",
                    F.round("density", 6).alias("density"))


A23_SQL = f"""with {SPACED_CTE},
q as (select quantile_cont(diff, 0.25) as q1, quantile_cont(diff, 0.5) as med, quantile_cont(diff, 0.75) as q3
      from d)
select round(q1, 6) as q1, round(med, 6) as median, round(q3, 6) as q3, round(q3 - q1, 6) as iqr,
       (select min(diff) from d where diff >= q1 - 1.5 * (q3 - q1)) as whisker_low,
       (select max(diff) from d where diff <= q3 + 1.5 * (q3 - q1)) as whisker_high,
       (select count(*) from d where diff < q1 - 1.5 * (q3 - q1) or diff > q3 + 1.5 * (q3 - q1)) as n_outliers
from q"""


@register("A23_spacing_boxplot", A23_SQL)
def a23_spacing_boxplot(spark, sf_dir):
    d = spaced(spark, sf_dir).where(F.col("diff").isNotNull())
    b = SP.box_stats(d, "diff", "id")
    return b.select(*[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "iqr")],
                    "whisker_low", "whisker_high", "n_outliers")


P11_SQL = f"""with rec as ({RECORDS_SQL})
select count(*) filter (where value is null) as n_null, count(value) as n_not_null,
       count(*) filter (where value is not null and not isnan(value) and abs(value) < 'inf'::double)
         as n_finite
from rec"""


@register("P11_finite_counts", P11_SQL)
def p11_finite_counts(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.agg(F.count_if(F.col("value").isNull()).alias("n_null"), F.count("value").alias("n_not_null"),
                 F.count_if(is_finite("value")).alias("n_finite"))
