"""Queries: sections, class counts and overview."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlab.functions.exprs import safe_div
from seqlab.operators import sections as S
from seqlab.plans.catalog import register
from seqlab.session import materialize
from seqlab.sources.readers import RECORDS_SQL, read_table, records

SECTIONS_CTE = f"""
rec as ({RECORDS_SQL}),
lagged as (select *, lag(label) over (order by pos, id) as prev_label from rec),
starts as (select *, sum(case when label = 1 and coalesce(prev_label, 0) <> 1 then 1 else 0 end)
           over (order by pos, id rows between unbounded preceding and current row) as n_starts from lagged),
sec as (select id, pos, label, value, cast(case when label = 1 then n_starts else 0 end as bigint) as section
        from starts),
sizes as (select section, count(*) as n_samples from sec where section > 0 group by section)
"""


def sectioned(spark, sf_dir):
    return S.add_sections(records(spark, sf_dir), "label", "pos", "id")


def _sizes_once(spark, sf_dir):
    """The size table, one narrow row per section, computed once: the report and the rank read it several times."""
    return materialize(S.section_sizes(sectioned(spark, sf_dir)))


@register("W1_sections", f"with {SECTIONS_CTE} select id, pos, label, section from sec")
def w1_sections(spark, sf_dir):
    return sectioned(spark, sf_dir).select("id", "pos", "label", "section")


@register("A3_section_sizes", f"with {SECTIONS_CTE} select section, n_samples from sizes")
def a3_section_sizes(spark, sf_dir):
    return S.section_sizes(sectioned(spark, sf_dir))


A4_SQL = f"""with {SECTIONS_CTE}
select count(*) as n_sections, round(avg(n_samples), 6) as mean_size,
       round(median(n_samples), 6) as median_size, min(n_samples) as min_size, max(n_samples) as max_size,
       round(stddev_samp(n_samples), 6) as std_size,
       (select section from sizes order by n_samples, section limit 1) as smallest_section,
       (select section from sizes order by n_samples desc, section limit 1) as largest_section
from sizes"""


@register("A4_section_stats", A4_SQL)
def a4_section_stats(spark, sf_dir):
    st = S.section_stats(S.section_sizes(sectioned(spark, sf_dir)))
    return st.select("n_sections", F.round("mean_size", 6).alias("mean_size"),
                     F.round("median_size", 6).alias("median_size"), "min_size", "max_size",
                     F.round("std_size", 6).alias("std_size"), "smallest_section", "largest_section")


A5_SQL = f"""with {SECTIONS_CTE}
select section, n_samples,
       cast(sum(n_samples) over (order by section rows between unbounded preceding and current row) as bigint)
         as cumulative_samples,
       round(n_samples * 100.0 / sum(n_samples) over (), 2) as percentage_of_total
from sizes"""


@register("A5_section_report", A5_SQL)
def a5_section_report(spark, sf_dir):
    return S.section_report(_sizes_once(spark, sf_dir))


W5_SQL = f"""with {SECTIONS_CTE}
select section, min(pos) as span_start, max(pos) as span_end, count(*) as n_samples
from sec where section > 0 group by section"""


@register("W5_label_spans", W5_SQL)
def w5_label_spans(spark, sf_dir):
    return S.label_spans(sectioned(spark, sf_dir), "pos")


W6_SQL = f"""with {SECTIONS_CTE},
rep as (select section, n_samples, sum(n_samples) over (order by section) as cum, sum(n_samples) over () as total
        from sizes)
select min(section) as section, cast(min(cum) as bigint) as cumulative_samples,
       cast(max(total) as bigint) as total_samples
from rep where cum >= 0.75 * total"""


@register("W6_first_section_75pct", W6_SQL)
def w6_first_section(spark, sf_dir):
    rep = materialize(S.section_report(_sizes_once(spark, sf_dir)))
    return S.first_section_reaching(rep, 0.75)


W8_SQL = f"""with {SECTIONS_CTE}
select section, n_samples, row_number() over (order by n_samples desc, section) as size_rank from sizes"""


@register("W8_section_size_rank", W8_SQL)
def w8_section_size_rank(spark, sf_dir):
    return S.size_rank(_sizes_once(spark, sf_dir))


@register("A26_n_sections", f"with {SECTIONS_CTE} select count(distinct section) as n_sections "
          "from sec where section > 0")
def a26_n_sections(spark, sf_dir):
    return S.n_sections(sectioned(spark, sf_dir))


@register("A1_class_counts", f"with rec as ({RECORDS_SQL}) select label, count(*) as n from rec group by label")
def a1_class_counts(spark, sf_dir):
    return records(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


A1R_SQL = f"""with rec as ({RECORDS_SQL}), c as (select label, count(*) as n from rec group by label)
select max(n) as majority, min(n) as minority, round(max(n) * 1.0 / min(n), 6) as imbalance_ratio from c"""


@register("A1_imbalance_ratio", A1R_SQL)
def a1_imbalance_ratio(spark, sf_dir):
    c = records(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.max("n").alias("majority"), F.min("n").alias("minority"),
                 F.round(safe_div(F.max("n").cast("double"), F.min("n")), 6).alias("imbalance_ratio"))


def _overview(df, label):
    return df.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col(label) == 1).alias("n_label_1"),
        F.count_if(F.col(label) == 0).alias("n_label_0"),
        F.round(safe_div(F.count_if(F.col(label) == 1) * F.lit(100.0), F.count(F.lit(1))), 6)
        .alias("pct_label_1"),
        F.round(safe_div(F.count_if(F.col(label) == 0) * F.lit(100.0), F.count(F.lit(1))), 6)
        .alias("pct_label_0"),
    )


def _overview_sql(src: str, label: str) -> str:
    return (f"select count(*) as n_total, count(*) filter (where {label} = 1) as n_label_1, "
            f"count(*) filter (where {label} = 0) as n_label_0, "
            f"round(count(*) filter (where {label} = 1) * 100.0 / count(*), 6) as pct_label_1, "
            f"round(count(*) filter (where {label} = 0) * 100.0 / count(*), 6) as pct_label_0 from {src}")


@register("A2_overview", f"with rec as ({RECORDS_SQL}) " + _overview_sql("rec", "label"))
def a2_overview(spark, sf_dir):
    return _overview(records(spark, sf_dir), "label")


@register("A2_overview_quality",
          "with d as (select l.quality from documents d join labels l on d.doc_id = l.doc_id) "
          + _overview_sql("d", "quality"))
def a2_overview_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return _overview(docs.join(lab, "doc_id"), "quality")
