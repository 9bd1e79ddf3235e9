"""Queries: intervals, axis, bins, sources, projections, cleaning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqlab.operators.sampling import section_ranges, stratified_split
from seqlab.session import checkpoint_dir, materialize
from seqlab.functions.exprs import class_name, prob_to_label, torque_ratio
from seqlab.operators import clean as C
from seqlab.operators.bins import grid_cells, rebase_axis
from seqlab.operators.intervals import label_by_intervals, split_by_membership
from seqlab.plans.catalog import register
from seqlab.plans.pipeline import CleanConfig, clean
from seqlab.plans.q_order import SECTIONS_CTE, sectioned
from seqlab.plans.q_sampling import D1_SQL as SPLIT_SQL
from seqlab.sources.readers import (RECORDS_SQL, concat_sources, intervals, intervals_sql, load_features, read_csv, read_table,
                                    records)
from seqlab.sources.writers import write_dataset

J1_SQL = f"""with rec as ({RECORDS_SQL}), iv as ({intervals_sql()})
select r.id, r.pos,
       cast(exists(select 1 from iv where r.pos >= iv.iv_end and r.pos <= iv.iv_start) as integer) as in_interval
from rec r"""


def _j1(spark, sf_dir, strategy):
    r = records(spark, sf_dir).select("id", "pos")
    return label_by_intervals(r, "pos", intervals(spark, sf_dir), "iv_start", "iv_end", strategy=strategy, tie="id")


@register("J1_interval_label", J1_SQL)
def j1_interval_label(spark, sf_dir):
    return _j1(spark, sf_dir, "auto")


@register("J1_interval_label_shuffled", J1_SQL)
def j1_interval_label_shuffled(spark, sf_dir):
    return _j1(spark, sf_dir, "shuffle")


J2_SQL = f"""with {SECTIONS_CTE}, cutoff as (select (max(section) * 15 + 17) // 18 as cut from sec)
select id, section, case when section <= cut then 'train' else 'test' end as side
from sec, cutoff where section > 0"""


@register("J2_section_membership", J2_SQL)
def j2_section_membership(spark, sf_dir):
    s = materialize(sectioned(spark, sf_dir).select("id", "section"))
    return split_by_membership(s, "section", *section_ranges(s.agg(F.max("section")).first()[0]))


P7_SQL = f"""with rec as ({RECORDS_SQL}), mm as (select min(pos) as mn, max(pos) as mx from rec)
select id, pos, -((pos - mn) - (mx - mn)) as tunnel_length from rec, mm"""


@register("P7_rebase_axis", P7_SQL)
def p7_rebase_axis(spark, sf_dir):
    return rebase_axis(records(spark, sf_dir).select("id", "pos"), "pos", "tunnel_length")


def _a6_sql(width: float) -> str:
    return f"""with rec as ({RECORDS_SQL}),
b as (select min(pos) as mn, max(pos) as mx from rec),
p as (select mn, (mn + {width}) - mn as dl, cast(ceil((mx - mn) / {width}) as bigint) - 1 as ncell from b),
x as (select rec.*, p.mn, p.dl, p.ncell, cast(floor((pos - p.mn) / p.dl) as bigint) as g from rec, p),
y as (select *, case when pos < mn + g * dl then g - 1 when pos >= mn + (g + 1) * dl then g + 1 else g end as cell
      from x),
c as (select cell, avg(value) as value, round_even(avg(cast(label as double)), 0) as label, count(*) as n_dp
      from y where cell >= 0 and cell < ncell group by cell),
g as (select unnest(range(ncell)) as cell, mn, dl from p)
select g.cell, g.mn + g.cell * g.dl as bin_start, g.mn + (g.cell + 1) * g.dl as bin_stop,
       round(c.value, 6) as value, c.label, coalesce(c.n_dp, 0) as n_dp
from g left join c on g.cell = c.cell"""


def _a6(spark, sf_dir, width):
    cells = grid_cells(records(spark, sf_dir), "pos", width, ["value"], "label")
    return cells.select("cell", "bin_start", "bin_stop", F.round("value", 6).alias("value"), "label", "n_dp")


@register("A6_grid_bins_3600s", _a6_sql(3600.0))
def a6_grid_bins_3600(spark, sf_dir):
    return _a6(spark, sf_dir, 3600.0)


@register("A6_grid_bins_60s", _a6_sql(60.0))
def a6_grid_bins_60(spark, sf_dir):
    return _a6(spark, sf_dir, 60.0)


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def _split_sources(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    kind = F.when(F.col("event_type").isin(*EVENT_TYPES), F.col("event_type")).otherwise("other")
    parts = []
    for t in (*EVENT_TYPES, "other"):
        part = ev.where(kind == t)
        if t == "click":
            part = part.drop("props")
        elif t == "view":
            part = part.drop("value")
        parts.append((t, part))
    return concat_sources(parts)


U1_SQL = """select event_id, user_id, event_type, case when event_type = 'view' then null else value end as value,
       case when event_type = 'click' then null else props end as props, case when event_type in
       ('click', 'error', 'purchase', 'signup', 'view') then event_type else 'other' end as source from events"""


@register("U1_union_sources", U1_SQL)
def u1_union_sources(spark, sf_dir):
    return _split_sources(spark, sf_dir)


@register("S2_concat_sources_count", f"with u as ({U1_SQL}) select source, count(*) as n, count(value) as n_value, "
          "count(props) as n_props from u group by source")
def s2_concat_sources_count(spark, sf_dir):
    u = _split_sources(spark, sf_dir)
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_value"),
                                   F.count("props").alias("n_props"))


@register("P3_choose_columns", "select l_orderkey, l_quantity, l_extendedprice, l_returnflag from lineitem")
def p3_choose_columns(spark, sf_dir):
    return C.choose_columns(read_table(spark, sf_dir, "lineitem"),
                            ["l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag"])


P4_SQL = """select o_orderkey, o_custkey, o_totalprice, o_orderstatus from orders
where o_orderkey is not null and o_custkey is not null and o_totalprice is not null and not isnan(o_totalprice)
  and o_orderstatus is not null"""


@register("P4_drop_missing", P4_SQL)
def p4_drop_missing(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return C.drop_missing(o)


P5_SQL = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice from (
  select *, row_number() over (partition by l_orderkey, l_linenumber
         order by l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) as rn from lineitem) t
where rn = 1"""


@register("P5_dedup_keep_first", P5_SQL)
def p5_dedup_keep_first(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    return C.dedup_first(li, ["l_orderkey", "l_linenumber"], order).drop("l_shipdate")


# Rename map of the stand-in: TPC-H columns -> machine-channel names.
RENAME = {"l_quantity": "penetration [mm/rev]", "l_extendedprice": "advance force [kN]",
          "l_discount": "torque [kNm]", "not_present": "ignored"}


@register("P6_rename", 'select l_orderkey, l_quantity as "penetration [mm/rev]", '
          'l_extendedprice as "advance force [kN]", l_discount + 0.0 as "torque [kNm]" from lineitem')
def p6_rename(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_extendedprice", (F.col("l_discount") + F.lit(0.0)).alias("l_discount"))
    return C.rename_columns(li, RENAME)


P9_SQL = """with t as (select l_orderkey, l_linenumber, l_discount * 1000.0 as torque,
  0.3::double * (tan(acos((241.3::double - l_quantity) / 241.3::double) / 2.0::double) * (l_extendedprice / 50.0::double))
    * 50.0::double * 7.0::double + 180.0::double as theo from lineitem)
select l_orderkey, l_linenumber, round(theo, 6) + 0.0 as theo_torque, round(torque / theo, 6) + 0.0 as torque_ratio
from t"""


@register("P9_torque_ratio", P9_SQL)
def p9_torque_ratio(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    theo, ratio = torque_ratio("l_extendedprice", "l_quantity", F.col("l_discount") * F.lit(1000.0))
    return li.select("l_orderkey", "l_linenumber", (F.round(theo, 6) + F.lit(0.0)).alias("theo_torque"),
                     (F.round(ratio, 6) + F.lit(0.0)).alias("torque_ratio"))


@register("P10_threshold_label", "select l_orderkey, l_linenumber, round(l_discount * 10.0, 6) + 0.0 as prob, "
          "cast(l_discount * 10.0 > 0.5 as integer) as pred_label from lineitem")
def p10_threshold_label(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").withColumn("prob", F.col("l_discount") * F.lit(10.0))
    return li.select("l_orderkey", "l_linenumber", (F.round("prob", 6) + F.lit(0.0)).alias("prob"),
                     prob_to_label("prob", 0.5).alias("pred_label"))


@register("P13_class_names", "select coalesce(case label when 0 then 'regular' when 1 then 'collapse' end, "
          "cast(label as varchar)) as class_name, count(*) as n from embeddings group by 1")
def p13_class_names(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return e.groupBy(class_name("label").alias("class_name")).agg(F.count(F.lit(1)).alias("n"))


MAD_CTE = """m as (select median(l_extendedprice) as med from lineitem),
md as (select median(abs(l_extendedprice - med)) as mad from lineitem, m),
sc as (select l_orderkey, l_linenumber, l_extendedprice,
       case when mad = 0 then (case when abs(l_extendedprice - med) = 0 then 0.0 else 'inf'::double end)
            else 0.6745 * abs(l_extendedprice - med) / mad end as score from lineitem, m, md)"""


@register("O1_mad_filter", f"with {MAD_CTE} select l_orderkey, l_linenumber, l_extendedprice from sc where score <= 3")
def o1_mad_filter(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return C.remove_outliers_mad(li, "l_extendedprice", 3.0)


@register("O3_outlier_share", f"with {MAD_CTE} select count(*) as n_total, count(*) filter (where score > 3) "
          "as n_outliers, round(count(*) filter (where score > 3) * 1.0 / count(*), 6) as outlier_share from sc")
def o3_outlier_share(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_extendedprice")
    scored, _, _ = C.mad_scores(li, "l_extendedprice")
    out = C.outlier_share(scored.withColumn("_o", (F.col("mad_score") > 3).cast("int")), "_o")
    return out.withColumn("outlier_share", F.round("outlier_share", 6))


def _clean_cfg():
    return CleanConfig(features=["value", "user_id"], label="label", pos="pos", tie="id",
                       outlier_feature="value", remove_outliers_uni=True, univariate_threshold=3.0)


O4_CTE = f"""{SECTIONS_CTE.replace('select id, pos, label, value,', 'select id, pos, label, value, user_id,')},
sel as (select id, pos, value, user_id, label, section from sec),
nn as (select * from sel where id is not null and pos is not null and not isnan(pos) and value is not null
       and not isnan(value) and user_id is not null and label is not null and section is not null),
dd as (select * exclude (rn) from (select *, row_number() over (partition by value, user_id order by pos, id) as rn
       from nn) t where rn = 1),
m as (select median(value) as med from dd),
md as (select median(abs(value - med)) as mad from dd, m),
mo as (select dd.* from dd, m, md where (case when mad = 0 then (case when abs(value - med) = 0 then 0.0
       else 'inf'::double end) else 0.6745 * abs(value - med) / mad end) <= 3)"""


@register("O4_clean_pipeline", f"with {O4_CTE} select * from mo")
def o4_clean_pipeline(spark, sf_dir):
    r = records(spark, sf_dir).select("id", "pos", "label", "value", "user_id")
    return clean(r, _clean_cfg())


P15_SQL = f"""with {O4_CTE}
select * from (values (0, 'loaded', null, (select count(*) from rec)),
  (1, 'selected', (select count(*) from rec), (select count(*) from sel)),
  (2, 'nulls_dropped', (select count(*) from sel), (select count(*) from nn)),
  (3, 'duplicates_dropped', (select count(*) from nn), (select count(*) from dd)),
  (4, 'univariate_outliers_dropped', (select count(*) from dd), (select count(*) from mo)))
  as t(stage, name, rows_in, rows_out)"""


@register("P15_stage_row_counts", P15_SQL)
def p15_stage_row_counts(spark, sf_dir):
    # Observed runs go through a sibling session: on Spark 4.1 a session whose
    # observation manager has been used can no longer serialise some ML
    # closures, so the caller's session stays untouched.
    obs_session = spark.newSession()
    r = records(obs_session, sf_dir).select("id", "pos", "label", "value", "user_id")
    counter = C.StageCounter()
    out = clean(r, _clean_cfg(), counter=counter)
    out.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(counter.rows(), "stage int, name string, rows_in bigint, rows_out bigint")


# --- readers over CSV files that Spark writes from the given tables, in the shared checkpoint folder ---

ORDER_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "priority_length"]


def _as_csv(df, name: str):
    """The path of ``df`` written as CSV with a header."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    write_dataset(df, path, "csv")
    return path


def _orders_csv(spark, sf_dir, blank_headers=False):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.length("o_orderpriority").alias("priority_length"))
    o = o.toDF(*[f" {c} " if blank_headers else c for c in o.columns])
    return read_csv(spark, _as_csv(o, "orders-csv"), o.schema)


CSV_SQL = "select o_orderkey, o_orderstatus, o_totalprice, cast(length(o_orderpriority) as integer) as priority_length from orders"


@register("S1_read_csv", CSV_SQL)
def s1_read_csv(spark, sf_dir):
    return _orders_csv(spark, sf_dir)


@register("S3_read_intervals", f"select interval_id, round(iv_start, 6) as iv_start, round(iv_end, 6) as iv_end from ({intervals_sql()}) t")
def s3_read_intervals(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    back = read_csv(spark, _as_csv(iv, "intervals-csv"), iv.schema)
    return back.select("interval_id", F.round("iv_start", 6).alias("iv_start"), F.round("iv_end", 6).alias("iv_end"))


@register("S4_load_features", "select o_orderkey, o_totalprice, cast(length(o_orderpriority) as integer) as priority_length, o_orderstatus from orders")
def s4_load_features(spark, sf_dir):
    return load_features(_orders_csv(spark, sf_dir, blank_headers=True), ["o_totalprice", "priority_length"], "o_orderstatus", ["o_orderkey"])


@register("S5_load_pair", f"""with a as ({SPLIT_SQL}) select a.side, a.o_orderkey, o.o_totalprice, a.o_orderstatus
from a join orders o using (o_orderkey)""")
def s5_load_pair(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select(*ORDER_COLUMNS[:3])
    split = materialize(stratified_split(o, "o_orderkey", "o_orderstatus", 0.33, 42))
    sides = []
    for side in ("train", "test"):
        part = split.where(F.col("side") == side).drop("side")
        back = read_csv(spark, _as_csv(part, f"{side}-csv"), part.schema)
        sides.append((side, load_features(back, ["o_totalprice"], "o_orderstatus", ["o_orderkey"])))
    return concat_sources(sides, "side")


@register("P12_class_subsets", f"""with {SECTIONS_CTE}
select id, section, label = 1 as in_class, section > 0 as in_section from sec where label <> 1 or section > 0""")
def p12_class_subsets(spark, sf_dir):
    s = sectioned(spark, sf_dir).select("id", "label", "section")
    flags = ["id", "section", (F.col("label") == 1).alias("in_class"), (F.col("section") > 0).alias("in_section")]
    return s.where((F.col("label") != 1) | (F.col("section") > 0)).select(*flags)
