"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from seqlab.llm import decontaminate, license_scan, line_dedup, merkle, mixing, quality_ordinal, quality_rules, repair, scaled_sketch, secret_scan, sharding, simhash, span_dedup
from seqlab.llm.common import load

QUERIES = {
    "op1_benchmark_decontamination": lambda s, d: decontaminate.op1_benchmark_decontamination(load(s, d, "documents"), load(s, d, "benchmark")),
    "op2_simhash_near_dedup": lambda s, d: simhash.op2_simhash_near_dedup(load(s, d, "documents")),
    "op3_line_dedup": lambda s, d: line_dedup.op3_line_dedup(load(s, d, "documents")),
    "op4_secret_scan": lambda s, d: secret_scan.op4_secret_scan(load(s, d, "documents")),
    "op5_quality_ordinal": lambda s, d: quality_ordinal.op5_quality_ordinal(load(s, d, "documents"), load(s, d, "labels")),
    "op6_quality_rules": lambda s, d: quality_rules.op6_quality_rules(load(s, d, "documents")),
    "op7_substring_dedup": lambda s, d: span_dedup.op7_substring_dedup(load(s, d, "documents")),
    "op8_sharding": lambda s, d: sharding.op8_sharding(load(s, d, "documents")),
    "op9_mixing": lambda s, d: mixing.op9_mixing(load(s, d, "documents")),
    "op10_licence_scan": lambda s, d: license_scan.op10_licence_scan(load(s, d, "documents")),
    "op11_document_fingerprints": lambda s, d: scaled_sketch.op11_document_fingerprints(load(s, d, "documents")),
    "op12_conversation_repair": lambda s, d: repair.op12_conversation_repair(load(s, d, "conversations")),
    "op13_merkle_manifest": lambda s, d: merkle.op13_merkle_manifest(load(s, d, "documents")),
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""with d as (select doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') as ws from documents),
i as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWER}, '{_ALNUM}') as ws from benchmark),
win as (select distinct item, least(13, len(ws)) as k, array_to_string(ws[p:p + least(13, len(ws)) - 1], ' ') as w
        from i, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) as t(p) where len(ws) > 0),
dw as (select doc_id, k, p, array_to_string(ws[p:p + k - 1], ' ') as w
       from d, (select distinct k from win), unnest(range(1, len(ws) - k + 2)) as t(p)),
hit as (select doc_id, p, k, item from dw join win using (k, w)),
cover as (select doc_id, count(distinct x) as n_hit from hit, unnest(range(p, p + k)) as t(x) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
        from (select distinct doc_id, item from hit) group by doc_id)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join cover using (doc_id) left join its using (doc_id)"""


def _op6() -> str:
    from seqlab.llm.quality_rules import MIN_GROUP, RULES, SPREAD

    disc = ", ".join(f"quantile_disc({r}, 0.25) as {k}_a, quantile_disc({r}, 0.75) as {k}_b" for k, (r, _) in RULES.items())
    inside = " and ".join(
        f"({r}) between {k}_1 - {SPREAD} * greatest({k}_3 - {k}_1, {least}) and {k}_3 + {SPREAD} * greatest({k}_3 - {k}_1, {least})"
        for k, (r, least) in RULES.items())
    pick = ", ".join(f"case when g.n >= {MIN_GROUP} then g.{k}_{x} else a.{k}_{x} end as {k}_{y}" for k in RULES for x, y in (("a", 1), ("b", 3)))
    return rf"""with t as (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as lines from documents),
w as (select doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] as g from t, unnest(range(1, len(ws) - 1)) as u(p)),
r as (select doc_id, count(distinct x) as n from (select doc_id, p, count(*) over (partition by doc_id, g) as c from w),
      unnest([p, p + 1, p + 2]) as u(x) where c > 1 group by doc_id),
m as (select doc_id, lang, source, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
      coalesce(r.n, 0) as n_repeat_words, len(lines) as n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_upper
      from t left join r using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
a as (select {disc} from b where not base_failed),
g as (select lang, source, count(*) as n, {disc} from b where not base_failed group by lang, source),
f as (select g.lang, g.source, {pick} from g, a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       case when base_failed then false else coalesce({inside}, false) end as kept
from b left join f on b.lang is not distinct from f.lang and b.source is not distinct from f.source"""


def _op11() -> str:
    from seqlab.llm.scaled_sketch import DIGITS, SCALE, SHINGLE, bound

    def sketch(text: str) -> str:
        words = f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}')"
        return f"""select doc_id, case when len(low) > 0 then list_sort(list_distinct(low)) when len(h) > 0 then [list_min(h)] else [] end as s
  from (select doc_id, h, list_filter(h, lambda x: x < '{bound(SCALE)}') as low from (select doc_id, list_transform(
    case when len(w) = 0 then [] when len(w) < {SHINGLE} then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) end,
    lambda x: left(md5(x), {DIGITS})) as h from (select doc_id, {words} as w from e)))"""

    near = lambda a, b: (f"case when len({a}) = 0 and len({b}) = 0 then 1::double when len({a}) = 0 then 0::double "  # noqa: E731
                         f"else len(list_intersect({a}, {b}))::double / len({a}) end")
    return f"""with t as (select doc_id, coalesce(text, '') as text, lead(doc_id) over (order by doc_id) as nx, lead(coalesce(text, ''))
  over (order by doc_id) as nt, first_value(doc_id) over (order by doc_id) as f, first_value(coalesce(text, '')) over (order by doc_id) as ft
  from documents),
e as (select doc_id, text, coalesce(nx, f) as next_id, left(text, length(text) - length(text) // 2)
  || left(case when nx is null then ft else nt end, length(text) // 2) as edited from t),
a as ({sketch("text")}),
b as ({sketch("edited")})
select e.doc_id, length(text) as n_chars, sha256(edited) as edited_sha256, array_to_string(a.s, ',') as fingerprint,
  array_to_string(b.s, ',') as edited_fingerprint, {near("a.s", "b.s")} as near_edited, {near("a.s", "n.s")} as near_next
from e join a using (doc_id) join b using (doc_id) join a n on n.doc_id = e.next_id"""


#: CRC-32 of an ASCII string x, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length({x}) + 1),
  lambda i: ascii(substring({x}, i, 1))::bigint)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
  lambda r, z: case when r % 2 = 1 then xor(r // 2, 3988292384) else r // 2 end)))"""


def _op13() -> str:
    def leaf(more: str) -> str:
        values = ["doc_id::varchar", "source", "lang", f"(n_chars::hugeint{more})::varchar", "text"]
        return "sha256(concat(" + ", ".join(f"coalesce(strlen({v})::varchar || ':' || {v}, '-')" for v in values) + "))"

    grow = """select tree, level + 1, idx // 2, sha256(string_agg(h, '' order by idx)), (any_value(n) + 1) // 2
  from {t} where n > 1 group by tree, level, idx // 2"""
    # Node idx >> level is a leaf's ancestor; its run's other node, if any, is the sibling.
    fold = """list_reduce(list_prepend({x}, coalesce(p, [])), lambda h, s: sha256(case when s = '-' then h when s[1] = 'L' then s[2:] || h else h || s[2:] end))"""
    return f"""with recursive lv as (select doc_id, coalesce('=' || lang, '') as tree, {leaf("")} as leaf, {leaf(" + 1")} as more,
  {_CRC32.format(x="doc_id::varchar")} % 7 = 0 as hit from documents),
leaves as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx from lv),
low as (select tree, 0 as level, idx, leaf as h, count(*) over (partition by tree) as n from leaves union all {grow.format(t="low")}),
subs as (select tree, h as subroot, row_number() over (order by tree) - 1 as idx from low where n = 1),
high as (select '' as tree, 0 as level, idx, subroot as h, count(*) over () as n from subs union all {grow.format(t="high")}),
steps as (select l.doc_id, l.tree, l.idx, 0 as part, a.level, case when s.h is null then '-' when s.idx < a.idx then 'L' || s.h else 'R' || s.h end as step
  from leaves l join low a on a.tree = l.tree and a.n > 1 and a.idx = l.idx >> a.level
  left join low s on s.tree = a.tree and s.level = a.level and s.idx = xor(a.idx, 1)
  union all select l.doc_id, l.tree, l.idx, 1, a.level, case when s.h is null then '-' when s.idx < a.idx then 'L' || s.h else 'R' || s.h end
  from leaves l join subs u using (tree) join high a on a.n > 1 and a.idx = u.idx >> a.level
  left join high s on s.level = a.level and s.idx = xor(a.idx, 1)),
ways as (select tree, idx, list(step order by part, level) as p from steps group by tree, idx),
folded as (select l.doc_id, leaf, subroot, (select h from high where n = 1) as root, p,
  {fold.format(x="case when hit then more else leaf end")} as folded_root from leaves l join subs using (tree) left join ways w on w.tree = l.tree and w.idx = l.idx)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(coalesce(p, []), lambda s: s[2:]), '')) as proof_sha256, folded_root,
  folded_root = root as verified from folded"""


#: SQL cannot express the others (XXH64, seeded draws, trained models); tests/llm holds them against plain Python.
ORACLE: dict[str, str] = {"op1_benchmark_decontamination": OP1, "op6_quality_rules": _op6(), "op11_document_fingerprints": _op11(), "op13_merkle_manifest": _op13()}
