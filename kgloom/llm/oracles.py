"""SQL for the operators that SQL can express, for DuckDB over the given tables."""

from kgloom.llm import licenses, quality_rules

_WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_stops = ", ".join(f"'{w}'" for w in sorted({w for x in quality_rules.STOP_WORDS for w in x.split()}))
_marks = "'" + quality_rules.MARKS.replace("'", "''") + "'"
_values = {
    "n_words": "n_words",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "letter_ratio": "n_letters / greatest(word_chars, 1)",
    "stop_word_ratio": "n_stop / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "ellipsis_line_ratio": "n_ellipsis / greatest(n_lines, 1)",
    "repeat_word_ratio": "n_repeat_words / greatest(n_words, 1)",
}
_broken = ", ".join(f"case when not ({_values[k]} between {lo} and {hi}) then '{k}' end" for k, lo, hi in quality_rules.RULES)

OP1 = rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(regexp_split_to_array(trim(text, {_WS}), '[ \t-\r]+'), lambda x: x <> '') as ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) as ls from d),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
r as (select g.doc_id, g.i from g join (select doc_id, g from g group by 1, 2 having count(*) > 1) using (doc_id, g)),
c as (select doc_id, count(distinct i + k) as n from r cross join (values (0), (1), (2)) v(k) group by 1),
m as (select doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars, cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words, len(ls) as n_lines, length(regexp_replace(array_to_string(ws, ''), '[^\p{{L}}]', '', 'g')) as n_letters,
  len(list_filter(ws, lambda x: lower(trim(x, {_marks})) in ({_stops}))) as n_stop, len(list_filter(ls, lambda x: regexp_matches(trim(x, {_WS}), '([.][.][.]|…)$'))) as n_ellipsis from w left join c using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, list_filter([{_broken}], lambda x: x is not null) as broken from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(array_to_string(broken, ','), '') as failed_rules, not base_failed and len(broken) = 0 as kept from f"""

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_words = lambda t: f"list_filter(regexp_split_to_array({_AZ.format(f'coalesce({t}, {chr(39)}{chr(39)})')}, '{_BETWEEN}'), lambda x: x <> '')"

OP5 = rf"""
with d as (select doc_id, {_words("text")} as ws from documents), b as (select cast(item_id as varchar) as item_id, {_words("text")} as ws from benchmark where item_id is not null),
bw as (select distinct item_id, len(ws[i:i + 12]) as n, array_to_string(ws[i:i + 12], ' ') as g from (select item_id, ws, unnest(range(1, greatest(len(ws) - 11, 2))) as i from b where len(ws) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') as g from (select doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) as i from d cross join sizes where len(ws) >= n)),
hits as (select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.g = bw.g),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hits)) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hits) group by 1)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join places using (doc_id) left join items using (doc_id)"""

_sets = ", ".join(f"({i}, '{label}', [{', '.join(repr(w) for w in sorted(set(t.split())))}])" for i, (label, t) in enumerate(licenses.TEMPLATES))

OP9 = rf"""
with d as (select doc_id, {_words("text")} as ws, text from documents),
p as (select doc_id, i - 1 as place, 'mit' as label from (select doc_id, ws, unnest(range(1, len(ws))) as i from d) where ws[i] = 'mit' and ws[i + 1] = 'license' union all
  select doc_id, i - 1, 'apache' from (select doc_id, ws, unnest(range(1, len(ws))) as i from d) where ws[i] = 'apache' and ws[i + 1] = 'license' union all
  select doc_id, i - 1, 'gpl' from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from d) where ws[i] = 'general' and ws[i + 1] = 'public' and ws[i + 2] = 'license'),
base as (select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word, string_agg(distinct label, ',' order by label) as base_labels from p group by 1),
t(k, label, ts) as (values {_sets}),
blocks as (select doc_id, {_words("b")} as ws from (select doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\n[ \t\r]*\n')) as b from documents)),
met as (select doc_id, t.label, len(list_filter(ts, lambda x: list_contains(ws, x))) / len(ts) as c from blocks cross join t where len(list_filter(ts, lambda x: list_contains(ws, x))) >= ceil(0.8 * len(ts))),
labels as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from p union all select doc_id, label from met) group by 1),
best as (select doc_id, max(c) as c from met group by 1)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, case when n_base > 0 then 1.0 else coalesce(c, 0.0) end as score
from d left join base using (doc_id) left join labels using (doc_id) left join best using (doc_id)"""

OP12 = rf"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_AZ.format("text")}, '[.,;:!?\x0A-\x0D]')) as piece from documents where text is not null),
w as (select row_number() over () as id, lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as ws from p),
t as (select lang, ws[i] as w1, ws[i + 1] as w2, ws[i + 2] as w3 from (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w)),
f1 as materialized (select lang, w1, count(*) as n from t group by 1, 2),
f2 as materialized (select lang, w1, w2, count(*) as a from t where w2 is not null group by 1, 2, 3 having count(*) >= 10),
f3 as materialized (select lang, w1, w2, w3, count(*) as a from t where w3 is not null group by 1, 2, 3, 4 having count(*) >= 10),
n as (select lang, cast(sum(n) as bigint) as n from f1 group by 1),
s as (select f2.lang, f2.w1 || ' ' || f2.w2 as phrase, f2.a, 1 as cut, x.n as l, y.n as r from f2 join f1 x using (lang, w1) join f1 y on y.lang = f2.lang and y.w1 = f2.w2
  left join (select lang, w1, w2, max(a) as most from (select lang, w1, w2, a from f3 union all select lang, w2, w3, a from f3) group by 1, 2, 3) m on m.lang = f2.lang and m.w1 = f2.w1 and m.w2 = f2.w2 where most is null or 100 * most < 50 * f2.a
  union all select f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.a, 1, x.n, y.a from f3 join f1 x using (lang, w1) join f2 y on y.lang = f3.lang and y.w1 = f3.w2 and y.w2 = f3.w3
  union all select f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.a, 2, x.a, y.n from f3 join f2 x using (lang, w1, w2) join f1 y on y.lang = f3.lang and y.w1 = f3.w3),
c as (select *, cast(1000000::hugeint * a * a // (l::hugeint * r) as bigint) as score from s),
b as (select * from c qualify row_number() over (partition by lang, phrase order by score, cut) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n.n as n, score from b join n using (lang) qualify rank <= 2000"""

OP13 = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_inner_product(cast(a.q as double[]), cast(b.q as double[])) as bigint) as score from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, other_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
n as (select p.*, other_id as negative_id, score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id) as rank from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 5"""

ORACLE_SQL = {"op13_hard_negatives": OP13, "op1_quality_rules": OP1, "op5_benchmark_decontamination": OP5, "op9_license_scans": OP9, "op12_phrase_collocations": OP12}
