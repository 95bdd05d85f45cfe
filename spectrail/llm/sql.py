"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_DECONTAMINATION = f"""
with bw as (select item_id, {_WORDS.format("lower(text)")} w from benchmark where item_id is not null and text is not null),
bs as (select distinct item_id, least(len(w), 5) m, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) s from bw where len(w) > 0),
bn as (select item_id, count(*) n_item from bs group by all),
dw as (select doc_id, {_WORDS.format("lower(text)")} w from documents where doc_id is not null and text is not null),
ds as (select distinct doc_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) s from dw, (select distinct m from bs) sizes where len(w) >= m),
hits as (select doc_id, item_id, count(*) n_shared from ds join bs using (m, s) group by all)
select doc_id, item_id, n_item, n_shared, n_shared / n_item as containment from hits join bn using (item_id) where 100 * n_shared >= 80 * n_item
"""

_LINE_DEDUP = """
with lines as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no from documents where doc_id is not null and text is not null),
tokens as (select doc_id, line_no, list_transform(list_filter(string_split(line, ' '), lambda t: t <> ''), lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) t from lines),
leafed as (select *, len(t) k, t[1] a, coalesce(t[2], '') b, coalesce(t[3], '') c, array_to_string(t, ' ') masked from tokens where len(t) >= 1),
leaves as (select k, a, b, c from leafed group by all having count(distinct doc_id) >= 10),
found as (select leafed.* from leafed join leaves using (k, a, b, c)),
counted as (select k, a, b, c, masked, count(distinct doc_id) n from found group by all),
common as (select k, a, b, c, arg_max(masked, (n, masked)) template from counted group by all),
compared as (select found.*, template, len(list_filter(range(1, k + 1), lambda i: t[i] = string_split(template, ' ')[i])) agree from found join common using (k, a, b, c)),
placed as (select k, a, b, c, doc_id, line_no, case when 100 * agree >= 75 * k then template else masked end template from compared),
recurring as (select k, a, b, c, template from placed group by all having count(distinct doc_id) >= 10),
dropped as (select distinct doc_id, line_no from placed join recurring using (k, a, b, c, template)),
kept as (select l.doc_id, count(d.line_no) n_dropped, string_agg(line, chr(10) order by l.line_no) filter (where d.line_no is null) kept_text, count(*) n_lines from lines l left join dropped d on l.doc_id = d.doc_id and l.line_no = d.line_no group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_dropped, 0) n_dropped, case when text is not null then sha256(coalesce(kept_text, '')) end kept_sha256 from documents d left join kept using (doc_id)
"""

_SUBSTRING_DEDUP = f"""
with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} w from documents),
g as (select doc_id, list_transform(range(1, len(w) - 18), lambda s: array_to_string(w[s:s + 19], ' ')) g from d where doc_id is not null and len(w) >= 20),
h as (select doc_id, unnest(g) k, generate_subscripts(g, 1) - 1 start from g),
f as (select k, min((doc_id, start)) first_place from h group by k having count(*) > 1),
r as (select doc_id, start from h join f using (k) where (doc_id, start) <> first_place),
gone as (select distinct doc_id, unnest(range(start, start + 20)) p from r),
u as (select doc_id, unnest(w) x, generate_subscripts(w, 1) - 1 p from d),
k as (select u.doc_id, count(gone.p) n_removed, string_agg(x, ' ' order by u.p) filter (where gone.p is null) kept from u left join gone on u.doc_id = gone.doc_id and u.p = gone.p group by 1)
select d.doc_id, len(w) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join k using (doc_id)
"""

#: Exact quantiles stand for the sketches, which are exact while a language has fewer rows than the sketches' k.
_QUALITY_RULES = f"""
with d as (select doc_id, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') t, {_WORDS.format("coalesce(text, '')")} w from documents),
l as (select doc_id, unnest(string_split(t, chr(10))) line from d),
n as (select doc_id, count(*) n_lines, count(*) - count(distinct line) n_dup_lines from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by 1),
gs as (select doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) g from d where len(w) >= 5),
g as (select doc_id, unnest(g) k, generate_subscripts(g, 1) p from gs),
r as (select doc_id, p from (select *, count(*) over (partition by doc_id, k) c from g) where c > 1),
c as (select doc_id, count(distinct q) n_repeat_words from (select doc_id, unnest(range(p, p + 5)) q from r) group by 1),
f as (select doc_id, lang, source, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols, coalesce(n_dup_lines, 0) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words, coalesce(n_lines, 0) n_lines, len(regexp_extract_all(t, '[A-ZÀ-Þ]')) n_upper, len(regexp_extract_all(t, '[A-Za-zÀ-ÿ]')) n_letters from d left join n using (doc_id) left join c using (doc_id)),
m as (select *, coalesce(n_symbols / nullif(n_words, 0), 0) m1, coalesce(word_chars / nullif(n_words, 0), 0) m2, coalesce(n_upper / nullif(n_letters, 0), 0) m3, coalesce(n_dup_lines / nullif(n_lines, 0), 0) m4, coalesce(n_repeat_words / nullif(n_words, 0), 0) m5 from f),
s as (select lang, source, count(*) n, {{quantiles}} from m group by all), b as (select lang, count(*) n, {{quantiles}} from m group by all), o as (select {{quantiles}} from m),
q as (select s.lang, s.source, case when s.n >= 100 then s.q1 when b.n >= 100 then b.q1 else o.q1 end q1, case when s.n >= 100 then s.q2 when b.n >= 100 then b.q2 else o.q2 end q2, case when s.n >= 100 then s.q3 when b.n >= 100 then b.q3 else o.q3 end q3, case when s.n >= 100 then s.q4 when b.n >= 100 then b.q4 else o.q4 end q4, case when s.n >= 100 then s.q5 when b.n >= 100 then b.q5 else o.q5 end q5 from s join b using (lang), o),
v as (select m.*, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed, m1 <= q1[1] + 6 * greatest(q1[1] - q1[2], 0.02) and m2 between q2[1] - 6 * greatest(q2[1] - q2[2], 0.25) and q2[1] + 6 * greatest(q2[1] - q2[2], 0.25) and m3 <= q3[1] + 6 * greatest(q3[1] - q3[2], 0.03) and m4 <= q4[1] + 6 * greatest(q4[1] - q4[2], 0.1) and m5 <= q5[1] + 6 * greatest(q5[1] - q5[2], 0.03) inside from m join q using (lang, source))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and inside kept from v
""".replace("{quantiles}", ", ".join(f"quantile_disc(m{k}, [0.5, 0.1]) q{k}" for k in range(1, 6)))

_LEXICAL_SEARCH = r"""
with w as (select rowid_, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from (select row_number() over () rowid_, * from documents where doc_id is not null)),
b as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark where item_id is not null),
n as (select rowid_, count(*) n from w group by all),
s as (select count(*) n_docs, sum(n)::bigint n_terms from n),
tf as (select rowid_, doc_id, term, count(*) tf from w where term in (select term from b) group by all),
df as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::bigint weight from tf, s group by term),
g as (select tf.rowid_, tf.doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) gain from tf join n using (rowid_) join df using (term), s),
r as (select item_id, doc_id, sum(gain)::bigint score from b join g using (term) group by item_id, rowid_, doc_id)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::integer "rank", doc_id, score from r where score > 0 qualify row_number() over (partition by item_id order by score desc, doc_id) <= 50
"""

_FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

#: The checksum bit by bit; trees, and the folding of leaves, a level a step.
_MERKLE = f"""
with recursive
d as (select *, coalesce('=' || source, '') tree, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) crc from documents),
l as (select doc_id, tree, {_LEAF.format(text="text")} leaf, case when xor(crc, 4294967295) % 2 = 0 then {_LEAF.format(text="replace(text, chr(10), '')")} else {_LEAF.format(text="text")} end later from d),
placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 idx, count(*) over (partition by tree) n from l),
nodes as (
  select tree, 0 height, idx, n, leaf h from placed
  union all
  select tree, height + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' order by idx)) from nodes where n > 1 group by tree, height, idx // 3, n),
tops as (select tree, height, h, row_number() over (order by tree) - 1 idx, count(*) over () n from nodes where n = 1),
upper as (
  select 0 height, idx, n, h from tops
  union all
  select height + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' order by idx)) from upper where n > 1 group by height, idx // 3, n),
root as (select h root from upper where n = 1),
whole as (
  select n.tree, n.height, n.idx, coalesce(string_agg(s.h, '' order by s.idx) filter (where s.idx < n.idx), '') lefts, coalesce(string_agg(s.h, '' order by s.idx) filter (where s.idx > n.idx), '') rights
  from nodes n join nodes s on n.tree = s.tree and n.height = s.height and n.idx // 3 = s.idx // 3 where n.n > 1 group by all
  union all
  select t.tree, t.height + n.height, t.idx // (3 ** n.height)::bigint, coalesce(string_agg(s.h, '' order by s.idx) filter (where s.idx < n.idx), ''), coalesce(string_agg(s.h, '' order by s.idx) filter (where s.idx > n.idx), '')
  from tops t join upper n on n.idx = t.idx // (3 ** n.height)::bigint join upper s on n.height = s.height and n.idx // 3 = s.idx // 3 where n.n > 1 group by all),
folded as (
  select doc_id, p.tree, t.height top_height, t.idx top_idx, leaf, p.idx, 0 height, '' proof, later h from placed p join tops t using (tree)
  union all
  select doc_id, f.tree, top_height, top_idx, leaf, f.idx, f.height + 1, proof || lefts || rights, sha256(lefts || h || rights)
  from folded f join whole w on f.tree = w.tree and f.height = w.height and w.idx = case when f.height < top_height then f.idx // (3 ** f.height)::bigint else top_idx // (3 ** (f.height - top_height))::bigint end)
select f.doc_id, f.leaf, t.h subroot, root, sha256(proof) proof_sha256, f.h folded_root, f.h = root verified
from folded f join tops t using (tree), root qualify f.height = max(f.height) over (partition by f.tree, f.doc_id, f.leaf, f.idx)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": _QUALITY_RULES,
    "op9_substring_dedup": _SUBSTRING_DEDUP,
    "op2_decontamination": _DECONTAMINATION,
    "op10_line_dedup": _LINE_DEDUP,
    "op11_lexical_search": _LEXICAL_SEARCH,
    "op12_merkle_manifest": _MERKLE,
}
