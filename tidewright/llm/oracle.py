"""DuckDB SQL of the operators that SQL can express, from their definitions rather than their methods."""

from __future__ import annotations

from tidewright.llm import url_templates as U
from tidewright.llm.quality_rules import CUTOFFS, STRATA, Risk

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rules() -> str:
    """Counts, exact binomial certification of every (stratum, rule, cutoff) and the resulting verdicts."""
    risk = Risk()
    tests = [(r, c) for r, cs in CUTOFFS.items() for c in cs]
    rate, level = risk.false_rejection / len(CUTOFFS), risk.delta / ((len(STRATA) + 1) * len(tests))
    grid = ", ".join(f"('{r}', {c}::double)" for r, c in tests)
    value = "case rule when 'symbols' then n_symbols / greatest(word_chars, 1) when 'dup_lines' then n_dup_lines / greatest(n_lines, 1) when 'repeats' then n_repeat_words / greatest(n_words, 1) when 'long_words' then word_chars / greatest(n_words, 1) else n_words / greatest(word_chars, 1) end"
    strata = ", ".join(f"'{s}'" for s in STRATA)
    return rf"""
with t as (select row_number() over () r, doc_id, coalesce(text, '') text, case when lang in ({strata}) then lang else 'other' end stratum from documents),
w as (select r, doc_id, stratum, text, regexp_extract_all(text, '{_WORD}') words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines from t),
win as (select r, i, array_to_string(words[i:i+7], ' ') g from w, (select unnest(range(1, (select greatest(max(len(words)), 1) from w) + 1)) i) where i + 7 <= len(words)),
rep as (select r, i from win qualify count(*) over (partition by r, g) > 1),
cov as (select r, count(distinct p) n from (select r, unnest(range(i, i + 8)) p from rep) group by 1),
c as (select w.r, doc_id, stratum, text, len(words)::bigint n_words, length(array_to_string(words, ''))::bigint word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint n_symbols, (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, coalesce(cov.n, 0)::bigint n_repeat_words, len(lines) n_lines from w left join cov on cov.r = w.r),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from c),
l as (select doc_id, min(quality) q from labels where doc_id is not null and quality is not null group by 1),
h1 as (select f.*, q from f join l using (doc_id) where not base_failed qualify row_number() over (partition by doc_id order by text, stratum) = 1),
h as (select * from h1 qualify row_number() over (partition by stratum, text order by q) = 1),
grid(rule, cutoff) as (values {grid}),
tested as (select stratum, rule, cutoff, count(*) filter (where q = 1) n, count(*) filter (where q = 1 and ({value}) >= cutoff) k, count(*) filter (where q = 0 and ({value}) >= cutoff) bad from h, grid group by 1, 2, 3),
certified as (select * from tested where bad > k and k < n * {rate} and list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate}) + (n - i) * ln(1 - {rate})))) <= {level!r}),
chosen as (select stratum, rule, cutoff from certified qualify row_number() over (partition by stratum, rule order by bad - k desc, cutoff desc) = 1),
rejected as (select distinct r from f join chosen using (stratum) where ({value}) >= cutoff)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and r not in (select r from rejected) as kept from f"""


_COMPONENTS = "reach(id, root) as (select id, id from nodes union select links.b, reach.root from reach join links on links.a = reach.id where reach.root < links.b)"

_JACCARD = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') t from documents),
s as (select doc_id, case when len(t) = 0 then [] when len(t) < 5 then [array_to_string(t, ' ')] else list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' '))) end s from w),
sets as (select min(doc_id) id, s, len(s) n from (select doc_id, list_sort(s) s from s) group by s having len(s) > 0),
x as (select id, n, unnest(s) g from sets),
pairs as (select p.id a, q.id b from x p join x q on p.g = q.g and p.id < q.id group by p.id, q.id, p.n, q.n having 100 * count(*) >= 75 * (p.n + q.n - count(*))),
links as (select a, b from pairs union all select b, a from pairs),
nodes as (select distinct a id from links),
{_COMPONENTS},
roots as (select id, min(root) root from reach group by 1),
same as (select d.doc_id, len(d.s) n, sets.id from s d left join sets on sets.s = list_sort(d.s))
select doc_id, n::bigint as n_shingles, coalesce(root, same.id, doc_id) as component_id from same left join roots on roots.id = same.id"""

_EMBEDDINGS = f"""
with recursive v as (select vec_id, embedding::double[] e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select p.vec_id a, q.vec_id b from v p join v q on p.vec_id <> q.vec_id and len(p.e) = len(q.e) where list_cosine_similarity(p.e, q.e) >= 0.95),
nodes as (select distinct a id from links),
{_COMPONENTS},
roots as (select id, min(root) root from reach group by 1),
n as (select a, count(*) n from links group by 1)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(root, vec_id) as component_id, coalesce(root, vec_id) = vec_id as kept from embeddings left join n on a = vec_id left join roots on roots.id = vec_id"""


def _urls() -> str:
    """The template tree level by level, the purity of merged siblings, and the stated rules, longest first."""
    fits = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then ['{h + p}', '{v}']" for v, h, p in sorted(U.RULES, key=lambda r: -len(r[1] + r[2])))
    levels = ""
    for n in range(U.DEPTH):
        levels += f"""
c{n} as (select prefix, s[{n + 1}] g, count(*) n from l{n} where len(s) > {n} group by 1, 2),
w{n} as (select prefix from c{n} group by 1 having count(*) > {U.FEW_VALUES} and sum(n) < {U.REPEAT} * count(*)),
l{n + 1} as (select page_id, host, path, s, case when len(s) > {n} then prefix else parent end parent, case when len(s) > {n} then prefix || '/' || case when prefix in (select prefix from w{n}) then '*' else s[{n + 1}] end else prefix end prefix from l{n}),"""
    return rf"""
with p as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path from pages),
q as (select *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: case when regexp_matches(x, '[0-9]') then '*' else x end) s from p),
l0 as (select page_id, host, path, case when len(s) > {U.DEPTH} then s[1:{U.DEPTH}] || ['**'] else s end s, host parent, host prefix from q),{levels}
t as (select page_id, host, path, parent, prefix || case when len(s) > {U.DEPTH} then '/**' else '' end template from l{U.DEPTH}),
lab as (select page_id, max(coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1) bad from p join labels on doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})[^/]*/?$', 1), '') as bigint) group by 1),
b as (select parent, template, count(bad) n, count(*) filter (where bad) k from t left join lab using (page_id) group by 1, 2),
pool as (select parent, sum(n) pn, sum(k) pk from b group by 1),
m as (select parent, template, n, k, pn, pk, pk / greatest(pn, 1) r, (select sum(k) / greatest(sum(n), 1) from b) rate from b join pool using (parent)),
x as (select *, abs(k - n * r) > {U.Z_MERGE} * sqrt(greatest(n * r * (1 - r), 0.25)) alone from m),
bad as (select parent, template from x where ((case when alone then k else pk end) + {U.PRIOR} * coalesce(rate, 0)) / ((case when alone then n else pn end) + {U.PRIOR}) >= {U.PURITY}),
v as (select t.*, case {fits} end choice, (parent, template) in (select (parent, template) from bad) rejected from t)
select page_id, host, path, choice[1] as rule, coalesce(choice[2], case when rejected then 'block' else 'allow' end) as verdict from v"""


ORACLE_SQL = {"op4_url_templates": _urls(), "op2_quality_rules": _rules(), "op3_jaccard_join": _JACCARD, "op9_embedding_dedup": _EMBEDDINGS}
