"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def low_words(column: str) -> str:
    return WORDS.replace("text", LOW.format(column), 1)


OP3 = f"""with d as (select doc_id, {WORDS} as ws from documents),
p as (select doc_id, ws, unnest(range(1, len(ws) - 48)) as s from d where len(ws) >= 50),
r as (select doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) as h from p),
f as (select h, min(doc_id) as first from r group by h),
hit as (select doc_id, s from r join f using (h) where first < doc_id),
gone as (select distinct doc_id, s + i as pos from hit, range(0, 50) t(i)),
g as (select doc_id, list(pos) as ats, count(*) as n, sum((prev is null or prev < pos - 1)::int) as spans from (select *, lag(pos) over (partition by doc_id order by pos) as prev from gone) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
  sha256(array_to_string(list_filter(ws, lambda w, i: ats is null or not list_contains(ats, i)), ' ')) as kept_sha256, coalesce(spans, 0)::bigint as n_spans
from d left join g using (doc_id)"""


def place(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 7))::bigint"


OP4 = f"""with d as (select doc_id, source, len({WORDS})::bigint as size, {place("doc_id::varchar || '/0'")} as place from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5, 2, 1][((row_number() over (order by source nulls last)) - 1) % 3 + 1] as weight, 2.0::double * source_size as lim from s),
r as (select *, lim / weight as ratio from w),
l as (select *, row_number() over (order by ratio, source nulls last) as rn, 1.5::double * sum(source_size) over () as total,
  coalesce(sum(lim) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0) as capped,
  sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as rest from r),
v as (select arg_min((total - capped) / rest, rn) as level from l where (total - capped) / rest <= ratio),
t as (select source, source_size, least(lim, coalesce(level * weight, lim)) as target, ({place("'offset/' || coalesce(source, chr(0)) || '/0'")} % 1024 + 0.5::double) / 1024 as off from l, v),
k as (select *, row_number() over (partition by source order by length(bin(size)), place, doc_id::varchar, size) as rank from d),
j as (select k.doc_id, k.size, t.source_size, t.target, off, rank, coalesce(target / nullif(source_size, 0), 0) as e from k join t on k.source is not distinct from t.source)
select doc_id, size, source_size, target, (floor(off + rank * e) - floor(off + (rank - 1) * e))::bigint as copies, (floor(off + rank * e) - floor(off + (rank - 1) * e))::bigint * size as taken from j"""


def shingles(table: str, key: str, size: int) -> str:
    """(key, sh): distinct shingles; fewer words make one."""
    return f"""(select distinct {key}, array_to_string(ws[s:s + {size - 1}], ' ') as sh from (select {key}, ws, unnest(range(1, greatest(len(ws) - {size - 2}, 2))) as s
      from (select {key}, {low_words("text")} as ws from {table}) where len(ws) > 0))"""


OP6 = f"""with recursive sh as {shingles("documents", "doc_id", 4)},
n as (select doc_id, count(*) as n from sh group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as k from sh a join sh b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
l as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= 85 * (p.n + q.n - k)),
e as (select x, y from l union select y, x from l),
reach as (select x, y from e union select r.x, e.y from reach r join e on r.y = e.x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.first, d.doc_id)) as component_id
from documents d left join n using (doc_id) left join (select x, min(y) as first from reach group by x) m on m.x = d.doc_id"""

OP7 = f"""with sh as {shingles("documents", "doc_id", 5)}, it as {shingles("benchmark", "item_id", 5)},
n as (select item_id, count(*) as n from it group by item_id),
c as (select doc_id, item_id, count(*) as k from sh join it using (sh) group by all),
f as (select doc_id, item_id, k / n as share from c join n using (item_id) where k >= 0.8 * n),
g as (select doc_id, list(item_id order by item_id) as item_ids, max(share) as containment, count(*) as n_items from f group by doc_id)
select d.doc_id, n_items is not null as contaminated, coalesce(n_items, 0)::bigint as n_items, coalesce(item_ids, []::bigint[]) as item_ids, coalesce(containment, 0)::double as containment
from documents d left join g using (doc_id)"""

def _op1() -> str:
    from contextloom.llm.quality import CHAR_BINS, CLASSES, QualityRules

    rules = QualityRules()
    langs = sorted(rules.common_words)
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    counts = ", ".join(f"list_transform({quoted(rules.common_words[x])}, lambda w: len(list_filter(ws, lambda v: v = w)))::bigint[] as own_{x}" for x in langs)
    full = ", ".join(f"list_append(own_{x}, n_words - list_sum(own_{x})::bigint) as q_{x}" for x in langs)
    kinds = ", ".join("len(regexp_replace(odd, '[^" + c.replace("'", "''") + "]+', '', 'g'))" + f" as k_{n}" for n, c in CLASSES.items())
    known = " + ".join(f"k_{n}" for n in CLASSES)
    bins = "[spaces, " + ", ".join(f"k_{n}" + " + word_chars - len(odd)" * (n == "lower") for n in CLASSES) + f", len(odd) - ({known})]::bigint[]"
    assert len(CHAR_BINS) == 2 + len(CLASSES)

    def shares(name: str, column: str, lang: str) -> str:
        rows = f"select generate_subscripts({column}, 1) as i, unnest({column}) as v from m where lang = '{lang}' and n_words >= {rules.guard_words}"
        return f"{name} as (select list(s / greatest(1, z) order by i) as h from (select i, sum(v) as s, sum(sum(v)) over () as z from ({rows}) group by i))"

    f = lambda x: f"({x}) * log2(greatest({x}, 1e-300))"
    refs = ",\n".join(shares(f"{k}_{x}", c, x) for x in langs for k, c in (("rc", "chars"), ("rw", f"q_{x}")))

    def js(column: str, total: str, ref: str) -> str:
        p, q = f"(z[1] / {total})", "z[2]"
        part = f"({f(p)}) / 2 + ({f(q)}) / 2 - {f(f'({p} + {q}) / 2')}"
        return f"case when {total} > 0 then round(sqrt(greatest(list_sum(list_transform(list_zip({column}, (select h from {ref})), lambda z: {part})), 0)), 6) end"

    each = " union all ".join(f"select doc_id, '{x}' as near_lang, {js('chars', 'size', f'rc_{x}')} as js_chars, {js(f'q_{x}', 'n_words', f'rw_{x}')} as js_words from m where (select h from rc_{x}) is not null" for x in langs)
    fits = lambda c, most, n, guard: f"({n} < {guard} or {c} is null or {c} <= {most})"
    return f"""with d as (select doc_id, lang, coalesce(text, '') as t, {WORDS} as ws from documents),
a as (select *, len(ws)::bigint as n_words, len(array_to_string(ws, ''))::bigint as word_chars, regexp_replace(t, '[a-z\\x20\\x09-\\x0D]+', '', 'g') as odd,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
b as (select *, len(regexp_replace(odd, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(t) - word_chars as spaces, {kinds}, {counts} from a),
m as (select *, {bins} as chars, len(t) as size, {full} from b),
w as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from d where len(ws) > 2)),
x as (select doc_id, i from w qualify count(*) over (partition by doc_id, g) > 1),
r as (select doc_id, count(distinct i + j)::bigint as n_repeat_words from x, range(0, 3) o(j) group by doc_id),
{refs},
e as ({each}),
n as (select * from e qualify row_number() over (partition by doc_id order by coalesce(js_chars, 1) + coalesce(js_words, 1), near_lang) = 1),
o as (select m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, near_lang, js_chars, js_words, size from m left join r using (doc_id) left join n using (doc_id)),
z as (select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words as base_failed from o)
select * exclude (size), not base_failed and {fits("js_chars", rules.max_js_chars, "size", rules.guard_chars)} and {fits("js_words", rules.max_js_words, "n_words", rules.guard_words)} as kept from z"""


OP1 = _op1()

SQL = {
    "op1_quality_divergence": OP1,
    "op3_substring_factors": OP3,
    "op4_mix_systematic": OP4,
    "op6_ngram_jaccard": OP6,
    "op7_decontaminate": OP7,
}
