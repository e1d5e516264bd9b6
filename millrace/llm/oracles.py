"""DuckDB SQL for the queries that SQL can express."""

W = r"[^\x20\x09-\x0D]+"

OP9 = r"""
with d as (
  select doc_id, coalesce(text, '') t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) s from documents
), g as (
  select *, first_value(doc_id) over w keep_id, row_number() over w r, count(*) over (partition by s) n from d
  window w as (partition by s order by length(t) desc, doc_id)
)
select doc_id, keep_id, n::bigint group_size, r = 1 kept, s text_sha256 from g
"""

OP5 = rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{W}'))::bigint size, md5('mix-' || doc_id::varchar) h from documents
), s as (
  select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) r from d group by source
), w as (
  select *, ([3, 1, 2])[((r - 1) % 3 + 1)::int]::bigint w, sum(source_size) over ()::bigint total from s
), e as (
  select *, sum(w) over ()::bigint all_w,
    coalesce(sum(source_size) over (order by source_size / w, r rows between unbounded preceding and 1 preceding), 0)::bigint size_before,
    coalesce(sum(w) over (order by source_size / w, r rows between unbounded preceding and 1 preceding), 0)::bigint w_before
  from w
), f as (
  select *, (3 * total - 4 * size_before) * w > 4 * source_size * (all_w - w_before) full_up from e
), k as (
  select *, coalesce(sum(source_size) filter (full_up) over (), 0)::bigint held, sum(w) filter (not full_up) over ()::bigint free from f
), t as (
  select source, source_size,
    case when full_up then (2 * source_size)::double else (w * (3 * total - 4 * held))::double / (2 * free)::double end target from k
), p as (
  select *, (case when source_size = 0 then 0 else floor(target / source_size) end)::bigint passes from t
), q as (
  select source, count(*) n from d group by source
), x as (
  select d.doc_id, d.size, d.h, p.source, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size rest,
    (d.size + 1) * 64 > p.source_size + q.n large, least(20000, greatest(1, (p.source_size + q.n) // 256)) length
  from d join p on d.source is not distinct from p.source join q on d.source is not distinct from q.source
), y as (
  select *, case when large then row_number() over w - 1
    else coalesce(sum(size + 1) over (w rows between unbounded preceding and 1 preceding), 0)::bigint // length end block
  from x window w as (partition by source, large order by h, size)
), b as (
  select source, large, block, sum(size)::bigint words, any_value(source_size) source_size, any_value(target) target, any_value(passes) passes, any_value(rest) rest
  from y group by source, large, block
), l as (
  select *, coalesce(sum(words) over (partition by source, large order by block rows between unbounded preceding and 1 preceding), 0)::bigint before,
    coalesce(sum(words) filter (large) over (partition by source), 0)::bigint large_size from b
), e1 as (
  select *, case when large and passes < 2 and (2 * before + words) * source_size <= 2 * rest * large_size then 1 else 0 end extra from l
), e2 as (
  select *, sum(extra * words) over (partition by source) spent from e1
), e3 as (
  select *, passes + (case when not large and passes < 2 and 2 * before + words <= 2 * (rest - spent) then 1 else extra end) n from e2
), z as (
  select *, target - sum(n * words) over (partition by source) gap from e3
), m as (
  select *, abs(abs(gap) - words) off_by, (case when gap > 0 then n < 2 else n > 0 end) and abs(abs(gap) - words) < abs(gap) helps from z
), o as (
  select *, row_number() over (partition by source, helps order by off_by, large, block) i from m
)
select y.doc_id, y.size, y.source_size, y.target, ((n + case when helps and i = 1 then sign(gap) else 0 end) * y.size)::bigint taken
from y join o on y.source is not distinct from o.source and y.large = o.large and y.block = o.block
"""

OP2 = rf"""
with d as (
  select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{W}') w from documents
), p as (
  select doc_id, w, unnest(range(1, len(w) + 1)) i from d
), win as (
  select doc_id, i, k, w[i : i + k - 1] g from p cross join (values (5), (8), (101)) v(k) where i + k - 1 <= len(w)
), rep as (
  select doc_id, k, i from (select *, count(*) over (partition by doc_id, k, g) n from win) where n > 1
), cover as (
  select doc_id, k, count(distinct j) n from (select doc_id, k, unnest(range(i, i + k)) j from rep) group by all
), lines as (
  select doc_id, count(*) - count(distinct l) n from (select doc_id, unnest(string_split(t, chr(10))) l from d) where regexp_matches(l, '{W}') group by 1
), m as (
  select d.doc_id, len(w)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, coalesce(l.n, 0)::bigint n_dup_lines,
    coalesce(c8.n, 0)::bigint n_repeat_words, coalesce(c5.n, 0)::bigint covered_words, c101.n is not null long_repeat
  from d left join lines l on l.doc_id = d.doc_id
  left join cover c5 on c5.doc_id = d.doc_id and c5.k = 5 left join cover c8 on c8.doc_id = d.doc_id and c8.k = 8
  left join cover c101 on c101.doc_id = d.doc_id and c101.k = 101
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 100 * covered_words <= 40 * n_words and not long_repeat kept
from m
"""

ORACLES = {"op2_quality_rules": OP2, "op5_mixing": OP5, "op9_exact_dedup": OP9}
