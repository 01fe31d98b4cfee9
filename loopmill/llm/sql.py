"""DuckDB SQL for the operators that it can express."""

QUALITY = r"""
with w as (
  select doc_id, source, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
numbered as (select row_number() over () as rid, * from w),
grams as (select rid, i, list_slice(words, i, i + 7) as g from (select rid, words, unnest(range(1, greatest(len(words) - 6, 1))) as i from numbered)),
again as (select rid, i from grams qualify count(*) over (partition by rid, g) > 1),
covered as (select rid, sum(least(8, coalesce(following - i, 8)))::bigint as n from (select rid, i, lead(i) over (partition by rid order by i) as following from again) group by rid),
base as (
  select doc_id, source as host, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(covered.n, 0)::bigint as n_repeat_words, len(lines) as n_lines
  from numbered left join covered using (rid)),
rules as (
  select *, n_words < 20 as short, 100 * n_repeat_words > 30 * n_words as repeats, 100 * n_symbols > 10 * word_chars as symbols, 100 * n_dup_lines > 30 * n_lines as lines from base),
hosts as (
  select host, rule, count(*)::double as n, count_if(failed)::double as k
  from (select host, unnest(['short', 'repeats', 'symbols', 'lines']) as rule, unnest([short, repeats, symbols, lines]) as failed from rules) group by all),
prior as (select rule, sum(k) / sum(n) as m0, sum(n * (k / n) * (k / n)) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n)) as v0 from hosts group by rule),
beta as (select rule, m, least(0.5, greatest(0.15, 3.0 * m)) as most, least(greatest(m * (1 - m) / v - 1, 2.0), 1000.0) as s from (select rule, least(greatest(m0, 1e-4), 1 - 1e-4) as m, greatest(v0, 1e-6) as v from prior)),
verdicts as (
  select host, bool_or(p - 1.645 * sqrt(p * (1 - p) / (n + s + 1)) > most) as rejected
  from (select host, n, s, most, (k + m * s) / (n + s) as p from hosts join beta using (rule)) group by host)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short or repeats as base_failed, not (short or repeats) and not rejected as kept
from rules join verdicts on rules.host is not distinct from verdicts.host
"""

CHAT = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
bodies as (
  select *, length(regexp_replace(role, '([\\:#<\n])', '\\\1', 'g')) + 6 + 9 + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) as chars
  from rows)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars
from bodies group by conv_id
"""

MIXING = r"""
with recursive docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
  from documents),
sizes as (select source, sum(size)::bigint as source_size, (1 + (row_number() over (order by source collate "C" nulls last) - 1) % 3)::double as weight from docs group by source),
share as (
  select 0 as round, source, source_size, weight, false as capped, false as more from sizes
  union all
  select round + 1, source, source_size, weight, capped or over, bool_or(over) over ()
  from (
    select *, not capped and weight * unit > 3 * source_size as over
    from (select *, (sum(source_size) over () - coalesce(sum(case when capped then 3 * source_size end) over (), 0)) / sum(case when not capped then weight end) over () as unit from share where round = 0 or more))),
last as (select * from share where round = (select max(round) from share)),
goals as (
  select source, source_size, case when capped then (3 * source_size)::double else weight * unit end as target
  from (select *, (sum(source_size) over () - coalesce(sum(case when capped then 3 * source_size end) over (), 0)) / sum(case when not capped then weight end) over () as unit from last)),
plan as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as passes from goals),
rooms as (select *, floor(target - passes * source_size)::bigint as room from plan),
by_hash as (select source, h, sum(size)::bigint as n from docs group by source, h),
running as (select b.source, h, n, sum(n) over (partition by b.source order by h) as upto, r.room, r.source_size, r.target, r.passes from by_hash b join rooms r on b.source is not distinct from r.source),
ends as (
  select source, any_value(source_size) as source_size, any_value(target) as target, any_value(passes) as passes,
         min(case when upto > room then h + (case when upto - room <= room - (upto - n) then 1 else 0 end) end) as first_over
  from running group by source)
select doc_id, size, source_size, target,
       (size * (case when size = 0 then 0 else passes + case when passes < 3 and h < coalesce(first_over, 1152921504606846976) then 1 else 0 end end))::bigint as taken
from docs join ends on docs.source is not distinct from ends.source
"""

INFILL = r"""
with d as (select doc_id, coalesce(text,'') as text, sha256('42:'||coalesce(doc_id::varchar,'')) as x from documents),
h as (select doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u,
  ('0x'||substr(x,1,8))::bigint as h1, ('0x'||substr(x,9,8))::bigint as h2, ('0x'||substr(x,17,8))::bigint as h3, ('0x'||substr(x,25,8))::bigint as h4 from d),
c as (select doc_id, text, u, len(u)::bigint as n, least(h1 % (len(u)+1), h2 % (len(u)+1)) as lo, greatest(h1 % (len(u)+1), h2 % (len(u)+1)) as hi,
  case when text = '' or contains(text,'<P>') or contains(text,'<S>') or contains(text,'<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from h),
p as (select *, array_to_string(u[1:lo],'') as pre, array_to_string(u[lo+1:hi],'') as mid, array_to_string(u[hi+1:],'') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>'||pre||'<S>'||suf||'<M>'||mid else '<S>'||suf||'<P>'||pre||'<M>'||mid end) as output_sha256,
  sha256(case form when 'plain' then text else pre||mid||suf end) as restored_sha256 from p
"""

VARIANTS = r"""
with recursive bits as (
  select i, i as c, 0 as k from range(256) t(i)
  union all select i, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
crc_of as (select i, c from bits where k = 8),
runs as (
  select doc_id, run, count(*) as times from (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents)
  where length(run) >= 5 group by all),
coded as (select *, hex(coalesce(doc_id::varchar, '') || ':' || run) as x from runs),
steps as (
  select doc_id, run, times, x, 0 as pos, 4294967295::bigint as c from coded
  union all
  select doc_id, run, times, x, pos + 1, xor(s.c >> 8, t.c) from steps s join crc_of t on t.i = xor(s.c & 255, ('0x' || substr(x, 2 * pos + 1, 2))::bigint) where 2 * pos < length(x)),
hashed as (select run, times, xor(c, 4294967295) as h from steps where 2 * pos = length(x)),
spelt as (select case when h % 97 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, times from hashed),
words as materialized (select word, sum(times)::bigint as n from spelt where length(word) >= 5 group by 1 having sum(times) >= 3),
cuts as materialized (select word, n, i, substr(word, 1, i - 1) as head, substr(word, i + 1) as tail from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
pairs as materialized (
  select a.word, b.word as other, b.n as other_n from cuts a join cuts b on a.head = b.head and a.tail = b.tail and a.word <> b.word
  union select c.word, w.word, w.n from cuts c join words w on w.word = c.head || c.tail
  union select w.word, c.word, c.n from cuts c join words w on w.word = c.head || c.tail),
best as (select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from pairs group by 1),
forms as materialized (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 2 * w.n then other end as form, case when other_n >= 2 * w.n then other_n end as form_n
  from words w left join best using (word)),
chain as (
  select word, form as upto from forms where form is not null
  union all select c.word, f.form from chain c join forms f on f.word = c.upto where f.form is not null),
ends as (select c.word, c.upto from chain c join forms f on f.word = c.upto where f.form is null)
select f.word, form, coalesce(upto, f.word) as root, n, n_near, form_n from forms f left join ends e on e.word = f.word
"""

MINHASH = r"""
with recursive w as (
  select row_number() over () as rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents),
grams as (
  select distinct rid, case when len(words) < 5 then array_to_string(words, ' ') else array_to_string(list_slice(words, i, i + 4), ' ') end as g
  from (select rid, words, unnest(range(1, greatest(len(words) - 3, 2))) as i from w where len(words) > 0)),
sets as materialized (select rid, count(*) as n, md5(string_agg(g, chr(10) order by g)) as key from grams group by rid),
one as materialized (select key, min(rid) as rid, any_value(n) as n from sets group by key),
shared as (
  select a.rid as a, b.rid as b, count(*) as common_n from grams a join grams b on a.g = b.g and a.rid < b.rid
  where a.rid in (select rid from one) and b.rid in (select rid from one) group by 1, 2),
links as materialized (
  select a, b from shared join one x on x.rid = a join one y on y.rid = b where 100 * common_n >= 85 * (x.n + y.n - common_n)),
two as materialized (select a, b from links union all select b, a from links),
reach as (select rid as node, rid as root from one union select b, root from reach join two on a = node),
class as (select node, min(root) as component from reach group by node),
member as (select s.rid, s.n, c.component, w.doc_id from sets s join one o using (key) join class c on c.node = o.rid join w on w.rid = s.rid),
least as (select component, min(doc_id) as component_id from member group by component)
select w.doc_id, coalesce(m.n, 0) as n_shingles, case when m.rid is null then w.doc_id else l.component_id end as component_id,
       coalesce(w.doc_id = case when m.rid is null then w.doc_id else l.component_id end, false) as kept
from w left join member m using (rid) left join least l using (component)
"""
