"""SQL (DuckDB) of the registered operators, as far as SQL can say it."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIX = rf"""
with d as (
  select doc_id, source, cast(len({WORDS}) as bigint) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as k
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size,
         case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as w
  from d group by source),
c as (
  select *, 2 * source_size as cap, sum(source_size) over () as total,
         coalesce(sum(2 * source_size) over b, 0) as capped,
         sum(w) over () - coalesce(sum(w) over b, 0) as w_left
  from s window b as (order by cast(2 * source_size as double) / w, source asc nulls last
                      rows between unbounded preceding and 1 preceding)),
f as (select *, total * 3 - capped * 2 as rest, cap * 2 * w_left <= w * (total * 3 - capped * 2) as is_capped from c),
u as (select min(capped) as capped0, max(rest) as rest0, max(w_left) as w0 from f where not is_capped),
t as (
  select source, source_size,
         case when is_capped then cast(cap as double)
              else cast(cast(w * rest0 as bigint) as double) / cast(cast(w0 * 2 as bigint) as double) end as target
  from f, u),
p as (
  select doc_id, d.source, size, source_size, target, cast(round(target) as bigint) as budget,
         coalesce(sum(size) over (partition by d.source order by k, doc_id, size
                                  rows between unbounded preceding and 1 preceding), 0) as start
  from d join t on d.source is not distinct from t.source)
select doc_id, source, size, source_size, target,
       cast(case when source_size > 0 then
         (budget // source_size) * size
         + greatest(0, least(size, budget - (budget // source_size) * source_size - start)) else 0 end as bigint) as taken
from p
"""

CHAT = r"""
with m as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, len(regexp_extract_all(text, '[<\[]\\*(?:\||/?s>|/?INST\])')) as marks,
         len(regexp_extract_all(role, '[<\[]\\*(?:\||/?s>|/?INST\])')) as role_marks
  from m)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(text) + marks + length(role) + role_marks + 23) as bigint) as formatted_chars
from e group by conv_id
"""

NGRAM_JOIN = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as ws
  from documents),
d as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) end as sh
  from w),
e as (select doc_id, unnest(sh) as s from d),
n as (select doc_id, cast(len(sh) as bigint) as n from d),
o as (
  select x.doc_id as a, y.doc_id as b, count(*) as o
  from e x join e y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
l as (
  select a, b from o join n na on na.doc_id = a join n nb on nb.doc_id = b
  where 100 * o >= 75 * (na.n + nb.n - o)),
both_ways as (select a, b from l union all select b, a from l),
r as (select doc_id as a, doc_id as b from d union select r.a, x.b from r join both_ways x on r.b = x.a)
select r.a as doc_id, n.n as n_shingles, min(r.b) as component_id from r join n on n.doc_id = r.a group by r.a, n.n
"""

LEAKS = r"""
with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') as ws from documents),
i as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') as ws from benchmark),
it as (select item_id, cast(len(ws) as bigint) as n, least(len(ws), 5) as w from i where len(ws) > 0),
ish as (
  select item_id, n, w, array_to_string(ws[p:p + w - 1], ' ') as s
  from (select i.item_id, n, w, ws, unnest(range(1, cast(n - w + 2 as bigint))) as p from i join it using (item_id))),
ic as (select item_id, n, w, s, count(*) as c from ish group by all),
dsh as (
  select doc_id, nd, w, p - 1 as pos, array_to_string(ws[p:p + w - 1], ' ') as s
  from (select doc_id, len(ws) as nd, ws, w, unnest(range(1, cast(len(ws) - w + 2 as bigint))) as p
        from d, (select distinct w from it) where len(ws) >= w)),
h as (select distinct doc_id, item_id, n, dsh.w, nd, pos from dsh join ic on dsh.s = ic.s and dsh.w = ic.w),
st as (
  select distinct doc_id, item_id, n, w,
         unnest(range(cast(greatest(0, pos - (n - w)) as bigint), cast(least(pos, nd - n) + 1 as bigint))) as start
  from h where n <= nd),
wc as (
  select st.doc_id, st.item_id, st.n, st.w, st.start, dsh.s, count(*) as c
  from st join dsh on dsh.doc_id = st.doc_id and dsh.w = st.w and dsh.pos between st.start and st.start + st.n - st.w
  group by all),
sm as (
  select wc.doc_id, wc.item_id, wc.n, wc.w, wc.start, sum(least(wc.c, ic.c)) as inter
  from wc join ic on ic.item_id = wc.item_id and ic.s = wc.s group by all),
r as (select *, inter / (2.0 * (n - w + 1) - inter) as sim from sm),
b as (select *, row_number() over (partition by doc_id, item_id order by sim desc, start) as k from r where sim >= 0.75)
select doc_id, item_id, cast(start as bigint) as start, n as n_words, round(sim, 9) as similarity from b where k = 1
"""

# Checksums byte by byte, through the table of the 256 bytes.
CRC_TABLE = """
tab as (
  select list(list_reduce(list_prepend(i, range(8)), lambda c, x: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)
              order by i) as t
  from (select unnest(range(256)) as i))"""


def crc32(text: str) -> str:
    """Unsigned checksum of a string expression; ``tab`` must be among the tables read."""
    digits = f"hex(encode({text}))"
    codes = f"list_transform(range(1, strlen({text}) + 1), lambda j: cast('0x' || substr({digits}, cast(2 * j - 1 as int), 2) as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, tab.t[xor(c, b) % 256 + 1])), 4294967295)"


SPELLING = rf"""
with recursive {CRC_TABLE},
r as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-zÀ-ÿ]+')) as run
  from documents),
c as (select coalesce(cast(doc_id as varchar), '') || ':' || run as k, run, count(*) as m from r group by all),
h as (select run, m, {crc32("k")} as h from c, tab),
w as (
  select case when h % 97 = 0 then substr(run, 1, cast(h % length(run) as int)) || substr(run, cast(h % length(run) + 2 as int))
              else run end as word, m
  from h),
v as (select word, cast(sum(m) as bigint) as n from w where length(word) >= 5 group by word having sum(m) >= 3),
gaps as (
  select word, n, i, substr(word, 1, i - 1) || '_' || substr(word, i + 1) as hole, substr(word, 1, i - 1) || substr(word, i + 1) as less
  from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
less as (select distinct word, n, less from gaps),
near as (
  select a.word, b.word as other, b.n from gaps a join gaps b on a.hole = b.hole and a.word <> b.word
  union all select less.word, v.word, v.n from less join v on less.less = v.word
  union all select v.word, less.word, less.n from less join v on less.less = v.word),
k as (select word, n, other, row_number() over (partition by word order by n desc, other) as best, count(*) over (partition by word) as n_near from near),
f as (
  select v.word, v.n, coalesce(k.n_near, 0) as n_near, case when k.n >= 2 * v.n then k.other end as form,
         case when k.n >= 2 * v.n then k.n end as form_n
  from v left join k on k.word = v.word and k.best = 1),
path as (
  select word, word as root from f
  union all select path.word, f.form from path join f on f.word = path.root where f.form is not null)
select f.word, f.form, path.root, f.n, cast(f.n_near as bigint) as n_near, cast(f.form_n as bigint) as form_n
from f join path on path.word = f.word join f e on e.word = path.root where e.form is null
"""


# Costs to go per state (nothing yet, after system, user, assistant) run back over the rows, edits forward.
REPAIR = rf"""
with recursive {CRC_TABLE},
o as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k
  from conversations),
h as (select *, {crc32("k")} % 20 as h from o, tab),
d as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role,
         case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(case when h = 3 then [1, 2] else [1] end) as copy
  from h where h <> 0),
p as (
  select conv_id, turn, role, text, row_number() over w as i, count(*) over (partition by conv_id) as n,
         lag(substr(role, 1, 1)) over w as before
  from d window w as (partition by conv_id order by turn nulls first, role, text)),
q as (select *, row_number() over (partition by conv_id, role, text order by i) as seen from p),
f as (
  select *, substr(role, 1, 1) as r,
         case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 2 when seen > 1 then 3
              when regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 0 else 1 end as fault
  from q),
e as (
  select *, fault >= 2 as gone, case when fault = 1 then 3 else 0 end as stay, 1000000000 as far from f),
v as (
  select conv_id, n + 1 as i, cast(0 as bigint) as v0, cast(6 as bigint) as v1, cast(3 as bigint) as v2, cast(0 as bigint) as v3
  from (select distinct conv_id, n from e)
  union all
  select conv_id, i, least(b0, 3 + least(b2, 3 + b3)), least(b1, 3 + least(b2, 3 + b3)), least(b2, 3 + b3), least(b3, 3 + b2)
  from (
    select e.conv_id, e.i,
           least(4 + v0, case when gone then far else stay + least(3 + v2, case r when 's' then v1 when 'u' then v2 else far end) end) as b0,
           least(4 + v1, case when gone then far else stay + least(3 + v2, case r when 'u' then v2 else far end) end) as b1,
           least(4 + v2, case when gone then far else stay + least(3 + v3, case r when 'a' then v3 else far end) end) as b2,
           least(4 + v3, case when gone then far else stay + least(3 + v2, case r when 'u' then v2 else far end) end) as b3
    from v join e on e.conv_id is not distinct from v.conv_id and e.i = v.i - 1)),
c as (select conv_id, i, [v0, v1, v2, v3] as v from v),
rows_ as (
  select e.conv_id, e.i, e.n, e.role, e.text, e.r, e.gone, e.stay, a.v as here, b.v as there
  from e join c a on a.conv_id is not distinct from e.conv_id and a.i = e.i
         join c b on b.conv_id is not distinct from e.conv_id and b.i = e.i + 1),
-- One edit at a time: state s before it, row i the next one.
walk as (
  select distinct conv_id, cast(1 as bigint) as i, 0 as s, '' as audit, cast([] as varchar[]) as said from rows_
  union all
  select conv_id, case when edit = 'I' then i else i + 1 end,
         case edit when 'D' then s when 'K' then kept else turn_to end, audit || edit,
         case edit when 'D' then said when 'I' then list_append(said, case turn_to when 2 then 'user:' else 'assistant:' end)
              when 'K' then list_append(said, role || ':' || text)
              else list_append(said, case turn_to when 2 then 'user:' else 'assistant:' end || text) end
  from (
    select *, case when i > n then 'I' when 4 + there[s + 1] = here[s + 1] then 'D' when 3 + here[turn_to + 1] = here[s + 1] then 'I'
                   when not gone and kept is not null and stay + there[kept + 1] = here[s + 1] then 'K' else 'R' end as edit
    from (
      select w.*, x.role, x.text, x.gone, x.stay, x.here, x.there, m.n,
             case when w.s = 2 then 3 else 2 end as turn_to,
             case when x.r = 's' and w.s = 0 then 1 when x.r = 'u' and w.s in (0, 1, 3) then 2 when x.r = 'a' and w.s = 2 then 3 end as kept
      from walk w join (select distinct conv_id, n from rows_) m on m.conv_id is not distinct from w.conv_id
                  left join rows_ x on x.conv_id is not distinct from w.conv_id and x.i = w.i
      where w.i <= m.n or w.s in (1, 2)))),
last_ as (select conv_id, audit, said, row_number() over (partition by conv_id order by length(audit) desc, i desc) as k from walk),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 2) as blank,
         count(*) filter (fault = 3) as duplicate, count(*) filter (fault = 1) as truncated,
         count(*) filter (before is not null and before || r not in ('su', 'ua', 'au')) as illegal
  from e group by conv_id)
select a.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(c.v[1], 0) as cost, coalesce(audit, '') as audit,
       sha256(coalesce(array_to_string(said, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) a
  left join counts on counts.conv_id is not distinct from a.conv_id
  left join c on c.conv_id is not distinct from a.conv_id and c.i = 1
  left join last_ on last_.conv_id is not distinct from a.conv_id and last_.k = 1
"""
