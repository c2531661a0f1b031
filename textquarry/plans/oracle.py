"""The registered queries as SQL, written apart from the Spark code."""

from __future__ import annotations

DOC_PATH = "source || '/' || lang || '/' || doc_id || '.txt'"

LINES = f"""
parts as (select doc_id, {DOC_PATH} as path, string_split(text, chr(10)) as ls from documents),
numbered as (select doc_id, path, ls, unnest(range(1, len(ls) + 1)) as i from parts),
lines as (select printf('%012d:%06d', doc_id, i) as id, path, i, ls[i] as content from numbered where ls[i] <> '')"""


def words(name: str, source: str, id: str, text: str, dim: int = 1536) -> str:
    """Word counts per hashed bucket, and squared lengths."""
    return f"""
{name}_words as (select {id} as id, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) as w from {source}),
{name}_b as (select id, ('0x' || substr(md5(w), 1, 8))::bigint % {dim} as b, count(*) as c from {name}_words group by 1, 2),
{name}_n as (select id, sum(c * c)::double as n2 from {name}_b group by 1)"""


def nearest(q: str, r: str, k: str) -> str:
    """Ranked hits between two ``words`` sets."""
    return f"""
dots as (select q.id as query_id, r.id as id, sum(q.c * r.c)::double as dot from {q}_b q join {r}_b r on q.b = r.b group by 1, 2),
cosines as (select query_id, d.id, dot / sqrt(qn.n2 * rn.n2) as score from dots d
            join {q}_n qn on qn.id = query_id join {r}_n rn on rn.id = d.id),
hits as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from cosines)
         where rank <= {k})"""


def _vector_hits(queries: str, k: str) -> str:
    return f"""
with q as ({queries}),
r as (select vec_id as id, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings),
scored as (select q.query_id, q.k, r.id, round(list_dot_product(q.e, r.e) / (q.n * r.n), 9) as score from q, r)
select query_id, rank::int as rank, id, round(score, 6) as score from (
  select *, row_number() over (partition by query_id order by score desc, id) as rank from scored)
where rank <= {k}"""


VECTOR_SELF = _vector_hits(
    """select vec_id as query_id, 3 as k, embedding::double[] as e,
       sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings""", "k")

VECTOR_LABELS = _vector_hits(
    """select label as query_id, case when label - 2 <= 0 then 5 else label - 2 end as k, e, sqrt(list_dot_product(e, e)) as n
       from (select label, list(m order by i) as e from (
         select label, i, avg(embedding[i]::double) as m from (
           select label, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by 1, 2) group by 1)""", "k")

HASH_EMBED = f"""
with {words('d', 'documents', 'doc_id', 'text')}
select id as doc_id, b as bucket, round(c / sqrt(n2), 6) as weight from d_b join d_n using (id)"""

EMBED_BATCHES = """
select doc_id, length(text) as n_chars, length(text) - length(replace(text, 'e', '')) as n_e,
       length(text) - length(replace(text, chr(10), '')) as n_breaks from documents"""

HASH_KNN = f"""
with {words('q', 'benchmark', 'item_id', 'text')}, {words('d', 'documents', 'doc_id', 'text')}, {nearest('q', 'd', '3')}
select query_id, rank::int as rank, id, round(score, 6) as score from hits"""

SPARSE_KNN_WIDE = f"""
with {words('q', 'benchmark', 'item_id', 'text', 65536)}, {words('d', 'documents', 'doc_id', 'text', 65536)}, {nearest('q', 'd', '3')}
select query_id, rank::int as rank, id, round(score, 6) as score from hits"""

_CONTEXT = f"""
with turns as (select conv_id || ':' || turn as query_id, conv_id, turn, text from conversations where role = 'user'),
{LINES}, {words('q', 'turns', 'query_id', 'text')}, {words('l', 'lines', 'id', 'content')}, {nearest('q', 'l', '3')},
blocks as (select query_id, rank, '--- File: ' || path || ' (Lines: ' || i || '-' || i || ') ---' || chr(10)
                  || '```go' || chr(10) || content || chr(10) || '```' || chr(10) || chr(10) as block
           from hits join lines using (id)),
sized as (select *, sum(strlen(block)) over (partition by query_id order by rank rows unbounded preceding) <= 1000 as fits from blocks),
contexts as (select query_id, count(*) as n_hits, count(*) filter (fits) as n_kept,
       'Relevant code snippets based on your query:' || chr(10) || chr(10)
       || coalesce(string_agg(block, '' order by rank) filter (fits), '')
       || case when bool_and(fits) then '' else '... (omitting further snippets due to length limit)' || chr(10) end as context
  from sized group by query_id)"""

RAG_CONTEXT = _CONTEXT + " select query_id, n_hits, n_kept, context from contexts"

RAG_PROMPT = _CONTEXT + """
select conv_id, turn, coalesce(context || chr(10) || chr(10) || 'User Query:' || chr(10) || text, text) as prompt
from turns left join contexts using (query_id)"""

def history(n: int) -> str:
    return f"""
select conv_id, turn, coalesce(len(h), 0)::bigint as n_before, coalesce(array_to_string(h, chr(10)), '') as history from (
  select conv_id, turn, list(role || ': ' || text) over (
    partition by conv_id order by turn rows between {n} preceding and 1 preceding) as h from conversations)"""


MODEL_ERRORS = """
select conv_id, turn, case when length(text) % 3 = 2 then length(text)::double end as first_weight,
  case length(text) % 3 when 0 then 'RuntimeError: no capacity' when 1 then 'empty vector' end as reason from conversations"""

LISTING_PAGES = """
with e as (select distinct '' as path, source as entry from documents union select source, source || '/' || lang from documents
           union select source || '/' || lang, source || '/' || lang || '/' || doc_id || '.txt' from documents),
r as (select path, entry, (row_number() over (partition by path order by entry) - 1) // 20 + 1 as page from e),
p as (select path, page, '[' || string_agg('"' || entry || '"', ',' order by entry) || ']' as content from r group by 1, 2)
select 'list:' || path as call_id, content, false as is_error, page::int as page,
  (max(page) over (partition by path))::int as pages from p"""

TURN_GROUPS = """
select conv_id, turn_group::bigint as turn_group, min(turn) as first_turn, max(turn) as last_turn, count(*) as n_messages,
       count(*) filter (role = 'assistant') as n_replies, max(case when role = 'user' then text end) as user_text
from (select *, sum((role = 'user')::int) over (partition by conv_id order by turn rows unbounded preceding) as turn_group
      from conversations) group by 1, 2"""


def keyword(queries: str) -> str:
    """``kw``: top five documents per query row (query_id, query), by term counts."""
    return f"""
kdocs as (select printf('%012d.txt', doc_id) as filename, lower(text) as low, text from documents),
kterms as (select query_id, t, count(*) as times from (
  select query_id, unnest(regexp_split_to_array(lower(query), '\\s+')) as t from {queries}) where t <> '' group by 1, 2),
kcounts as (select t, filename, (strlen(low) - strlen(replace(low, t, ''))) / strlen(t) as n
  from (select distinct t from kterms), kdocs where contains(low, t)),
krel as (select query_id, filename, sum(times * n)::double as relevance from kterms join kcounts using (t) group by 1, 2),
kw as (select * from (select *, row_number() over (partition by query_id order by relevance desc, filename) as rank from krel)
       where rank <= 5)"""


KEYWORD = f"""
with q as (select item_id as query_id, text as query from benchmark), {keyword('q')},
klines as (select query_id, filename, i, ls[i] as line from (
  select query_id, filename, ls, unnest(range(1, len(ls) + 1)) as i from (
    select query_id, filename, string_split(text, chr(10)) as ls from kw join kdocs using (filename)))),
kbest as (select query_id, filename, arg_max(line, (n, -i)) as matched_line from (
  select query_id, filename, i, line, sum(times * (strlen(lower(line)) - strlen(replace(lower(line), t, ''))) / strlen(t)) as n
  from klines join kterms using (query_id) group by all) group by 1, 2)
select query_id, rank::int as rank, filename, relevance, matched_line from kw join kbest using (query_id, filename)"""

CASCADE = f"""
with q as (select page_id as query_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as query from pages),
turns as (select printf('%012d:%06d', conv_id, turn) as id, text from conversations),
{words('q', 'q', 'query_id', 'query')}, {words('t', 'turns', 'id', 'text')}, {nearest('q', 't', '5')},
lost as (select * from q where query_id not in (select query_id from hits)), {keyword('lost')}
select query_id, 'vector' as origin, rank::int as rank, id as ref, round(score, 6) as score from hits
union all select query_id, 'keyword', rank::int, filename, round(relevance, 6) from kw"""

EXT_STATS = f"""
with p as (select source || '/' || lang || '/' || doc_id || '.TXT' as path from documents
           union all select regexp_replace(url, '^[a-z]+://', '') from pages),
e as (select lower(regexp_extract(path, '\\.[^./]*$', 0)) as ext from p)
select coalesce(case when ext = '' then '(no extension)' else ext end, '(all)') as ext, count(*) as n_files from e group by rollup (ext)"""

_HEAD_CLASS = "len(list_filter(bytes, lambda x: {}))::bigint"

BINARY = f"""
with f as (select source || '/' || lang || '/' || doc_id as path, text, false as known_ext from documents
           union all select 'pages/' || page_id || '.html', html, true from pages),
h as (select path, known_ext, strlen(text) as size, hex(encode(text)) as h from f),
b as (select path, known_ext, size, h, substr(h, 1, 200) as head,
        list_transform(range(0, least(size, 1000)), lambda i: substr(h, (2 * i + 1)::int, 2)) as bytes from h),
-- the markers as hex of the lowered head, matched at even places
m as (select path, list_aggregate(list_transform([
        '<!doctype', '<html', '<?xml', '{{', '[', '//', '/*', '#!', 'import ', 'package ', 'using ', 'function ', 'class ',
        'def ', 'var ', 'const ', 'let ', 'from ', '# ', '// ', '/* ', '; ', ''' '],
        lambda s: contains(',' || array_to_string(list_transform(list_filter(range(0, len(head) // 2), lambda i: true),
           lambda i: case when substr(head, (2 * i + 1)::int, 2) between '41' and '5A'
             then hex(encode(lower(chr(('0x' || substr(head, (2 * i + 1)::int, 2))::int)))) else substr(head, (2 * i + 1)::int, 2) end), ',') || ',',
           ',' || array_to_string(list_transform(string_split(s, ''), lambda c: hex(encode(c))), ',') || ',')), 'bool_or') as known_text from b),
c as (select path, known_ext, size, h, known_text, least(size, 1000) as n,
        {_HEAD_CLASS.format("x = '00'")} as n_nul,
        {_HEAD_CLASS.format("x between '01' and '08' or x between '0E' and '1A' or x between '1C' and '1F'")} as n_ctrl,
        {_HEAD_CLASS.format("x between '80' and '9F'")} as n_ext from b join m using (path))
select path, known_ext, known_text, n_ctrl, n_ext,
  (not known_ext and not (h like 'EFBBBF%') and n >= 32 and case when known_text then n_nul > n // 50
     else n_nul > n // 1000 or n_ctrl > n // 100 or n_ext > n // 50 end) as skipped from c"""

# The cut may fall inside a character, which then shows as one U+FFFD.
_TRUNCATED = """
docs as (select *, source || '/' || lang || '/' || doc_id || '.txt' as path, substr(hex(encode(text)), 1, 20000) as h from documents),
whole as (select *, regexp_replace(h, '([CD][0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-9A-F]([89AB][0-9A-F]){0,2})$', '') as h2 from docs),
cut as (select doc_id, path, case when strlen(text) > 10000 then decode(unhex(h2))
          || case when h2 <> h then chr(65533) else '' end || '... [content truncated]' else text end as content from whole),
snips as (select sha256(concat_ws(chr(31), path, '1', content)) as id, path, doc_id, content,
          len(string_split(content, chr(10)))::bigint as end_line, 'File: ' || path || chr(10) || content as embed_text from cut)"""

SNIPPETS = f"""
with {_TRUNCATED}
select id, path as file_path, 1::bigint as start_line, end_line, 'txt' as file_type, doc_id || '.txt' as file_name,
       0::bigint as n_symbols, md5(content) as content_md5, md5(embed_text) as embedding_md5 from snips"""

# Pieces start 9,997 bytes apart, moved on to the next character.
_CONTINUED = """
docs as (select *, source || '/' || lang || '/' || doc_id || '.txt' as path, hex(encode(text)) as h, strlen(text) as size from documents),
steps as (select doc_id, path, h, size, unnest(range(0, case when size <= 10000 then 1 else (size - 1) // 9997 + 1 end)) * 9997 as p from docs),
starts as (select doc_id, path, h, size, case when p = 0 then 0 else p + case
    when substr(h, (2 * p + 1)::int, 1) not between '8' and 'B' then 0 when substr(h, (2 * p + 3)::int, 1) not between '8' and 'B' then 1
    when substr(h, (2 * p + 5)::int, 1) not between '8' and 'B' then 2 else 3 end end as pos from steps),
ends as (select *, coalesce(lead(pos) over (partition by doc_id order by pos), size) as upto from starts),
parts as (select doc_id, path, pos, decode(unhex(substr(h, (2 * pos + 1)::int, (2 * (upto - pos))::int))) as content
          from ends where pos = 0 or upto > pos),
placed as (select *, len(string_split(content, chr(10))) - 1 as breaks, 1 + coalesce(sum(len(string_split(content, chr(10))) - 1) over (
    partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as start_line from parts),
snips as (select sha256(concat_ws(chr(31), path, start_line::bigint, content, case when pos > 0 then pos::bigint end)) as id, path, doc_id,
    content, start_line::bigint as start_line, (start_line + breaks)::bigint as end_line, 'File: ' || path || chr(10) || content as embed_text
  from placed)"""

SNIPPETS_FULL = f"""
with {_CONTINUED}
select id, path as file_path, start_line, end_line, strlen(content) as n_bytes, md5(content) as content_md5 from snips"""

_GO_TEXT = """
gdocs as (select doc_id, source || '/' || lang || '/' || doc_id || '.go' as p, replace(replace(text, '`', chr(39)), '*/', '* /') as body from documents),
lined as (select *, len(string_split(body, chr(10))) - 1 as n from gdocs where doc_id % 5 <> 0),
go as (
  select p, 6 + n as a, 6 + 2 * n as b, 'Doc' || doc_id as symbol,
    'func Doc' || doc_id || '() string { return `' || body || '` } // {' as content from lined
  union all select p, 8 + 2 * n, 8 + 2 * n, 'bare' || doc_id, 'func bare' || doc_id || '(a int, b interface{}) int' from lined
  union all select p, 11 + 2 * n, 21 + 3 * n, 'Run.Multi' || doc_id, 'func (r *Run) Multi' || doc_id || '(' || chr(10) || chr(9) || 'a int,'
    || chr(10) || ') string {' || chr(10) || chr(9) || 's := "} \\" func (" + `' || chr(10) || body || chr(10) || 'func notReal() {' || chr(10)
    || '}' || chr(10) || '`' || chr(10) || chr(9) || 'c := ' || chr(39) || '{' || chr(39) || chr(10) || chr(9) || 'return s' || chr(10) || '}' from lined)"""

MIXED_SNIPPETS = f"""
with {_CONTINUED}, {_GO_TEXT}
select p as file_path, a::bigint as start_line, b::bigint as end_line, symbol, md5(content) as content_md5 from go
union all select path, start_line, end_line, '', md5(content) from snips"""

INDEX_SUMMARY = f"""
with {_CONTINUED}, {_GO_TEXT},
exts as (select unnest(['.go', '.txt']) as ext from documents),
fit as (select path from docs where size <= 20000)
select 'files' as kind, coalesce(ext, '(all)') as name, count(*)::bigint as n from exts group by rollup (ext)
union all select 'snippets', '(all)', (select count(*) from go) + (select count(*) from snips join fit using (path))
union all select 'left out', 'file too large (>20000 bytes): ' || path, 1 from docs where size > 20000
union all select 'left out', 'failed to parse file: ' || p, 1 from gdocs where doc_id % 5 = 0"""

INDEX = f"""
with {_CONTINUED}, {words('s', 'snips', 'id', 'embed_text')}
select id, path as file_path, end_line, 1536::bigint as dim, round(max(c / sqrt(n2))::float::double, 4) as top_weight
from snips join s_b using (id) join s_n using (id) group by 1, 2, 3"""

GO_SNIPPETS = """
with f as (select *, source || '/' || lang || '/' || doc_id || '.go' as p from documents),
s as (
  select p, 4::bigint as a, 6::bigint as b, 'Make' || doc_id as symbol,
    'func Make' || doc_id || '(a int) int {' || chr(10) || chr(9) || 'return ' || n_chars || chr(10) || '}' as content from f
  union all select p, 8, 8, 'Source.' || lang, 'func (s *Source) ' || lang || '() string { return "' || lang || '" }' from f
  union all select p, 10, 15, 'Get', 'func (b Box[T]) Get() T {' || chr(10) || chr(9) || 'f := func() {' || chr(10) || chr(9) || '}'
    || chr(10) || chr(9) || 'f()' || chr(10) || chr(9) || 'return b.v' || chr(10) || '}' from f)
select p as file_path, a as start_line, b as end_line, symbol, content,
       md5('File: ' || p || chr(10) || 'Symbols: ' || symbol || chr(10) || content) as embedding_md5 from s"""

SPANS = f"""
with parts as (select {DOC_PATH} as path, string_split(text, chr(10)) as ls from documents),
l as (select path, i, ls[i] as line, regexp_matches(ls[i], '^[A-Z]') as s, regexp_matches(ls[i], '\\.\\z') as e
      from (select path, ls, unnest(range(1, len(ls) + 1)) as i from parts)),
starts as (select path, i as start_line, coalesce(lead(i) over (partition by path order by i), 1000000000) as nxt from l where s),
spans as (select path, start_line, min(i) as end_line from starts join l using (path) where e and i >= start_line and i < nxt group by 1, 2)
select path, start_line, end_line, md5(string_agg(line, chr(10) order by i)) as content_md5
from spans join l using (path) where i between start_line and end_line group by 1, 2, 3"""

PATHS = """
with u as (select page_id, regexp_extract(url, '^https?://[^/]+(.*)$', 1) as p from pages),
v as (select page_id, unnest([p, 'a/../..' || p, '.' || p || '/../x//y/.', '/../..' || p || '/../../..', '..' || ltrim(p, '/')]) as path from u),
f as (select page_id, path, starts_with(path, '/') as rooted, list_reduce(
        list_prepend('', list_filter(string_split(path, '/'), lambda x: x <> '' and x <> '.')),
        lambda acc, x: case
          when x <> '..' then case when acc = '' then x else acc || '/' || x end
          when acc = '' or acc = '..' or acc like '%/..' then
            case when starts_with(path, '/') then acc when acc = '' then '..' else acc || '/..' end
          when contains(acc, '/') then regexp_replace(acc, '/[^/]*$', '') else '' end) as folded from v),
c as (select page_id, path, case when rooted then '/' || folded when folded = '' then '.' else folded end as cleaned from f)
select page_id, path, cleaned, coalesce(nullif(ltrim(cleaned, '/'), ''), '.') as key, starts_with(cleaned, '..') as escapes from c"""

WORKSPACE = """
select source || '/.' || lang || '/' || doc_id as path, strlen(text)::bigint as length, md5(text) as content_md5 from documents"""

READ_FILES = f"""
select 'file:' || doc_id as seq, './x/..//' || {DOC_PATH} as path, md5(text) as content_md5, null as error from documents
union all select 'root:' || doc_id, '/' || {DOC_PATH}, md5(text), null from documents
union all select 'none:' || doc_id, source || '/' || lang || '/' || doc_id || '.gone', null,
  'file not found at path ''' || source || '/' || lang || '/' || doc_id || '.gone'' within workspace' from documents
union all select distinct 'dir:' || source, source, null, 'path ''' || source || ''' is a directory, not a file' from documents
union all select distinct 'out:' || lang, 'x/../../' || lang, null,
  'invalid path: ''x/../../' || lang || ''' attempts to traverse outside the workspace' from documents
union all select 'empty', '', null, 'path is required for read_file'"""

LIST_DIR = f"""
with tree as (select distinct '.' as parent, source as name, true as is_dir from documents
  union all select distinct source, lang, true from documents
  union all select source || '/' || lang, doc_id || '.txt', false from documents)
select r.seq, case when prefix = '' then name else prefix || '/' || name end as entry, is_dir, null as error from (
  select distinct unnest([('', '.', ''), ('.', '.', ''), (source, source, source),
    (source || '//' || lang || '/', source || '/' || lang, source || '/' || lang), ('/' || source, source, '/' || source)]) as t from documents),
  lateral (select t[1] as seq, t[2] as parent, t[3] as prefix) r join tree using (parent)
union all select {DOC_PATH}, null, null, 'path ''' || {DOC_PATH} || ''' is not a directory' from documents
union all select distinct lang, null, null::boolean, 'directory not found at path ''' || lang || ''' within workspace' from documents
union all select distinct '../' || lang, null, null::boolean,
  'invalid path: ''../' || lang || ''' attempts to traverse outside the workspace' from documents"""

CREATE_FILES = f"""
with c as (select 'a:' || item_id as seq, 'bench/' || item_id || '.md' as key, 'bench/./' || item_id || '.md' as path, true as ok, 1 as n_after from benchmark
  union all select 'b:' || item_id, 'bench/' || item_id || '.md', 'bench/./' || item_id || '.md', false, 1 from benchmark
  union all select 'd:' || doc_id, {DOC_PATH}, {DOC_PATH}, false, 1 from documents
  union all select distinct 's:' || source, source, source, false, null from documents)
select seq, key, case when not ok then 'file already exists at path ''' || path || '''' end as error,
  case when ok then 'Successfully created file ''' || path || '''' else 'file already exists at path ''' || path || '''' end as message,
  n_after::bigint as n_after from c"""


def _edited(column: str, old: str, new: str) -> str:
    """Occurrences of ``old`` and the content after an exactly-once edit."""
    n = f"((strlen({column}) - strlen(replace({column}, {old}, ''))) // strlen({old}))"
    return f"{n} as n, case when {n} = 1 then replace({column}, {old}, {new}) else {column} end"


def _edit_error(old: str, path: str) -> str:
    return (f"case when n = 0 then 'string ''' || {old} || ''' not found in file ''' || {path} || '''' "
            f"when n > 1 then 'string ''' || {old} || ''' found multiple times (' || n || ') in file ''' || {path} || ''', expected exactly one' end")


EDIT_FILES = f"""
with e as (select doc_id, {DOC_PATH} as path, right(text, 12) as old, text, {_edited('text', "right(text, 12)", "'<' || lang || '>'")} as new from documents)
select doc_id as seq, path as key, {_edit_error('old', 'path')} as error, case when n = 1 then md5(new) end as content_md5 from e"""

EDIT_FOLD = f"""
with a as (select doc_id, text, {DOC_PATH} as path, right(text, 12) as old, {_edited('text', 'right(text, 12)', "'<<one>>'")} as t from documents),
b as (select doc_id, text, path, t as t1, {_edited('t', "'<<one>>'", "'<<two>>'")} as t2 from a),
c as (select doc_id, text, path, {_edited('t2', "' the '", "' a '")} as t3 from b)
select doc_id * 3 as seq, path as key, {_edit_error('old', 'path')} as error, null as content_md5 from a
union all select doc_id * 3 + 1, path, {_edit_error("'<<one>>'", 'path')}, null from b
union all select doc_id * 3 + 2, path, {_edit_error("' the '", 'path')}, null from c
union all select null, path, null, md5(t3) from c where t3 <> text"""

UPSERT = """
select vec_id as id, case when label > 3 and label <> 9 then 2 else 1 end as version,
       round((case when label > 3 then embedding[len(embedding)] else embedding[1] end)::double, 6) as first
from embeddings where label <> 9"""

VECTOR_TABLE = """
select printf('%08d', vec_id) as id, case when label = 5 then 'third' when label > 4 then 'second' else 'first' end as content,
       'a' as symbols, 'label' as keys, label::varchar as label from embeddings where label <> 0"""

PAYLOAD = """
with t as (select conv_id, turn, list_filter(regexp_split_to_array(text, '[ \\n]'), lambda s: s <> '') as s,
             coalesce(string_split(text, chr(10))[2], '') as line from conversations)
select conv_id, turn, len(s)::bigint as n_symbols, array_to_string(s, ' ') as symbols,
       case when line <> '' then 'line,role' else 'role' end as keys from t"""

_TEXT_ID = "sha256(concat_ws(chr(31), '', '0', text))"

_WITH_METADATA = ("text || chr(10) || chr(10) || '--- Metadata ---' || chr(10) || 'role: ' || role || chr(10) "
                  "|| 'turn: ' || turn || chr(10)")

TEXT_UPSERT = f"""
select {_TEXT_ID.replace('text', _WITH_METADATA)} as id, text as content, 0::bigint as start_line, 1536::bigint as dim,
       turn::varchar as turn
from conversations where regexp_matches(text, '[\\p{{L}}\\p{{N}}]')"""

FALLBACK = f"""
select 'vector_store_fallback_' || sha256({_WITH_METADATA}) || '.txt' as filename, {_WITH_METADATA} as content
from conversations"""

TOOL_INPUTS = """
with e as (select event_id, event_type, (props->>'k')::bigint as n from events),
k as (select event_id, event_type, case when event_type = 'view' then -n else n end as k from e)
select event_id, case when event_type in ('error', 'signup') then null when k <= 0 then 5 else k end as k,
       case when event_type in ('error', 'signup') then 'invalid input format for vector_search'
            when event_type = 'click' then 'query is required for vector_search' end as error from k"""

PAGES = """
with t as (select page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as title,
  regexp_replace(html, '(?is)<head.*?</head>|<script.*?</script>|<style.*?</style>', ' ', 'g') as body from pages)
select page_id, title, url, md5(trim(regexp_replace(regexp_replace(body, '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) as text_md5 from t"""

_SNIPPET_JSON = """to_json(list({'id': id, 'content': text, 'file_path': 'conversation/' || conv_id, 'start_line': turn,
  'end_line': turn, 'symbols': []::varchar[]} order by rank))"""

_ERROR = "'Error executing tool ''{}'': ' || "

TOOL_ROUTE = f"""
with docs as (select *, {DOC_PATH} as path from documents),
e as (select doc_id, path, right(text, 12) as old, {_edited('text', "right(text, 12)", "''")} as new from docs),
turns as (select printf('%012d:%06d', conv_id, turn) as id, * from conversations),
{words('q', 'benchmark', 'item_id', 'text')}, {words('t', 'turns', 'id', 'text')},
{nearest('q', 't', '(case when query_id % 4 = 0 then 5 else query_id % 4 end)')},
t as (select page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as title,
  regexp_replace(html, '(?is)<head.*?</head>|<script.*?</script>|<style.*?</style>', ' ', 'g') as body from pages)
select 'read:' || doc_id as call_id, text as content, false as is_error from docs
union all select 'list:' || doc_id, to_json(names)::varchar, false from docs join (
  select source, list(distinct source || '/' || lang order by source || '/' || lang) as names from docs group by 1) using (source)
union all select 'edit:' || doc_id, coalesce({_ERROR.format('edit_file')} {_edit_error('old', 'path')}, 'Successfully edited file ''' || path || ''''), n <> 1 from e
union all select 'create:' || item_id, 'Successfully created file ''bench/' || item_id || '''', false from benchmark
union all select 'upsert:' || item_id, 'Successfully upserted content with ID: ' || {_TEXT_ID}, false from benchmark
union all select 'search:' || query_id, {_SNIPPET_JSON}::varchar, false from hits join turns using (id) group by query_id
union all select 'web:' || page_id, to_json({{'web': {{'results': [{{'title': title, 'url': url,
  'description': trim(regexp_replace(regexp_replace(body, '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))}}]}}}})::varchar, false from t
union all select 'event:' || event_id, case event_type
    when 'click' then {_ERROR.format('read_file')} 'path is required for read_file'
    when 'view' then {_ERROR.format('vector_search')} 'query is required for vector_search'
    when 'purchase' then {_ERROR.format('edit_file')} 'path and old_str are required for edit_file'
    when 'signup' then {_ERROR.format('vector_upsert')} 'text_content is required for vector_upsert'
    else 'tool not found' end, true from events"""

# Of two creates with equal seq the lower call wins; an even text has no vector and goes to a fallback file.
TOOL_EFFECTS = f"""
with docs as (select *, {DOC_PATH} as path from documents),
e as (select path, {_edited('text', "right(text, 12)", "lang")} as new from docs)
select 'file' as kind, path as name, md5(new) as content_md5 from e
union all select 'file', 'bench/' || item_id, md5('again') from benchmark
union all select distinct 'file', 'vector_store_fallback_' || sha256(text) || '.txt', md5(text) from benchmark where length(text) % 2 = 0
union all select 'snippet', {_TEXT_ID}, md5(text) from benchmark where length(text) % 2 = 1"""

# A new file lies under an old one where the id divides by three; the end of a text may occur in it again.
MIXED_CALLS = f"""
with d as (
  select doc_id, {DOC_PATH} as path, case when doc_id % 3 = 0 then {DOC_PATH} || '/notes' else 'notes/' || doc_id end as new, source, lang, text,
         right(text, 12) as tail, doc_id % 3 = 0 as under from documents),
e as (select *, (strlen(text) - strlen(replace(text, tail, ''))) // nullif(strlen(tail), 0) as n from d),
f as (select *, case when n = 1 then replace(text, tail, '<<end>>') else text end as after, lang as note,
             'file not found at path ''' || new || ''' within workspace' as missing from e),
a as (
  select doc_id || ':0' as name, null as content, missing as error from f
  union all select doc_id || ':1', case when n = 1 then 'Successfully edited file ''' || path || '''' end,
    case when tail = '' then 'path and old_str are required for edit_file' when n = 0 then 'string ''' || tail || ''' not found in file ''' || path || ''''
         when n > 1 then 'string ''' || tail || ''' found multiple times (' || n || ') in file ''' || path || ''', expected exactly one' end from f
  union all select doc_id || ':2', after, null from f
  union all select doc_id || ':3', null, 'file already exists at path ''' || path || '''' from f
  union all select doc_id || ':4', case when not under then 'Successfully created file ''' || new || '''' end,
    case when under then 'failed to create parent directory for ''' || new || '''' end from f
  union all select doc_id || ':5', case when not under then 'Successfully edited file ''' || new || '''' end, case when under then missing end from f
  union all select doc_id || ':6', case when not under then note end, case when under then missing end from f)
select 'answer' as kind, name, md5(content) as content_md5, error from a
union all select 'file', path, md5(after), null from f
union all select 'file', new, md5(note), null from f where not under"""

# Of one id the highest seq, then the last content; the second upsert has no seq and replaces its ids whole.
TABLE_ORDER = """
with r as (select *, printf('%04d', vec_id // 5) as id, printf('%08d', vec_id) as content from embeddings),
first as (select id, arg_max(content, (vec_id % 7, content)) as content, arg_max(label, (vec_id % 7, content)) as label from r group by id),
second as (select id, arg_max('again ' || reverse(content), 'again ' || reverse(content)) as content,
             arg_max(label, 'again ' || reverse(content)) as label from r where (id::int) % 2 = 0 group by id)
select id, content, label::varchar as label from second
union all select id, content, label::varchar from first where id not in (select id from second)"""

TABLE_SEARCH = """
with v as (select vec_id, label, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings),
s as (select q.vec_id as query_id, r.vec_id, round(list_dot_product(q.e, r.e) / (q.n * r.n), 9) as score from v q, v r where r.label = 3),
h as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, printf('%08d', vec_id) as id, round(score, 6) as score, printf('%08d', vec_id) as content from h where rank <= 3"""

WORKSPACE_SOURCE = """
with f as (select source || '/.' || lang || '/' || doc_id as path, strlen(text)::bigint as length, text from documents)
select path, length, case when length <= 5000 then md5(text) end as content_md5,
       case when length > 5000 then 'file too large (>5000 bytes): ' || path end as error
from f where length > 300"""

PARSER = f"""
with d as (select {DOC_PATH} as path, string_split(text, chr(10)) as ls from documents),
l as (select path, i, ls[i] as line from (select path, ls, unnest(range(1, len(ls) + 1)) as i from d where len(ls) > 1))
select path as file_path, i::bigint as start_line, string_split(line, ' ')[1] as symbol, md5(line) as content_md5, null as error
from l where regexp_matches(line, '^[A-Z]')
union all select path, null, null, null, 'failed to parse file: ' || path || ': ValueError: one line' from d where len(ls) = 1"""
