"""DuckDB SQL of the core's queries, over the same tables, for comparing results."""

from __future__ import annotations

from skein.operators.recap import CLEANING, STOP_WORDS
from skein.operators.tokens import MODEL_WINDOWS

LINES = """m0 as (select distinct session_id, line_index, byte_size, coalesce(parse_error, false) as parse_error, coalesce(type, 'unknown') as type, uuid, coalesce(is_sidechain, false) as side, is_sidechain,
 message_id, coalesce(is_snapshot_update, false) as is_update, operation, root_content, model, usage, coalesce(blocks, []) as blocks, blocks is null as bare
 from messages where session_id is not null and line_index is not null),
m as (select *, row_number() over (partition by session_id order by line_index) - 1 as pos from m0)"""
BLOCKS = f"{LINES}, b as (select session_id, line_index, pos, type as line_type, side, i as block_no, blocks[i + 1] as x from (select *, unnest(range(len(blocks))) as i from m))"
FILES = "f as (select path, max(project) as project, max(session_id) as session_id, max(size) as size, max(mtime) as mtime, max(lines) as lines from session_files where path is not null group by path)"
DOCS = "d as (select distinct source as session_id, doc_id as line_index, text from documents where doc_id is not null and source is not null)"
USAGE = "strlen('{' || array_to_string(list_filter([case when usage.input_tokens is not null then '\"input_tokens\":' || usage.input_tokens end, case when usage.output_tokens is not null then '\"output_tokens\":' || usage.output_tokens end, case when usage.cache_creation_input_tokens is not null then '\"cache_creation_input_tokens\":' || usage.cache_creation_input_tokens end, case when usage.cache_read_input_tokens is not null then '\"cache_read_input_tokens\":' || usage.cache_read_input_tokens end], lambda x: x is not null), ',') || '}')"


def size(text: str) -> str:
    """Bytes of a text as an ASCII JSON string, quotes included."""
    return f"(length({text}) + length(regexp_replace({text}, '[^\"\\\\\\n\\r\\t]', '', 'g')) + 5 * length(regexp_replace({text}, '[\\x00-\\x7F]', '', 'g')) + 2)"


def member(name: str, value: str, bytes_: str) -> str:
    return f"coalesce(case when {value} is not null then {bytes_} + {len(name) + 3} end, 0)"


def block_size(b: str) -> str:
    """Bytes of a block as compact JSON."""
    fields = [(n, f"{b}.{c}", size(f"{b}.{c}")) for n, c in (("type", "type"), ("text", "text"), ("thinking", "thinking"), ("id", "id"), ("name", "name"), ("tool_use_id", "tool_use_id"), ("content", "content_str"))]
    fields += [("input", f"{b}.input", f"(length({b}.input) + 5 * length(regexp_replace({b}.input, '[\\x00-\\x7F]', '', 'g')))"), ("is_error", f"{b}.is_error", f"(case when {b}.is_error then 4 else 5 end)")]
    count = " + ".join(f"({v} is not null)::int" for _, v, _ in fields)
    return f"(2 + {' + '.join(member(*f) for f in fields)} + {count} - 1)"


def text_of(b: str) -> str:
    return f"coalesce(nullif({b}.text, ''), nullif({b}.thinking, ''), nullif({b}.content_str, ''), '')"


CHARS = f"""case when x.type = 'thinking' then 0 when length({text_of('x')}) > 0 then length({text_of('x')}) when x.type in ('tool_use', 'tool_result') then {block_size('x')} else 0 end"""
CONTEXT = f"""{LINES}, c as (select * from m where type not in ('progress', 'file-history-snapshot') and not side and (type <> 'assistant' or len(blocks) = 0 or len(list_filter(blocks, lambda y: y.type in ('text', 'tool_use', 'tool_result'))) > 0)),
 cb as (select session_id, line_index, type, blocks[i + 1] as x from (select *, unnest(range(len(blocks))) as i from c)),
 lc as (select c.session_id, c.line_index, c.type, coalesce(sum({CHARS}), 0) as chars from c left join cb using (session_id, line_index) group by all)"""
HEURISTIC = f"{CONTEXT}, h as (select s.session_id, coalesce(sum(chars), 0)::bigint as chars from (select distinct session_id from m) s left join lc using (session_id) group by 1)"
LAST = "lu as (select session_id, line_index, coalesce(usage.input_tokens, 0) as input_tokens, coalesce(usage.output_tokens, 0) as output_tokens, coalesce(usage.cache_creation_input_tokens, 0) as cache_creation_input_tokens, coalesce(usage.cache_read_input_tokens, 0) as cache_read_input_tokens from m where type = 'assistant' and not side and not parse_error and usage is not null qualify row_number() over (partition by session_id order by line_index desc) = 1)"
TOTAL = "input_tokens + cache_creation_input_tokens + cache_read_input_tokens"
MODEL = "lm as (select session_id, arg_max(model, line_index) as model from m where type = 'assistant' and not side and model <> '' group by 1)"
TEAM = "(?i)team.?name|agent.?id|teammate|team.?lead|SendMessage|TeamCreate|TaskCreate|TaskUpdate|agent.?team|spawn.+teammate|team.+config|subagent_type|run_in_background|resume.*agent"
TOOLS = "'TeamCreate','TeamDelete','TeamMessage','SendMessage','SpawnTeammate','TeamStatus','TaskCreate','TaskUpdate','TaskList','TaskGet','Task','TaskOutput','TaskStop'"
TURNS = f"""{BLOCKS}, u as (select session_id, line_index, trim(regexp_replace(string_agg({text_of('x')}, ' ' order by block_no), '\\s+', ' ', 'g')) as topic from b where line_type = 'user' and x.type = 'text' group by all),
 t as (select session_id, line_index, topic from u where length(topic) >= 3 qualify row_number() over (partition by session_id, lower(left(topic, 40)) order by line_index) = 1)"""
STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
GONE = "p as (select *, lead(type) over (partition by session_id order by pos) as next_type from m)"


def runs(opens: str, belongs: str, least: int, extra: str = "") -> str:
    """Rows strictly inside runs, over a relation r(session_id, line_index, pos, ...)."""
    return f"""g as (select *, {opens} as opens, {belongs} as belongs from r), k as (select *, sum((not belongs)::int) over (partition by session_id order by pos) as island from g),
 s as (select *, min(case when opens then pos end) over (partition by session_id, island) as first_pos, max(case when belongs then pos end) over (partition by session_id, island) as last_pos from k where belongs),
 z as (select * from s where pos > first_pos and pos < last_pos and last_pos - first_pos + 1 >= {least} {extra})"""


HTTP = "('WebFetch', 'WebSearch', 'webfetch', 'websearch')"
CALLS = f"""r0 as (select *, len(list_filter(blocks, lambda y: y.type = 'tool_use' and y.name in {HTTP})) > 0 as h, len(list_filter(blocks, lambda y: y.type in ('tool_use', 'tool_result'))) > 0 as tools from m),
 r as (select *, coalesce(lag(h) over (partition by session_id order by pos), false) as prev_h from r0)"""


def trimmed(text: str, most: int, lead: str, note: str) -> str:
    half = most // 2
    return f"left({text}, {half}) || '{lead}... [' || (strlen({text}) - {most}) || ' bytes trimmed by skein] ...{note}' || right({text}, {half})"


def rewritten(new: str, where: str, kind: str, field: str, source: str = DOCS) -> str:
    """Documents rewritten where that saves bytes; the frame of a line is 100 bytes."""
    frame = 100 + 2 + len('{"type":"') + len(kind) + len('","') + len(field) + len('":') + 1
    return f"with {source}, n as (select *, {new} as t from d where {where}) select session_id, line_index, t as text, ({size('t')} + {frame})::bigint as pruned_bytes from n where {size('text')} > {size('t')}"


EVENTS = "e as (select user_id::varchar as session_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::bigint as n, event_type as kind, props->>'$.k' as k from events)"
WINDOW = "coalesce(" + ", ".join([f"case when model = '{m}' then {n} end" for m, n in MODEL_WINDOWS] + [f"case when starts_with(model, '{m}') then {n} end" for m, n in MODEL_WINDOWS]) + ", 200000)::bigint"
NOTE = "[stale read - file was later edited, trimmed by skein]"
VALID = "c0 as (select distinct path, line_index, call_id, name, input from team_calls where path is not null and line_index is not null and json_valid(input))"
TAGGED = "'<system-reminder>' || {0} || '</system-reminder>'"


def themes() -> str:
    """Five rounds of the greedy cover, one after the other."""
    parts = [f"""{TURNS}, w as (select distinct session_id, line_index, unnest(regexp_extract_all(lower(topic), '[a-z][a-z_-]+')) as word from t),
 pw as (select w.* from w semi join (select session_id from t group by 1 having count(*) >= 6) using (session_id) where length(word) > 2 and word not in ({STOP})),
 o0 as (select pw.*, topics from pw join (select session_id, word, count(*) as topics from pw group by 1, 2 having count(*) >= 2) using (session_id, word))"""]
    for r in range(1, 6):
        parts.append(f"b{r} as (select session_id, {r} as rank, word as theme, topics from (select session_id, word, topics from o{r - 1} group by all having count(*) >= 2) qualify row_number() over (partition by session_id order by topics desc, word) = 1)")
        parts.append(f"o{r} as (select * from o{r - 1} anti join (select pw.session_id, pw.line_index from pw join b{r} on b{r}.session_id = pw.session_id and b{r}.theme = pw.word) using (session_id, line_index))")
    return f"with {', '.join(parts)} " + " union all ".join(f"select * from b{r}" for r in range(1, 6))


def cleaned(text: str) -> str:
    for pattern, put in CLEANING:
        if pattern.startswith("(?U)"):  # white space of all scripts
            pattern = pattern.replace("\\s", r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
        pattern = pattern.replace("(?d)", "").replace("(?U)", "").replace("'", "''")
        text = f"regexp_replace({text}, '{pattern}', '{put.replace('$1', chr(92) + '1')}', 'g')"
    return text


def formatted(number: str, unit: int, small: str, names: tuple[str, str]) -> str:
    return f"case when {number} < {unit} then {small} when {number} < {unit * unit} then format('{{:.1f}}{names[0]}', round({number} / {unit}.0, 1)) else format('{{:.2f}}{names[1]}', round({number} / {unit * unit}.0, 2)) end"


DRIFT = """with recursive c as (select distinct path, name, call_id, input from team_calls where path is not null and name is not null and json_valid(input) and json_type(input) = 'OBJECT'),
 w as (select path, name, '' as f, input::json as j from c
  union all select path, name, case when kind = 'ARRAY' then f || '[]' when f = '' then k else f || '.' || k end, v from (select *, case when kind = 'OBJECT' then json_extract(j, '$."' || k || '"') else json_extract(j, '$[' || k || ']') end as v
   from (select *, unnest(case when kind = 'OBJECT' then json_keys(j) else range(json_array_length(j)::bigint)::varchar[] end) as k from (select *, json_type(j) as kind from w) where kind = 'OBJECT' or kind = 'ARRAY' and list_has_any(json_type(j, '$[*]'), ['OBJECT', 'ARRAY'])))
  where kind = 'OBJECT' or json_type(v) in ('OBJECT', 'ARRAY')),
 l as (select path, name, f, j->>'$' as v, case when t = 'VARCHAR' then 'string' when t in ('BOOLEAN', 'ARRAY') then lower(t) else 'number' end as kind
  from (select *, json_type(j) as t from w where f <> '') where t not in ('OBJECT', 'NULL') and not (t = 'ARRAY' and list_has_any(json_type(j, '$[*]'), ['OBJECT', 'ARRAY']))),
 k as (select path, name, f, kind from (select path, name, f, kind, count(*) as n from l group by all) qualify row_number() over (partition by path, name, f order by n desc, list_position(['string', 'number', 'boolean', 'array'], kind)) = 1),
 s as (select x.path, x.name, project, row_number() over (partition by project, x.name order by mtime nulls first, x.path) as no from (select distinct path, name from c) x join (select path, max(project) as project, max(mtime) as mtime from session_files where path is not null group by 1) using (path)),
 p as (select b.path, b.name, a.path as old from s a join s b on a.project is not distinct from b.project and a.name = b.name and b.no = a.no + 1),
 o as (select p.path, p.name, k.f, k.kind from p join k on k.path = p.old and k.name = p.name), n as (select p.path, p.name, k.f, k.kind from p join k on k.path = p.path and k.name = p.name),
 b as (select path, name, f, o.kind as old_kind, n.kind as new_kind from o full join n using (path, name, f)),
 ov as (select distinct b.path, b.name, b.f, old_kind, l.v from b join p using (path, name) join l on l.path = p.old and l.name = b.name and l.f = b.f where new_kind is null),
 nv as (select distinct b.path, b.name, b.f, new_kind, l.v from b join l using (path, name, f) where old_kind is null),
 r as (select ov.path, ov.name, ov.f as old_field, nv.f as new_field, old_kind, new_kind from ov join nv using (path, name, v) join (select path, name, f, count(*) as n from nv group by all) z on z.path = nv.path and z.name = nv.name and z.f = nv.f group by all having count(*) >= any_value(z.n) * 0.5)
 select path, name, 'renamed' as change, old_field, new_field from r union all select path, name, 'retyped', old_field, new_field from r where old_kind <> new_kind
 union all select path, name, 'retyped', f, f from b where old_kind <> new_kind union all select path, name, 'removed', f, '' from b where new_kind is null and not exists (select 1 from r where r.path = b.path and r.name = b.name and r.old_field = b.f)
 union all select path, name, 'added', '', f from b where old_kind is null and not exists (select 1 from r where r.path = b.path and r.name = b.name and r.new_field = b.f)"""
ELEMENTS = """with recursive l as (select distinct line_id, json_extract(raw, '$.message') as m from transcript_lines where line_id is not null and json_valid(raw) and json_type(raw) = 'OBJECT'),
 s as (select line_id, case when json_type(m) = 'VARCHAR' then case when starts_with(ltrim(m->>'$'), '{') and json_valid(m->>'$') then (m->>'$')::json end when json_type(m) in ('OBJECT', 'ARRAY') then m end as j from l),
 w as (select line_id, '' as path, '' as up, false as element, j from s where j is not null
  union all select line_id, case when kind = 'OBJECT' then case when path = '' then k else path || '.' || k end else path || '[' || k || ']' end, case when element and kind = 'OBJECT' then path else up end, kind = 'ARRAY', v
  from (select *, case when kind = 'OBJECT' and k in ('message', 'input') and json_type(c) = 'VARCHAR' and starts_with(ltrim(c->>'$'), '{') and json_valid(c->>'$') then (c->>'$')::json else c end as v
   from (select *, case when kind = 'OBJECT' then json_extract(j, '$."' || k || '"') else json_extract(j, '$[' || k || ']') end as c
    from (select *, unnest(case when kind = 'OBJECT' then json_keys(j) else range(json_array_length(j)::bigint)::varchar[] end) as k from (select *, json_type(j) as kind from w) where kind in ('OBJECT', 'ARRAY'))))
  where json_type(v) in ('OBJECT', 'ARRAY'))
 select distinct line_id, path as node_path, up as parent_path from w where element and json_type(j) = 'OBJECT'"""

SQL: dict[str, str] = {
    "p3_found": DRIFT,
    "p6_found": ELEMENTS,
    "session_catalog": f"with {FILES} select * from f",
    "catalog_totals": f"with {FILES} select project, count(*) as sessions, sum(size)::bigint as bytes from f group by 1",
    "newest_session": f"with {FILES} select path, mtime from f where mtime is not null order by mtime desc, path limit 1",
    "resolve_prefix": f"with {FILES} select session_id, path from f where starts_with(session_id, 'a') order by session_id <> 'a', project, path limit 1",
    "tail_match": f"with {DOCS}, r as (select * from d qualify row_number() over (partition by session_id order by line_index desc) <= 2) select session_id, bool_or(coalesce(contains(text, 'crowns'), false)) as found from r group by 1",
    "tail_match_50": f"with {DOCS}, r as (select * from d qualify row_number() over (partition by session_id order by line_index desc) <= 50) select session_id, bool_or(coalesce(contains(text, 'crowns'), false)) as found from r group by 1",
    "overflow_sessions": f"with {BLOCKS}, x1 as (select session_id, line_index, string_agg({text_of('x')}, ' ') as t from b group by all), r as (select m.session_id, m.line_index, coalesce(t, '') as t from m left join x1 using (session_id, line_index) qualify row_number() over (partition by m.session_id order by m.line_index desc) <= 20) select session_id, bool_or(contains(t, 'after the last merge')) as found from r group by 1",
    "session_totals": f"with {LINES} select session_id, count(*) as messages, sum(byte_size)::bigint as bytes from m group by 1",
    "type_stats": f"with {LINES} select session_id, type, count(*) as messages, sum(byte_size)::bigint as bytes from m group by 1, 2",
    "largest_messages": f"with {LINES} select session_id, (row_number() over (partition by session_id order by byte_size desc, line_index desc))::int as rank, line_index, type, byte_size from m qualify rank <= 10",
    "block_stats": f"""with {BLOCKS}, s as (select session_id, sum(case when x.type = 'thinking' then {size("coalesce(x.thinking, '')")} else 0 end)::bigint as thinking_bytes, 0::bigint as signature_bytes,
 sum(case when x.type = 'tool_result' then coalesce(strlen(x.content_str), 0) else 0 end)::bigint as tool_result_bytes, sum(len(regexp_extract_all({text_of('x')}, '(?s)<system-reminder>.*?</system-reminder>')))::bigint as reminders from b group by 1),
 c as (select session_id, count(*) filter (type = 'progress') as progress, count(*) filter (type = 'file-history-snapshot') as snapshots from m group by 1)
 select session_id, coalesce(thinking_bytes, 0) as thinking_bytes, coalesce(signature_bytes, 0) as signature_bytes, coalesce(tool_result_bytes, 0) as tool_result_bytes, progress, snapshots, coalesce(reminders, 0) as reminders from c left join s using (session_id)""",
    "progress_collapse": f"with {LINES}, {GONE} select session_id, line_index from p where type = 'progress' and next_type = 'progress'",
    "collapse_savings": f"with {LINES}, {GONE} select 'progress-collapse' as strategy, session_id, sum(byte_size)::bigint as original_bytes, coalesce(sum(byte_size) filter (type = 'progress' and next_type = 'progress'), 0)::bigint as saved_bytes, count(*) filter (type = 'progress' and next_type = 'progress') as removed, 0::bigint as replaced from p group by session_id",
    "file_history_dedup": f"""with {LINES}, s as (select *, type = 'file-history-snapshot' as snap, type = 'file-history-snapshot' and is_update as upd from m), o as (select *, coalesce(lead(upd) over (partition by session_id order by pos), false) as next_upd from s),
 older as (select session_id, line_index from o where snap and message_id <> '' qualify row_number() over (partition by session_id, message_id order by line_index desc) > 1)
 select session_id, line_index, 'file-history-dedup' as reason from older union all select session_id, line_index, 'file-history-update-run' from o anti join older using (session_id, line_index) where upd and next_upd""",
    "metadata_strip": f"with {LINES} select session_id, line_index, (byte_size - (5 + 4 + {USAGE}))::bigint as pruned_bytes from m where usage is not null",
    "apply_removals": f"with {LINES}, {GONE} select session_id, line_index, (byte_size - coalesce(5 + 4 + case when usage is not null then {USAGE} end, 0))::bigint as byte_size from p where not coalesce(type = 'progress' and next_type = 'progress', false)",
    "prescription_gentle": f"""with {LINES}, {GONE}, a as (select *, row_number() over (partition by session_id order by line_index) as q from p where not coalesce(type = 'progress' and next_type = 'progress', false)),
 s as (select *, type = 'file-history-snapshot' as snap, type = 'file-history-snapshot' and is_update as upd from a),
 o as (select *, coalesce(lead(upd) over (partition by session_id order by q), false) as next_upd, case when snap and message_id <> '' then row_number() over (partition by session_id, snap and message_id <> '', message_id order by line_index desc) else 1 end as rn from s)
 select session_id, count(*) as messages, sum(byte_size - coalesce(5 + 4 + case when usage is not null then {USAGE} end, 0))::bigint as bytes from o where rn = 1 and not (upd and next_upd) group by 1""",
    "thinking_remove": f"""with {BLOCKS}, t as (select session_id, line_index, count(*) filter (x.type <> 'thinking') as left_over, count(*) as n, sum(case when x.type = 'thinking' then {block_size('x')} else 0 end) as gone from b where line_type = 'assistant' group by all having count(*) filter (x.type = 'thinking') > 0)
 select t.session_id, t.line_index, left_over::int as blocks_left, (byte_size - gone - (greatest(n - 1, 0) - greatest(left_over - 1, 0)))::bigint as pruned_bytes from t join m using (session_id, line_index)""",
    "thinking_signature_only": f"with {DOCS} select session_id, line_index, (100 + 2 + 2 + 17 + 1 + 11 + {size('text')})::bigint as pruned_bytes from d where text is not null",
    "signature_stats": f"with {DOCS} select session_id, sum({size("coalesce(text, '')")})::bigint as thinking_bytes, coalesce(sum(strlen(left(text, 40))), 0)::bigint as signature_bytes from d group by 1",
    "thinking_truncate": rewritten("left(text, 200) || '...[truncated]'", "length(text) > 200", "thinking", "thinking"),
    "output_trim_bytes": rewritten(
        "case when len(string_split(text, chr(10))) > 100 then array_to_string(list_concat(string_split(text, chr(10))[:50], [chr(10) || '... [' || (len(string_split(text, chr(10))) - 100) || ' lines trimmed by skein] ...' || chr(10)], string_split(text, chr(10))[-50:]), chr(10)) else "
        + trimmed("text", 1024, "' || chr(10) || '", "' || chr(10) || '") + " end", "strlen(text) > 1024 or len(string_split(text, chr(10))) > 100", "tool_result", "content"),
    "output_trim_lines": rewritten(
        "case when len(string_split(text, chr(10))) > 10 then array_to_string(list_concat(string_split(text, chr(10))[:5], [chr(10) || '... [' || (len(string_split(text, chr(10))) - 10) || ' lines trimmed by skein] ...' || chr(10)], string_split(text, chr(10))[-5:]), chr(10)) else "
        + trimmed("text", 8192, "' || chr(10) || '", "' || chr(10) || '") + " end", "strlen(text) > 8192 or len(string_split(text, chr(10))) > 10", "tool_result", "content"),
    "mega_trim": rewritten(trimmed("text", 2048, "' || chr(10) || chr(10) || '", "' || chr(10) || chr(10) || '"), "strlen(text) > 2048", "text", "text"),
    "document_dedup": rewritten("'[duplicate content removed by skein - first seen earlier: ' || replace(left(text, 80), chr(10), ' ') || '...]'", "again", "text", "text",
        "d0 as (select distinct source as session_id, doc_id as line_index, text from documents where doc_id is not null and source is not null), d as (select *, row_number() over (partition by session_id, md5(text) order by line_index) > 1 as again from d0 where strlen(text) >= 300)"),
    "file_events": f"with {BLOCKS} select session_id, line_index, block_no::int as block_no, json_extract_string(x.input, '$.file_path') as path, x.name in ('Edit', 'edit', 'Write', 'write') as edit from b where x.type = 'tool_use' and x.name in ('Read', 'read', 'Edit', 'edit', 'Write', 'write') and json_extract_string(x.input, '$.file_path') <> ''",
    "stale_read_lines": f"with {EVENTS} select distinct r.session_id, r.n as line_index from e r join e w on w.session_id = r.session_id and w.k = r.k and w.kind = 'purchase' and w.n > r.n where r.kind = 'view'",
    "stale_reads": f"""with {EVENTS}, s as (select distinct r.session_id, r.n, r.k from e r join e w on w.session_id = r.session_id and w.k = r.k and w.kind = 'purchase' and w.n > r.n where r.kind = 'view')
 select distinct c.session_id, c.n as line_index, {100 + 2 + 52 + len(NOTE) + 1}::bigint as pruned_bytes from e c join s on s.session_id = c.session_id and s.k::int % 3 = c.k::int % 3 and c.n between s.n + 1 and s.n + 4 where c.kind = 'click'""",
    "read_results": f"with {BLOCKS} select r.session_id, r.line_index as read_line, t.line_index, r.x.id as id from b r join b t on t.session_id = r.session_id and t.x.type = 'tool_result' and t.x.tool_use_id = r.x.id and t.pos between r.pos + 1 and r.pos + 4 where r.x.type = 'tool_use' and r.x.name in ('Read', 'read') and r.x.id <> ''",
    "reminder_copies": f"""with {DOCS}, o as (select session_id, line_index, regexp_extract_all(text, '\\([^()]*\\)') as all_ from d), x as (select session_id, line_index, i, md5('<system-reminder>' || all_[i + 1] || '</system-reminder>') as h from (select *, unnest(range(len(all_))) as i from o)),
 y as (select *, row_number() over (partition by session_id, h order by line_index, i) > 1 as again from x) select session_id, line_index, count(*) as reminders, count(*) filter (again) as again from y group by 1, 2""",
    "http_runs": f"with {LINES}, {CALLS}, {runs('h', chr(40) + 'h or type = ' + chr(39) + 'progress' + chr(39) + ' or tools and prev_h' + chr(41), 4)} select session_id, line_index from z where type = 'progress'",
    "poll_runs": f"""with {LINES}, q as (select *, type = 'queue-operation' and coalesce(operation in ('check', 'poll'), false) as poll from m), q2 as (select *, coalesce(lead(poll) over (partition by session_id order by pos), false) as next_poll from q),
 r as (select *, len(list_filter(blocks, lambda y: y.type = 'tool_use' and y.name in ('TaskOutput', 'taskoutput') and json_extract(y.input, '$.block')::varchar = 'false')) > 0 as h from m), {runs('h', "(h or type = 'progress')", 3)}
 select distinct session_id, line_index, 'queue-poll' as reason from q2 where poll and next_poll union all select distinct session_id, line_index, 'task-poll' from z""",
    "error_retry": """with e as (select user_id::varchar as session_id, row_number() over (partition by user_id order by ts, event_id) - 1 as n, event_type as k, event_type = 'error' as err from events),
 l as (select *, not err and coalesce(lead(err) over w, false) and not coalesce(lead(err, 2) over w, true) and lead(k, 2) over w = k as link, lag(n) over w as before from e window w as (partition by session_id order by n)),
 c as (select *, lag(link) over (partition by session_id order by n) as prev_link from l where not err), x as (select * from c where link and prev_link)
 select distinct session_id, n::bigint as line_index from (select session_id, n from x union all select session_id, before from x)""",
    "constant_fields": f"with {LINES} select session_id, 'isSidechain' as fields from m where is_sidechain is not null group by 1 having count(distinct is_sidechain) = 1",
    "envelope_strip": f"with {LINES}, c as (select session_id from m where is_sidechain is not null group by 1 having count(distinct is_sidechain) = 1) select session_id, line_index, (byte_size - (11 + strlen(is_sidechain::varchar) + 4))::bigint as pruned_bytes from m semi join c using (session_id) where pos > 0 and is_sidechain is not null",
    "token_heuristic": f"with {HEURISTIC} select session_id, chars, (trunc(chars / 3.7) + 21000)::bigint as tokens from h",
    "token_breakdown": f"with {CONTEXT} select session_id, type, trunc(sum(chars) / 3.7)::bigint as tokens from lc group by 1, 2",
    "last_usage": f"with {LINES}, {LAST} select *, {TOTAL} as total from lu",
    "last_model": f"with {LINES}, {MODEL} select * from lm",
    "token_estimate": f"with {HEURISTIC}, {LAST}, {MODEL}, e as (select h.session_id, coalesce({TOTAL}, (trunc(chars / 3.7) + 21000)::bigint) as total, lu.session_id is null as guessed, model, {WINDOW} as context_window from h left join lu using (session_id) left join lm using (session_id)) select session_id, total, round(total / context_window * 100, 1) as context_pct, case when guessed then 'heuristic' else 'exact' end as method, case when guessed then 'medium' else 'high' end as confidence, model, context_window from e",
    "model_windows": f"select distinct model, {WINDOW} as \"window\" from messages where model is not null",
    "calibration": f"with {HEURISTIC}, {LAST} select h.session_id, case when {TOTAL} > 21000 then round(chars / ({TOTAL} - 21000), 2) end as chars_per_token from h left join lu using (session_id)",
    "tail_tokens": f"with {LINES.replace('m as (', 'm1 as (')}, m as (select *, sum(byte_size + 1) over (partition by session_id order by line_index desc) as behind from m1 qualify behind <= 5000), {LAST} select session_id, {TOTAL} as total from lu",
    "tail_tokens_50k": f"with {LINES.replace('m as (', 'm1 as (')}, m as (select *, sum(byte_size + 1) over (partition by session_id order by line_index desc) as behind from m1 qualify behind <= 51200), {LAST} select session_id, {TOTAL} as total from lu",
    "model_window_lookup": "select p_partkey, (case when starts_with(p_type, 'STANDARD ANODIZED') then 1 when starts_with(p_type, 'STANDARD') then 2 when starts_with(p_type, 'PROMO') then 3 when starts_with(p_type, 'ECONOMY BURNISHED') then 4 else 9 end)::bigint as \"window\" from part",
    "team_filter": f"with {BLOCKS} select distinct session_id, line_index from b where line_type <> 'queue-operation' and (x.type = 'tool_use' and x.name in ({TOOLS}) or x.type = 'tool_result' and regexp_matches(x.content_str, '{TEAM}') or x.type = 'text' and regexp_matches(x.text, '{TEAM}')) union select session_id, line_index from m where type = 'queue-operation' and contains(root_content, '<task-notification>')",
    "task_upsert": """with e0 as (select distinct path, line_index, call_id, name, input from team_calls where name in ('TaskCreate', 'TaskUpdate') and json_valid(input)),
 e as (select path, coalesce(input->>'$.taskId', input->>'$.id', '') as task_id, row_number() over (order by line_index, call_id) as n, name = 'TaskCreate' as created, coalesce(input->>'$.subject', input->>'$.title') as subject, input->>'$.status' as status, input->>'$.owner' as owner, input->>'$.description' as description from e0),
 s as (select *, max(case when created then n end) over (partition by path, task_id) as start from e), r as (select * from s where start is null or n >= start)
 select path, task_id, coalesce(arg_max(subject, n) filter (subject <> ''), '') as subject, coalesce(arg_max(status, n) filter (not created and status <> ''), case when bool_or(created) then 'pending' else 'unknown' end) as status, coalesce(arg_max(owner, n) filter (owner <> ''), '') as owner, coalesce(arg_max(description, n) filter (created), '') as description from r group by 1, 2""",
    "config_merge": "select coalesce(c_custkey, s_suppkey)::varchar as agent_id, coalesce(c_name, s_name) as name, case when s_suppkey is not null then 'supplier' else '' end as role, case when s_suppkey is not null then 'm' else '' end as model, case when s_suppkey is not null then '/s' else '' end as cwd, case when c_custkey is not null then 'running' else 'config' end as status from customer full join supplier on c_custkey = s_suppkey",
    "word_coverage": f"with {TURNS}, w as (select distinct session_id, line_index, unnest(regexp_extract_all(lower(topic), '[a-z][a-z_-]+')) as word from t) select session_id, word, count(*) as topics from w where length(word) > 2 and word not in ({STOP}) group by 1, 2 having count(*) >= 2",
    "topic_dedup": f"with {TURNS} select * from t",
    "recent_topics": f"with {TURNS} select session_id, (row_number() over (partition by session_id order by line_index desc))::int as rank, line_index, greatest(count(*) over (partition by session_id) - 8, 0) as earlier from t qualify rank <= 8",
    "health_checks": f"""with {FILES}, k as (select size, starts_with(session_id, 'b') as bak from f), a as (select * from k where not coalesce(bak, false)) select 'large-sessions' as name, case when count(*) filter (size > 5242880) > 0 then 'warning' else 'ok' end as status, coalesce(sum(size) filter (size > 5242880), 0)::bigint as bytes, count(*) filter (size > 5242880) as sessions from a
 union all select 'backups', case when sum(size) > 10485760 then 'warning' else 'ok' end, coalesce(sum(size), 0)::bigint, count(*) from k where bak union all select 'disk-usage', case when sum(size) < 52428800 then 'ok' when sum(size) < 209715200 then 'warning' else 'issue' end, coalesce(sum(size), 0)::bigint, count(*) from a""",
    "oversized": f"with {FILES} select path, size from f where size > 5242880 order by size desc, path limit 5",
    "breaker_window": """with e as (select user_id as key, floor(epoch_us(ts) / 1000000)::bigint as "at", event_id from events where event_type = 'error'), w as (select *, count(*) over (partition by key order by "at" range between 86400 preceding and current row) as recent from e) select key, "at", event_id, recent, recent <= 3 as allowed, case when recent = 1 then 'gentle' when recent = 2 then 'standard' else 'aggressive' end as prescription from w""",
    "guard_tiers": f"with {FILES} select path, case when size >= 5000000 then 'hard' when size >= 3000000 then 'soft' else 'none' end as tier, case when length(project) > 12 then left(project, 9) || '...' else project end as short from f",
    "guard_stream": "with s as (select session_id, sum(byte_size)::bigint as bytes from messages group by 1) select session_id, bytes, case when bytes >= 20000 then 'hard' else 'soft' end as tier from s where bytes >= 12000",
    "types_by_bytes": f"with {LINES}, g as (select session_id, type, count(*) as messages, sum(byte_size)::bigint as bytes from m group by 1, 2) select session_id, (row_number() over (partition by session_id order by bytes desc, type))::int as rank, type, messages, bytes from g",
    "reminder_dedup": f"""with {DOCS}, o as (select session_id, line_index, text, regexp_replace(text, '(\\([^()]*\\))', '<system-reminder>\\1</system-reminder>', 'g') as t, regexp_extract_all(text, '\\([^()]*\\)') as all_ from d),
 x as (select session_id, line_index, i, {TAGGED.format("all_[i + 1]")} as r from (select *, unnest(range(len(all_))) as i from o)), y as (select *, row_number() over (partition by session_id, r order by line_index, i) > 1 as again from x),
 g as (select session_id, line_index, list(distinct r) filter (again) as gone from y group by 1, 2 having bool_or(again)),
 n as (select session_id, line_index, t, regexp_replace(regexp_replace(list_reduce(list_prepend(t, gone), lambda a, b: replace(a, b, '')), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as new from o join g using (session_id, line_index))
 select session_id, line_index, new as text, ({size("new")} + {100 + 2 + 2 + 13 + 1 + 7})::bigint as pruned_bytes from n where {size("t")} > {size("new")}""",
    "themes": themes(),
    "clean_texts": "with d as (select distinct doc_id, text from documents where doc_id is not null and text is not null) select doc_id, " + cleaned("'<system-reminder>' || left(text, 9) || chr(10) || '</system-reminder># **' || left(text, 30) || '** <b>out</b> [Request interrupted by user] <br/>' || text") + " as text from d",
    "formats": f"with {FILES} select path, {formatted('size', 1024, "size || 'B'", ('KB', 'MB'))} as bytes, {formatted('lines', 1000, 'lines::varchar', ('K', 'M'))} as lines, '[' || repeat('=', least(greatest(round(size / 1e5 / 100 * 20), 0), 20)::int) || repeat('-', 20 - least(greatest(round(size / 1e5 / 100 * 20), 0), 20)::int) || '] ' || round(size / 1e5)::bigint || '%' as bar, replace(project, '-', '/') as cwd from f",
    "team_state": f"""with {VALID}, c as (select path as session_id, line_index, row_number() over (partition by path, line_index order by call_id) as b, call_id, name, input from c0 where name in ({TOOLS})),
 t as (select session_id, count(distinct case when name in ('TaskCreate', 'TaskUpdate') then coalesce(input->>'$.taskId', input->>'$.id', case when name = 'TaskCreate' then call_id end, '') end) as tasks, coalesce(arg_max(input->>'$.name', (line_index, b)) filter (name = 'TeamCreate' and input->>'$.name' is not null), '') as team_name, count(distinct line_index) as messages, max(line_index) as last_line from c group by 1),
 m as (select session_id, count(distinct agent) as teammates from (select session_id, coalesce(x->>'$.agentId', x->>'$.agent_id') as agent from (select session_id, unnest(json_extract(input, '$.teammates[*]')) as x from c where name = 'TeamCreate')) where agent <> '' group by 1)
 select session_id, team_name, coalesce(teammates, 0) as teammates, tasks, messages, last_line from t left join m using (session_id)""",
    "subagents": f"""with {VALID}, c as (select path as session_id, line_index, call_id, name, input, coalesce(nullif(input->>'$.taskId', ''), case when name = 'TaskCreate' then call_id end) as agent_id from c0 where name in ('TaskCreate', 'TaskUpdate')),
 s as (select session_id, agent_id, arg_max({{'d': coalesce(input->>'$.subject', '')}}, (line_index, call_id)) as d, max((line_index, call_id)) as called from c where name = 'TaskCreate' group by 1, 2),
 u as (select session_id, agent_id, max((line_index, call_id)) as stopped from c where name = 'TaskUpdate' group by 1, 2)
 select session_id, agent_id, 'worker' as subagent_type, d.d as description, case when stopped > called then 'stopped' else 'running' end as status, '' as result from s left join u using (session_id, agent_id)""",
}

SQL["diagnose"] = f"select * from ({SQL['session_totals']}) join ({SQL['block_stats']}) using (session_id) join ({SQL['token_estimate']}) using (session_id)"
