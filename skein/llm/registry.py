"""Queries of this subpackage, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import conversations, leaks, mixture, residue, runs, secrets, spans
from skein.session import table, tune


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    return conversations.session_defects(table(spark, folder, "messages"))


def p1_conversations(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    turns = conversations.conversations(table(spark, folder, "messages"))
    ids = lambda c: F.array_join(c, ",").alias(c)
    return turns.select("session_id", F.col("key.peak_line").alias("waits_for"), "line_index", "speaker", "text", ids("uses"), ids("results"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    found = spans.shared_spans(table(spark, folder, "file_blocks"))
    return found.select("block_id", "start_pos", "end_pos").distinct()


def p2_shares(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    return spans.shared_share(table(spark, folder, "file_blocks"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    return secrets.find_secrets(table(spark, folder, "file_blocks")).select("block_id", "field", "start_pos")


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    blocks = table(spark, folder, "file_blocks")
    return secrets.redact(blocks, secrets.find_secrets(blocks)).select("block_id", "content", "input").distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return runs.repeated_runs(table(spark, folder, "messages"))


def p5_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return runs.collapse_runs(table(spark, folder, "messages"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    return leaks.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    return leaks.leak_report(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    return mixture.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    return mixture.shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(table(spark, folder, "documents")).select("doc_id").distinct()


def p9_kept(spark: SparkSession, folder: str) -> DataFrame:
    return residue.without_residue(table(spark, folder, "documents"))


def p9_templates(spark: SparkSession, folder: str) -> DataFrame:
    mined = residue.mine_templates(table(spark, folder, "documents"))
    kinds = mined.select("template", "sentences", "documents", residue.classify(F.col("template")).alias("kind"))
    return kinds.where(F.col("kind").isNotNull())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (p1_found, p1_conversations, p2_found, p2_shares, p4_found, p4_redacted, p5_found, p5_collapsed, p7_found, p7_report, p8_mix, p8_shares, p9_found, p9_kept, p9_templates)
    return {f.__name__: f for f in named}


LINES = "m as (select distinct session_id, line_index, type, lower(regexp_replace(name, '[^\\p{L}]', '', 'g')) as name_key, is_sidechain, uuid, parent_uuid, blocks, ts from messages where session_id is not null and line_index is not null)"
RUNS = f"""with {LINES}, a as (select session_id, line_index, type, name_key, ts, row_number() over (partition by session_id order by line_index) - row_number() over (partition by session_id, type, name_key order by line_index) as g from m),
 r as (select session_id, type, name_key, min(line_index) as first_line, max(line_index) as last_line, count(*) as events, arg_min(ts_, line_index) as first_ts_, arg_max(ts_, line_index) as last_ts_ from (select *, {{'t': ts}} as ts_ from a) group by session_id, type, name_key, g)"""
DEFECTS = f"""with {LINES}, t as (select *, len(list_filter(coalesce(blocks, []), lambda b: b.type = 'text' and regexp_matches(coalesce(b.text, ''), '\\S'))) > 0 as has_text, len(list_filter(coalesce(blocks, []), lambda b: b.type in ('tool_use', 'tool_result'))) > 0 as tools from m where type in ('user', 'assistant') and not coalesce(is_sidechain, false)),
 e as (select session_id from m group by 1 except select session_id from t where has_text or tools),
 k as (select session_id, line_index, type = 'user' as u from t where type = 'user' and has_text or type = 'assistant' and (has_text or tools)),
 n as (select distinct session_id from (select *, lead(u) over (partition by session_id order by line_index) as next_u from k) where u and coalesce(next_u, true)),
 b as (select session_id, line_index, unnest(blocks) as b from t),
 i as (select session_id, coalesce(case when b.type = 'tool_use' then b.id else b.tool_use_id end, '') as id, max(line_index) filter (b.type = 'tool_use') as last_use, min(line_index) filter (b.type = 'tool_use') as first_use, max(line_index) filter (b.type = 'tool_result') as last_result, min(line_index) filter (b.type = 'tool_result') as first_result from b where b.type in ('tool_use', 'tool_result') group by 1, 2),
 x as (select session_id from i where not coalesce(last_result > last_use and first_use < first_result, false) union select session_id from t where parent_uuid is not null and not exists (select 1 from m where m.session_id = t.session_id and m.uuid = t.parent_uuid))
 select session_id, 'empty' as defect from e union all select session_id, 'no_reply' from n union all select session_id, 'broken' from x"""


SPANS = """with t as (select distinct block_id, f, v from (select block_id, 'content' as f, content as v from file_blocks union all select block_id, 'text', text from file_blocks) where block_id is not null and length(v) >= 200),
 w as (select block_id, f, md5(v) as t, i, md5(substring(v, (i + 1)::bigint, 200)) as s from (select *, unnest(range(length(v) - 199)) as i from t)),
 h as (select w.* from w semi join (select s from w group by s having min(block_id) <> max(block_id)) using (s)),
 r as (select *, sum(fresh) over (partition by block_id, f, t order by i) as run from (select *, (coalesce(i - lag(i) over (partition by block_id, f, t order by i), 1000) > 200)::int as fresh from h))
 select distinct block_id, start_pos, end_pos from (select block_id, f, t, run, min(i)::bigint as start_pos, (max(i) + 200)::bigint as end_pos from r group by all)"""


def _words(text: str) -> str:
    """The normalised words of a text, as `leaks.normalise` gives them: remarks left out, hyphens at line ends joined, case folded."""
    text = f"replace(lower({text}), 'ß', 'ss')"
    for pattern, put in ((r"\([^()\[\]]*\)|\[[^()\[\]]*\]", " "), (r"([\p{L}\p{N}_])[-‐\x{ad}][^\S\n]*\n\s*", r"\1"), (r"[\x{ad}\x{200b}]", ""), (r"[^\p{L}\p{N}\p{M}]+", " ")):
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return f"list_filter(string_split({text}, ' '), lambda x: x <> '')"


def _passages(key: str, table: str) -> str:
    words = f"select distinct {key}, {_words('text')} as w from {table} where {key} is not null and text is not null"
    return f"select distinct {key}, array_to_string(w[k + 1 : k + 25], ' ') as s from (select *, unnest(range(len(w) - 24)) as k from ({words}) where len(w) >= 25)"


def _ids(kind: str, field: str) -> str:
    return f"array_to_string(list_transform(list_filter(coalesce(blocks, []), lambda b: b.type = '{kind}'), lambda b: b.{field}), ',')"


# no line of the tables waits for a later one
TURNS = f"""with bad as ({DEFECTS}), {LINES} select session_id, line_index as waits_for, line_index, type as speaker, array_to_string(list_transform(list_filter(coalesce(blocks, []), lambda b: b.type = 'text'), lambda b: coalesce(b.text, '')), chr(10)) as text,
 {_ids('tool_use', 'id')} as uses, {_ids('tool_result', 'tool_use_id')} as results from m anti join bad using (session_id) where type in ('user', 'assistant') and not coalesce(is_sidechain, false)
 and len(list_filter(coalesce(blocks, []), lambda b: b.type = 'text' and regexp_matches(coalesce(b.text, ''), '\\S') or b.type in ('tool_use', 'tool_result'))) > 0"""
SHARES = f"""with x as (select block_id, f, sum(end_pos - start_pos)::bigint as shared from ({SPANS.replace("select distinct block_id, start_pos, end_pos from", "select * from")}) group by 1, 2),
 a as (select block_id, f, max(length(v))::bigint as chars from (select block_id, 'content' as f, content as v from file_blocks union all select block_id, 'text', text from file_blocks) where block_id is not null and v is not null group by 1, 2)
 select block_id, f as field, chars, coalesce(shared, 0) as shared_chars, case when chars > 0 then coalesce(shared, 0) / chars else 0.0 end as shared_share from a left join x using (block_id, f)"""
LEAKS = f"""with h as (select distinct item_id, doc_id, k from ({_passages('item_id', 'eval_items')}) join ({_passages('doc_id', 'documents').replace("as s from", "as s, k from")}) using (s)),
 r as (select *, sum(fresh) over (partition by item_id, doc_id order by k) as run from (select *, (coalesce(k - lag(k) over (partition by item_id, doc_id order by k), 1000) > 25)::int as fresh from h)),
 w as (select item_id, doc_id, max(k) - min(k) + 25 as words from r group by item_id, doc_id, run), n as (select item_id, count(distinct doc_id) as documents, max(words)::bigint as most_words from w group by 1)
 select item_id, coalesce(documents, 0)::bigint as documents, coalesce(most_words, 0)::bigint as most_words from (select distinct item_id from eval_items where item_id is not null) left join n using (item_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": DEFECTS,
        "p1_conversations": TURNS,
        "p2_found": SPANS,
        "p2_shares": SHARES,
        "p7_report": LEAKS,
        "p7_found": f"select distinct doc_id, item_id from ({_passages('item_id', 'eval_items')}) join ({_passages('doc_id', 'documents')}) using (s)",
        "p5_found": f"{RUNS} select session_id, first_line, last_line from r where events >= 3",
        "p5_collapsed": f"{RUNS} select session_id, type, name_key, first_line, last_line, events, first_ts_.t as first_ts, last_ts_.t as last_ts, (epoch_us(last_ts_.t) - epoch_us(first_ts_.t))::bigint as duration_us from r",
    }
