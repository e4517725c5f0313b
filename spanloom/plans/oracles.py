"""Expected answers in DuckDB SQL, straight from the source tables.

None of these builds attributes or JSON: each states what a row of the source
must come out as, so it checks the engine instead of repeating it.
"""

from __future__ import annotations

from spanloom.functions import attribute_keys as K

BASE = 1_704_067_200
BASE_NS = f"{BASE}::BIGINT * 1000000000"

# --- spans ---------------------------------------------------------------------

EVENTS = """
ev AS (
  SELECT event_id AS e, user_id AS u, event_type AS y, event_id % 4 AS d,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         epoch_us(ts) * 1000 + event_id % 1000 AS start_ns,
         CAST(round(value * 1e6) AS BIGINT) AS duration_ns,
         CASE WHEN event_id % 250 = 249 THEN '' ELSE printf('%032x', event_id // 5) END AS trace_id,
         printf('%016x', event_id) AS span_id,
         'svc-' || (user_id % 4) AS service_name
  FROM events
)"""

STATUS = "CASE y WHEN 'error' THEN 2 WHEN 'click' THEN 1 WHEN 'purchase' THEN 1 WHEN 'view' THEN 0 END"
STATUS_TEXT = (
    "CASE y WHEN 'error' THEN 'Error' WHEN 'click' THEN 'Ok' WHEN 'purchase' THEN 'Ok'"
    " WHEN 'view' THEN 'Unset' ELSE 'ok' END"
)
MODEL = (
    "CASE d WHEN 0 THEN 'model-' || (u % 3) WHEN 1 THEN 'oi-' || (u % 2)"
    " WHEN 3 THEN 'native-' || (u % 2) ELSE '' END"
)
PROMPT_TOKENS = "CASE d WHEN 0 THEN k WHEN 1 THEN 2 * k WHEN 2 THEN 0 ELSE k END"
COMPLETION_TOKENS = "CASE d WHEN 0 THEN k + 1 WHEN 1 THEN k + 3 ELSE k END"
DAY = "strftime(make_timestamp(start_ns // 1000), '%Y-%m-%d')"
PROMPT_COUNT = (
    "CASE d WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 2"
    " ELSE CASE WHEN y = 'signup' THEN 0 ELSE 1 END END"
)
COMPLETION_COUNT = (
    "CASE d WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2"
    " ELSE CASE WHEN y = 'signup' THEN 0 ELSE 1 END END"
)

SERVICE_USAGE = f"""
WITH {EVENTS}
SELECT service_name, {MODEL} AS model, count(*) AS spans,
       count(*) FILTER (WHERE y = 'error') AS failed,
       CAST(sum({PROMPT_TOKENS}) AS BIGINT) AS prompt_tokens,
       CAST(sum({COMPLETION_TOKENS}) AS BIGINT) AS completion_tokens
FROM ev GROUP BY 1, 2"""

SPANS_SCALAR = f"""
WITH {EVENTS}
SELECT service_name, trace_id, span_id,
       CASE WHEN e % 5 = 0 THEN '' ELSE printf('%016x', e - e % 5) END AS parent_span_id,
       'op ' || y AS span_name, start_ns, start_ns + duration_ns AS end_ns, duration_ns,
       {STATUS} AS status_code,
       CASE WHEN y = 'error' THEN 'failed ' || k ELSE '' END AS status_message,
       CASE WHEN y = 'error' THEN 'Timeout' ELSE '' END AS exception_type,
       CASE WHEN y = 'error' THEN 'm' || k ELSE '' END AS exception_message,
       {MODEL} AS model,
       CASE d WHEN 0 THEN 'wf-' || (u % 5) WHEN 1 THEN 'twf-' || (u % 3) ELSE '' END AS workflow,
       CASE d WHEN 0 THEN 'task-' || (k % 3) WHEN 1 THEN 'node-' || (k % 4) ELSE '' END AS task,
       'conv-' || u AS conversation_id,
       {PROMPT_TOKENS} AS prompt_tokens, {COMPLETION_TOKENS} AS completion_tokens,
       CASE WHEN d = 0 AND y <> 'error' THEN 2 * k + 1 WHEN d = 1 THEN 3 * k + 3
            WHEN d = 2 THEN k END AS total_tokens,
       {DAY} AS date
FROM ev"""

LLM_TOOL_FLAGS = f"""
WITH {EVENTS}
SELECT span_id, NOT (d = 2 AND y = 'signup') AS is_llm_call,
       d <> 3 AND y = 'purchase' AS is_tool_call,
       NOT (d = 3 AND y = 'signup') AS has_prompts,
       NOT (d = 3 AND y = 'signup') AS has_completions
FROM ev"""

ATTRIBUTE_KEY_COUNTS = f"""
WITH {EVENTS}, listed AS (
  SELECT unnest(CASE d
    WHEN 0 THEN ['gen_ai.request.model', 'gen_ai.usage.prompt_tokens',
      'gen_ai.usage.completion_tokens', 'gen_ai.usage.total_tokens', '{K.WORKFLOW_KEYS[0]}',
      '{K.TASK_KEYS[0]}', '{K.CONVERSATION_KEYS[0]}',
      'gen_ai.prompt.10.role', 'gen_ai.prompt.10.content', 'gen_ai.prompt.0.role',
      'gen_ai.prompt.0.content', 'gen_ai.prompt.2.role', 'gen_ai.prompt.2.content',
      'gen_ai.prompt.3.content', 'gen_ai.completion.0.role', 'gen_ai.completion.0.content',
      'gen_ai.completion.0.tool_calls.0.id', 'gen_ai.completion.0.tool_calls.0.name',
      'gen_ai.completion.0.tool_calls.0.arguments', 'gen_ai.completion.0.tool_calls.1.id',
      'gen_ai.completion.0.tool_calls.2.name', 'gen_ai.completion.1.role']
      || CASE WHEN y IN ('click', 'view', 'purchase') THEN ['gen_ai.operation.name'] ELSE [] END
    WHEN 1 THEN ['llm.model_name', 'llm.token_count.prompt', 'llm.token_count.completion',
      'llm.token_count.total', 'traceloop.workflow.name',
      'traceloop.association.properties.langgraph_node', 'session.id', 'openinference.span.kind',
      'llm.input_messages.0.message.role', 'llm.input_messages.0.message.content',
      'llm.input_messages.1.message.role', 'llm.input_messages.1.message.content',
      'llm.output_messages.0.message.role', 'llm.output_messages.0.message.content',
      'llm.output_messages.0.message.tool_calls.0.tool_call.id',
      'llm.output_messages.0.message.tool_calls.0.tool_call.function.name',
      'llm.output_messages.0.message.tool_calls.0.tool_call.function.arguments',
      'llm.output_messages.0.message.tool_calls.1.tool_call.function.name']
      || CASE WHEN y = 'view' THEN ['gen_ai.prompt.1.role', 'gen_ai.prompt.1.content'] ELSE [] END
    WHEN 2 THEN ['gen_ai.request.model', 'gen_ai.usage.input_tokens',
      'gen_ai.usage.output_tokens', 'llm.usage.total_tokens',
      '{K.CONVERSATION_KEYS[0]}', 'session.id']
      || CASE WHEN y <> 'signup' THEN ['gen_ai.operation.name'] ELSE [] END
      || CASE WHEN y = 'purchase' THEN ['traceloop.span.kind'] ELSE [] END
    ELSE ['snow.ai.observability.agent.planning.model',
      'snow.ai.observability.agent.planning.token_count.input',
      'snow.ai.observability.agent.planning.token_count.output',
      'snow.ai.observability.agent.thread_id']
      || CASE WHEN y = 'view' THEN ['ai.observability.record_root.input'] ELSE [] END
      || CASE WHEN y <> 'signup' THEN ['snow.ai.observability.agent.planning.query'] ELSE [] END
      || CASE WHEN y = 'purchase' THEN ['ai.observability.record_root.output'] ELSE [] END
      || CASE WHEN y IN ('click', 'view')
           THEN ['snow.ai.observability.agent.planning.thinking_response'] ELSE [] END
      || CASE WHEN y = 'error'
           THEN ['snow.ai.observability.agent.tool.cortex_analyst.text'] ELSE [] END
    END) AS attribute FROM ev)
SELECT attribute, count(*) AS spans FROM listed GROUP BY 1"""

PROMPTS_FLAT = f"""
WITH {EVENTS}
SELECT span_id, 0 AS position, 'system' AS role, 'sys ' || y AS message,
       true AS is_start, false AS is_end FROM ev WHERE d = 0
UNION ALL SELECT span_id, 2, 'user', '', false, false FROM ev WHERE d = 0
UNION ALL SELECT span_id, 10, 'user', 'ask ' || k, false, true FROM ev WHERE d = 0
UNION ALL SELECT span_id, 0, 'user', 'oi ask ' || k, true, false FROM ev WHERE d = 1
UNION ALL SELECT span_id, 1, CASE WHEN y = 'view' THEN 'tool' ELSE 'user' END,
       CASE WHEN y = 'view' THEN 'both ' || k ELSE 'oi second' END, false, true FROM ev WHERE d = 1
UNION ALL SELECT span_id, 0, 'user', 'ev ask ' || k, true, false FROM ev WHERE d = 2
UNION ALL SELECT span_id, 1, 'user', 'ev more', false, true FROM ev WHERE d = 2
UNION ALL SELECT span_id, 0, 'user', CASE WHEN y = 'view' THEN 'root ' ELSE 'plan ' END || k,
       true, true FROM ev WHERE d = 3 AND y <> 'signup'"""

COMPLETIONS_FLAT = f"""
WITH {EVENTS}
SELECT span_id, 0 AS position, 'assistant' AS role, 'ans ' || k AS message,
       true AS is_start, false AS is_end, 2 AS calls FROM ev WHERE d = 0
UNION ALL SELECT span_id, 1, 'assistant', '', false, true, 0 FROM ev WHERE d = 0
UNION ALL SELECT span_id, 0, 'assistant', 'oi ans ' || k, true, true, 1 FROM ev WHERE d = 1
UNION ALL SELECT span_id, 0, 'assistant', 'ev ans ' || k, true, false, 0 FROM ev WHERE d = 2
UNION ALL SELECT span_id, 1, 'assistant', 'ev choice ' || y, false, true, 0 FROM ev WHERE d = 2
UNION ALL SELECT span_id, 0, 'assistant',
       CASE y WHEN 'purchase' THEN 'out ' WHEN 'error' THEN 'text ' ELSE 'think ' END || k,
       true, true, 0 FROM ev WHERE d = 3 AND y <> 'signup'"""

TOOL_CALLS_FLAT = f"""
WITH {EVENTS}
SELECT span_id, 0 AS position, 0 AS ordinal, 'call-' || e AS id, 'search' AS name,
       '{{"q":' || k || '}}' AS arguments FROM ev WHERE d = 0
UNION ALL SELECT span_id, 0, 1, '', 'lookup', '' FROM ev WHERE d = 0
UNION ALL SELECT span_id, 0, 0, 'oic-' || e, 'calc', '{{"x":' || k || '}}' FROM ev WHERE d = 1"""

OTLP_SPANS = f"""
WITH {EVENTS}
SELECT service_name, printf('%032x', e // 5) AS trace_id, span_id, y AS span_name,
       'Server' AS span_kind, start_ns AS timestamp_ns, duration_ns,
       CASE y WHEN 'error' THEN 'Error' WHEN 'click' THEN 'Ok' ELSE 'Unset' END AS status_code,
       CASE y WHEN 'error' THEN 'failed' ELSE '' END AS status_message,
       6 AS attributes, 'model-' || (u % 3) AS model, k AS prompt_tokens, e % 2 = 0 AS flag,
       '["' || y || '",' || k || ']' AS tags, 's-' || e AS session_id
FROM ev"""

OTLP_REJECTS = f"""
WITH {EVENTS}
SELECT span_id, CASE e % 7 WHEN 0 THEN 'malformed document' WHEN 1 THEN 'no start time' ELSE 'kept' END AS fate
FROM ev"""

STREAMED_SPANS = f"""
WITH {EVENTS}
SELECT service_name, trace_id, span_id, start_ns, start_ns + duration_ns AS end_ns,
       {STATUS} AS status_code, {MODEL} AS model, {PROMPT_TOKENS} AS prompt_tokens,
       {PROMPT_COUNT} AS prompts, {COMPLETION_COUNT} AS completions, {DAY} AS date
FROM ev"""

STREAMED_OTLP = f"""
WITH {EVENTS}
SELECT service_name, printf('%032x', e // 5) AS trace_id, span_id, y AS span_name, start_ns,
       start_ns + duration_ns AS end_ns, CASE y WHEN 'error' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS status_code,
       'model-' || (u % 3) AS model, k AS prompt_tokens, {DAY} AS date
FROM ev WHERE e % 7 > 1"""

STREAMED_REJECTS = f"""
{OTLP_REJECTS}
UNION ALL
SELECT count(*) FILTER (WHERE e % 7 > 1) || ' + ' || count(*) FILTER (WHERE e % 7 < 2), 'counted' FROM ev"""

REDELIVERED_SPANS = f"""
WITH {EVENTS}
SELECT trace_id, span_id, start_ns, start_ns + duration_ns AS end_ns,
       CASE WHEN y = 'error' THEN 'failed ' || k ELSE '' END AS status_message
FROM ev"""

COMPACTED_SPANS = f"""
WITH {EVENTS}
SELECT service_name, trace_id, span_id, start_ns,
       start_ns + duration_ns + CASE WHEN e % 8 = 0 THEN 2 WHEN e % 2 = 0 THEN 1 ELSE 0 END AS end_ns,
       {MODEL} AS model, {PROMPT_COUNT} AS prompts, {DAY} AS date
FROM ev"""

_RANGE = "BETWEEN 1704693600000000000 AND 1705773600000000000"

RANGED_SPANS = f"{COMPACTED_SPANS} WHERE start_ns {_RANGE}"

TRACE_BOUNDS = f"""
WITH {EVENTS}
SELECT trace_id, min(start_ns // 1000000000 * 1000000000) AS first_start_ns,
       max(start_ns // 1000000000 * 1000000000) AS last_start_ns
FROM ev WHERE trace_id <> '' GROUP BY 1"""

DEDUP_SPANS = f"""
WITH {EVENTS} SELECT trace_id, span_id, start_ns, 1 AS delivery FROM ev"""

STREAMED_DEDUP = f"""
WITH {EVENTS} SELECT trace_id, span_id, start_ns AS timestamp_ns FROM ev"""

TRACE_LOOKUP = f"""
WITH {EVENTS}
SELECT service_name, 'op ' || y AS span_name, trace_id FROM ev WHERE trace_id = printf('%032x', 20)"""

SPAN_LOOKUP = f"""
WITH {EVENTS}
SELECT service_name, 'op ' || y AS span_name, span_id FROM ev WHERE e = 101"""

TRACE_FETCH = f"""
WITH {EVENTS}
SELECT span_id, CASE WHEN e % 5 = 0 THEN '' ELSE printf('%016x', e - e % 5) END AS parent_span_id,
       start_ns AS timestamp_ns FROM ev WHERE e // 5 = 20 AND trace_id <> ''"""

FAILED_TRACES = f"""
WITH {EVENTS}
SELECT trace_id, span_id, start_ns AS timestamp_ns, {STATUS_TEXT} AS status_code FROM ev
WHERE trace_id IN (SELECT trace_id FROM ev WHERE e % 5 = 0 AND y = 'error')"""

TRACE_SERIES = f"""
WITH {EVENTS}, b AS (SELECT start_ns // 600000000000 AS bucket FROM ev),
spine AS (SELECT unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b))) AS bucket)
SELECT spine.bucket * 600000000000 AS bucket_ns, count(b.bucket) AS n
FROM spine LEFT JOIN b ON b.bucket = spine.bucket GROUP BY 1"""

ATTRIBUTE_SEARCH = f"""
WITH {EVENTS}
SELECT span_id, service_name, 'oi-' || (u % 2) AS model FROM ev WHERE d = 1 AND y = 'purchase'"""

TRACE_LIMITED = f"""
WITH {EVENTS}
SELECT least(count(*), 3) AS spans, count(DISTINCT trace_id) AS traces FROM ev WHERE e // 5 = 20 AND trace_id <> ''"""

SLOW_SPANS = f"""
WITH {EVENTS}
SELECT span_id, duration_ns FROM ev WHERE duration_ns BETWEEN 50000000 AND 100000000"""

SPANS_OF_A_DAY = f"""
WITH {EVENTS}
SELECT span_id, start_ns, {DAY} AS date FROM ev
WHERE start_ns >= 1704888000000000000 AND start_ns < 1704974400000000000"""

SAMPLED_TRACES = f"""
WITH {EVENTS}
SELECT trace_id, span_id FROM ev
WHERE CAST('0x' || substr(md5(trace_id), 1, 8) AS BIGINT) < 1073741824"""

FAILED_SPAN_COUNT = "SELECT count(*) AS n FROM events WHERE event_type = 'error'"

RETAINED_SPANS = f"""
WITH {EVENTS}
SELECT span_id, {DAY} AS date FROM ev WHERE {DAY} >= '2024-01-11'"""

STORED_RAW_SPANS = f"""
WITH {EVENTS}
SELECT span_id, {DAY} AS date FROM ev WHERE {DAY} >= '2024-01-12'"""

# --- turns -----------------------------------------------------------------------

TURNS = f"""
asked AS (
  SELECT q.conv_id AS c, q.turn AS n, q.text AS question, a.text AS answer
  FROM conversations q LEFT JOIN conversations a
    ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
  WHERE q.role = 'user'
),
turns AS (
  SELECT 'chat-' || (c % 3) AS service_name, 'c' || c AS conversation_id,
         printf('%024x', c) || printf('%08x', n) AS trace_id,
         ({BASE} + c * 60 + n) * 1000000000 AS turn_ns,
         CASE WHEN c % 7 = 6 OR c % 4 = 3 THEN '' ELSE question END AS user_input,
         CASE WHEN answer IS NULL OR c % 4 = 2 THEN '' WHEN c % 4 = 1 THEN answer || chr(10) || 'done'
              ELSE answer END AS agent_response,
         length(question) AS prompt_tokens, length(answer) AS completion_tokens,
         CASE WHEN n % 5 = 4 THEN 2 WHEN n % 3 = 0 THEN 1 ELSE 0 END AS status_code,
         'flow-' || (c % 3) AS workflow,
         CASE WHEN c % 7 <> 6 THEN 1 ELSE 0 END + CASE WHEN answer IS NULL THEN 0 ELSE 1 END AS payloads,
         3 + CASE WHEN answer IS NULL THEN 0 ELSE 1 END AS others
  FROM asked WHERE c % 11 <> 10 AND (c % 7 <> 6 OR answer IS NOT NULL)
)"""

CONVERSATIONS = f"""
{TURNS},
summary AS (
  SELECT service_name, conversation_id, count(*) AS turns, min(turn_ns) AS first_turn_ns,
         max(turn_ns) AS last_turn_ns,
         CASE WHEN bool_or(status_code = 2) THEN 'ERROR' ELSE 'OK' END AS status,
         max(workflow) AS workflow, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
         CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens
  FROM turns GROUP BY 1, 2
)"""

_NUMBER = "row_number() OVER (PARTITION BY service_name, conversation_id ORDER BY turn_ns, trace_id)"

TURN_TEXTS = f"""
WITH {TURNS}
SELECT service_name, conversation_id, trace_id, turn_ns, user_input, agent_response, prompt_tokens,
       completion_tokens, status_code, workflow, others + payloads AS listed_keys,
       others AS stored_keys FROM turns"""

TURN_NUMBERS = f"""
WITH {TURNS} SELECT service_name, conversation_id, trace_id, {_NUMBER} AS turn FROM turns"""

STORED_TURNS = f"""
WITH {TURNS}
SELECT service_name, conversation_id, trace_id, {_NUMBER} AS turn, user_input, agent_response,
       strftime(make_timestamp(turn_ns // 1000), '%Y-%m-%d') AS date FROM turns"""

RANGED_TURNS = f"""
WITH {TURNS},
numbered AS (
  SELECT service_name, conversation_id, trace_id, {_NUMBER} AS turn, turn_ns,
         strftime(make_timestamp(turn_ns // 1000), '%Y-%m-%d') AS date FROM turns
)
SELECT * FROM numbered WHERE turn_ns BETWEEN 1704067500000000000 AND 1704068160500000000"""

CONVERSATION_ROLLUP = f"WITH {CONVERSATIONS} SELECT * FROM summary"

WORKFLOW_CONVERSATIONS = f"""
WITH {CONVERSATIONS}
SELECT service_name, conversation_id, turns FROM summary WHERE workflow = 'flow-1'"""

CONVERSATION_LOOKUP = f"""
WITH {TURNS} SELECT trace_id, turn_ns FROM turns WHERE conversation_id = 'c12'"""

TURN_ATTRIBUTE_SEARCH = f"""
WITH {TURNS} SELECT conversation_id, trace_id FROM turns WHERE completion_tokens IS NOT NULL"""

DEDUP_TURNS = f"""
WITH {TURNS} SELECT conversation_id, trace_id, turn_ns, 1 AS delivery FROM turns"""

# --- annotations -------------------------------------------------------------------

_UUID = "'00000000-0000-4000-8000-' || printf('%012x', {})"
_DOC_KEYS = "'chat-' || (doc_id // 4 % 3) AS service_name, 'c' || (doc_id // 4) AS conversation_id"

SCORES = f"""
scores AS (
  SELECT {_UUID.format('doc_id % 2')} AS monitor_uuid, {_DOC_KEYS}, t.eval_type,
         CASE t.eval_type WHEN 'quality' THEN quality ELSE toxic END AS score,
         lang || ':' || source AS reasoning, {BASE} + doc_id * 15 - 5 AS scored_at
  FROM labels JOIN documents USING (doc_id)
  CROSS JOIN (VALUES ('quality'), ('toxicity')) AS t(eval_type)
),
current_scores AS (
  SELECT * EXCLUDE (r) FROM (
    SELECT *, row_number() OVER (
      PARTITION BY service_name, monitor_uuid, conversation_id, eval_type
      ORDER BY scored_at DESC) AS r FROM scores) WHERE r = 1
)"""

CLUSTERS = f"""
current_clusters AS (
  SELECT * EXCLUDE (r) FROM (
    SELECT {_UUID.format('doc_id % 2')} AS space_uuid, {_DOC_KEYS},
           CASE WHEN n_chars % 100 < 50 THEN 'Uncategorized' ELSE 'topic-' || lang END AS cluster_key,
           'topic-' || lang AS predicted_cluster_key, n_chars % 100 AS confidence_percent,
           {BASE} + doc_id * 15 + 30 AS classified_at,
           row_number() OVER (PARTITION BY doc_id // 4, doc_id % 2 ORDER BY doc_id DESC) AS r
    FROM documents) WHERE r = 1
)"""

LATEST_SCORES = f"""
WITH {SCORES}
SELECT service_name, monitor_uuid, conversation_id, eval_type, score, reasoning, scored_at
FROM current_scores"""

LATEST_CLUSTERS = f"""
WITH {CLUSTERS}
SELECT service_name, conversation_id, space_uuid, cluster_key, predicted_cluster_key,
       confidence_percent, classified_at FROM current_clusters"""

CLUSTERS_JOINED = f"""
WITH {CONVERSATIONS}, {CLUSTERS}
SELECT service_name, conversation_id, space_uuid, cluster_key, predicted_cluster_key, turns, status
FROM summary JOIN current_clusters USING (service_name, conversation_id)"""

SCORES_JOINED = f"""
WITH {CONVERSATIONS}, {SCORES}
SELECT service_name, conversation_id, monitor_uuid, eval_type, score, reasoning, turns
FROM summary JOIN current_scores USING (service_name, conversation_id)"""

EARLY_ANNOTATIONS = f"""
WITH {CONVERSATIONS}, {SCORES}
SELECT service_name, conversation_id, monitor_uuid, eval_type, scored_at
FROM summary JOIN scores USING (service_name, conversation_id)
WHERE scored_at * 1000000000 < first_turn_ns"""

UNEXPIRED_SCORES = f"""
WITH {SCORES}
SELECT conversation_id, eval_type, reasoning, scored_at FROM scores WHERE scored_at > {BASE} + 7200"""

# --- request queue -------------------------------------------------------------------

_BATCH = _UUID.format("doc_id // 50")
_ROW = _UUID.format("doc_id")
_ANSWERED = "(doc_id % 3 <> 0 OR doc_id // 50 % 2 = 0)"
_PENDING = "doc_id // 50 % 3 <> 0"

PROGRESS = f"""
progress AS (
  SELECT {_BATCH} AS batch_id, count(*) AS total_rows,
         count(*) FILTER (WHERE {_ANSWERED} AND doc_id % 10 <> 7) AS completed_rows,
         count(*) FILTER (WHERE {_ANSWERED} AND doc_id % 10 = 7) AS failed_rows,
         bool_and({_PENDING}) AS pending
  FROM documents GROUP BY 1
)"""

LATEST_BATCHES = f"""
SELECT {_BATCH} AS batch_id, CASE WHEN doc_id // 50 % 3 = 0 THEN 'complete' ELSE 'pending' END AS status,
       count(*) AS total_rows,
       CASE WHEN doc_id // 50 % 3 = 0 THEN count(*) ELSE 0 END AS completed_rows,
       {BASE} + doc_id // 50 AS created_at
FROM documents GROUP BY doc_id // 50"""

QUEUE_INPUTS = f"""
SELECT {_BATCH} AS batch_id, {_ROW} AS row_id, 'model-' || lang AS model_id,
       CASE WHEN doc_id % 2 = 0 THEN '{{"t":0}}' ELSE '{{}}' END AS params, '' AS tool_config,
       length(text) AS prompt_length, {BASE} + doc_id AS created_at
FROM documents"""

PENDING_INPUTS = f"""
SELECT {_BATCH} AS batch_id, {_ROW} AS row_id FROM documents WHERE {_PENDING}"""

UNANSWERED_INPUTS = f"""
SELECT {_BATCH} AS batch_id, {_ROW} AS row_id FROM documents WHERE NOT {_ANSWERED}"""

BATCH_ANSWERS = f"""
SELECT {_BATCH} AS batch_id, {_ROW} AS row_id,
       CASE WHEN length(text) % 10 = 0 THEN '' ELSE
         'model-' || lang || '|' || CASE WHEN doc_id % 2 = 0 THEN '{{"t":0}}' ELSE '{{}}' END
         || '||' || length(text) || '|' || md5(text) END AS response,
       CASE WHEN length(text) % 10 = 0 THEN 'failed' ELSE 'complete' END AS status,
       CASE WHEN length(text) % 10 = 0 THEN 'ValueError: prompt refused' ELSE '' END AS error
FROM documents WHERE {_PENDING} AND NOT {_ANSWERED}"""

CLAIMED_WORK = f"""
SELECT {_BATCH} AS batch_id, {_ROW} AS row_id,
       CASE WHEN length(text) % 10 = 0 THEN '' ELSE
         'model-' || lang || '|' || CASE WHEN doc_id % 2 = 0 THEN '{{"t":0}}' ELSE '{{}}' END
         || '||' || length(text) || '|' || md5(text) END AS response,
       CASE WHEN length(text) % 10 = 0 THEN 'failed' ELSE 'complete' END AS status, 1 AS answers
FROM documents WHERE {_PENDING}"""

ENQUEUED_BATCH = """
SELECT '00000000-0000-4000-8000-0000000000ab' AS batch_id, 'pending' AS status, count(*) AS total_rows,
       0 AS completed_rows, 0 AS failed_rows FROM documents"""

STORED_QUEUE_RETAINED = f"""
SELECT {_BATCH} AS batch_id, {_ROW} AS row_id, {BASE} + doc_id AS created_at FROM documents WHERE doc_id > 100"""

BATCH_PROGRESS = f"""
WITH {PROGRESS} SELECT batch_id, total_rows, completed_rows, failed_rows FROM progress"""

CLOSED_BATCHES = f"""
WITH {PROGRESS}
SELECT batch_id, 'complete' AS status, total_rows, completed_rows, failed_rows
FROM progress WHERE pending AND completed_rows + failed_rows >= total_rows"""

_WORKED = f"({_ANSWERED} AND doc_id % 10 <> 7 OR NOT {_ANSWERED} AND length(text) % 10 <> 0)"

WORKED_QUEUE = f"""
SELECT {_BATCH} AS batch_id, 'complete' AS status, count(*) AS total_rows,
       count(*) FILTER (WHERE NOT {_PENDING} OR {_WORKED}) AS completed_rows,
       count(*) FILTER (WHERE {_PENDING} AND NOT {_WORKED}) AS failed_rows
FROM documents GROUP BY 1"""

PENDING_EVENTS = f"""
SELECT {_BATCH} AS batch_id, 'pending' AS status, count(*) AS total_rows,
       0 AS completed_rows, 0 AS failed_rows FROM documents GROUP BY 1"""

ORACLES: dict[str, str] = {
    "service_usage": SERVICE_USAGE,
    "spans_scalar": SPANS_SCALAR,
    "llm_tool_flags": LLM_TOOL_FLAGS,
    "attribute_key_counts": ATTRIBUTE_KEY_COUNTS,
    "prompts_flat": PROMPTS_FLAT,
    "completions_flat": COMPLETIONS_FLAT,
    "tool_calls_flat": TOOL_CALLS_FLAT,
    "otlp_spans": OTLP_SPANS,
    "otlp_rejects": OTLP_REJECTS,
    "streamed_spans": STREAMED_SPANS,
    "streamed_trace_bounds": TRACE_BOUNDS,
    "streamed_dedup": STREAMED_DEDUP,
    "closed_trace_bounds": TRACE_BOUNDS,
    "streamed_otlp": STREAMED_OTLP,
    "streamed_rejects": STREAMED_REJECTS,
    "redelivered_spans": REDELIVERED_SPANS,
    "compacted_spans": COMPACTED_SPANS,
    "ranged_spans": RANGED_SPANS,
    "ranged_turns": RANGED_TURNS,
    "compacted_turns": STORED_TURNS,
    "attribute_search_stored": ATTRIBUTE_SEARCH,
    "sampled_traces_stored": SAMPLED_TRACES,
    "traces_fetched_stored": FAILED_TRACES,
    "stored_turns": STORED_TURNS,
    "stored_raw_spans": STORED_RAW_SPANS,
    "stored_scores": UNEXPIRED_SCORES,
    "stored_clusters": CLUSTERS_JOINED,
    "stored_progress": BATCH_PROGRESS,
    "worked_queue": WORKED_QUEUE,
    "claimed_work": CLAIMED_WORK,
    "enqueued_batch": ENQUEUED_BATCH,
    "stored_queue_retained": STORED_QUEUE_RETAINED,
    "turn_texts": TURN_TEXTS,
    "turn_numbers": TURN_NUMBERS,
    "conversation_rollup": CONVERSATION_ROLLUP,
    "workflow_conversations": WORKFLOW_CONVERSATIONS,
    "conversation_lookup": CONVERSATION_LOOKUP,
    "clusters_joined": CLUSTERS_JOINED,
    "scores_joined": SCORES_JOINED,
    "early_annotations": EARLY_ANNOTATIONS,
    "dedup_spans": DEDUP_SPANS,
    "dedup_turns": DEDUP_TURNS,
    "latest_scores": LATEST_SCORES,
    "latest_clusters": LATEST_CLUSTERS,
    "latest_batches": LATEST_BATCHES,
    "trace_bounds": TRACE_BOUNDS,
    "trace_lookup": TRACE_LOOKUP,
    "trace_limited": TRACE_LIMITED,
    "span_lookup": SPAN_LOOKUP,
    "trace_fetch": TRACE_FETCH,
    "failed_traces": FAILED_TRACES,
    "trace_series": TRACE_SERIES,
    "attribute_search": ATTRIBUTE_SEARCH,
    "turn_attribute_search": TURN_ATTRIBUTE_SEARCH,
    "slow_spans": SLOW_SPANS,
    "spans_of_a_day": SPANS_OF_A_DAY,
    "sampled_traces": SAMPLED_TRACES,
    "failed_span_count": FAILED_SPAN_COUNT,
    "queue_inputs": QUEUE_INPUTS,
    "pending_inputs": PENDING_INPUTS,
    "unanswered_inputs": UNANSWERED_INPUTS,
    "batch_answers": BATCH_ANSWERS,
    "batch_progress": BATCH_PROGRESS,
    "repeated_inputs_progress": BATCH_PROGRESS,
    "closed_batches": CLOSED_BATCHES,
    "pending_events": PENDING_EVENTS,
    "retained_spans": RETAINED_SPANS,
    "unexpired_scores": UNEXPIRED_SCORES,
}
