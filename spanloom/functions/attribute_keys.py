"""Span attribute names the engine reads.

Every list is in order of precedence: the first key with a usable value wins.
The lists are configuration; adding an instrumentation dialect means adding
keys here, not code elsewhere.
"""

# Attribute and event names as the instrumentation libraries
# write them. They have to match the emitted spans letter by letter.

MODEL_KEYS = (
    "gen_ai.request.model",
    "llm.model_name",
    "snow.ai.observability.agent.planning.model",
)
WORKFLOW_KEYS = ("montecarlo.workflow", "traceloop.workflow.name")
TASK_KEYS = (
    "montecarlo.task",
    "traceloop.association.properties.langgraph_node",
)
CONVERSATION_KEYS = (
    "montecarlo.association_properties.thread_id",
    "session.id",
    "snow.ai.observability.agent.thread_id",
)

PROMPT_TOKEN_KEYS = (
    "gen_ai.usage.prompt_tokens",
    "gen_ai.usage.input_tokens",
    "llm.token_count.prompt",
    "snow.ai.observability.agent.planning.token_count.input",
)
COMPLETION_TOKEN_KEYS = (
    "gen_ai.usage.completion_tokens",
    "gen_ai.usage.output_tokens",
    "llm.token_count.completion",
    "snow.ai.observability.agent.planning.token_count.output",
)
TOTAL_TOKEN_KEYS = (
    "gen_ai.usage.total_tokens",
    "llm.usage.total_tokens",
    "llm.token_count.total",
)

OPERATION_KEY = "gen_ai.operation.name"
CHAT_OPERATION = "chat"
TOOL_MARKERS = (
    ("traceloop.span.kind", "tool"),
    (OPERATION_KEY, "execute_tool"),
    ("openinference.span.kind", "TOOL"),
)

SEMCONV_PROMPT = "gen_ai.prompt."
SEMCONV_COMPLETION = "gen_ai.completion."
OPENINFERENCE_INPUT = "llm.input_messages."
OPENINFERENCE_OUTPUT = "llm.output_messages."

PROMPT_EVENTS = ("gen_ai.user.message",)
COMPLETION_EVENTS = ("gen_ai.assistant.message", "gen_ai.choice")
EVENT_PROMPT_TEXT = ("content",)
EVENT_COMPLETION_TEXT = ("content", "message")

NATIVE_PROMPT_KEYS = (
    "ai.observability.record_root.input",
    "snow.ai.observability.agent.planning.query",
    "snow.ai.observability.agent.tool.cortex_search.query",
    "snow.ai.observability.agent.tool.cortex_analyst.messages",
)
NATIVE_COMPLETION_KEYS = (
    "ai.observability.record_root.output",
    "snow.ai.observability.agent.planning.response",
    "snow.ai.observability.agent.planning.thinking_response",
    "snow.ai.observability.agent.tool.cortex_search.results",
    "snow.ai.observability.agent.tool.cortex_analyst.text",
)

EXCEPTION_EVENT = "exception"
EXCEPTION_TYPE = "exception.type"
EXCEPTION_MESSAGE = "exception.message"

ENTITY_INPUT = "traceloop.entity.input"
ENTITY_OUTPUT = "traceloop.entity.output"

STATUS_CODES = {"Error": 2, "Ok": 1, "Unset": 0}
UNCATEGORIZED = "Uncategorized"
