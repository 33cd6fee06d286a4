"""Tunables and fixed values.

Everything below the "fixed values" marker must stay byte-for-byte equal to the
behaviour being reproduced (word lists, thresholds, canned texts); everything
above it is a knob of this library.
"""

from __future__ import annotations

# ── fixed values (must equal the reproduced behaviour) ───────────────────────

# Retrieval sizes and thresholds.
RERANK_TOP_K = 20
FINAL_TOP_K = 5
RERANK_THRESHOLD = -2.0
MAX_CONTEXT_CHARS = 2000
MIN_CHARS_PER_EVENT = 100
LOW_GROUNDEDNESS_THRESHOLD = 0.5
EMBEDDING_DIMENSION = 384

# Static service list used when the event table has no services.
STATIC_SERVICES = [
    "payment-service",
    "order-service",
    "payment-pipeline",
    "auth-service",
    "api-gateway",
    "notification-service",
    "inventory-service",
]

# Query classification terms (substring test on the normalised query).
ANALYTICAL_TERMS = ["which", "how many", "count", "most", "top", "trend", "how often", "list all"]
INCIDENT_TERMS = [
    "why", "failed", "fail", "error", "errors", "issue", "problem", "outage", "alert",
    "crash", "down", "timeout", "slow", "latency", "what happened", "what caused",
    "happened", "caused",
]

# Question words that stop the short-query rewrite.
REWRITE_PREFIXES = ["what", "how", "why", "when", "where", "who", "explain", "describe",
                    "is", "are", "does", "do"]

# Default event_type per ingest source, and the order sources are applied in.
SOURCE_EVENT_TYPE = {"logs": "log", "events": "deployment", "metadata": "metadata"}
SOURCE_ORDER = ["logs", "events", "metadata"]

# Severity ordering for the key-signal block (others rank 99).
SEVERITY_RANK = {"CRITICAL": 0, "ERROR": 1, "WARNING": 2, "INFO": 3}
HIGH_SEVERITIES = ["CRITICAL", "ERROR"]

# Canned answers.
ANALYTICAL_ANSWER = (
    "This system is optimized for debugging specific incidents.\n"
    "Try queries like:\n"
    '  - "Why did payment-service fail yesterday?"\n'
    '  - "What caused the payment pipeline failure in the last 6 hours?"\n'
    '  - "Show me CRITICAL errors in order-service in the last 2 hours."'
)
NO_DATA_ANSWER = "No incident data found for the specified time window and service."
SEARCH_FAILED_ANSWER = "Unable to process incident query at this time."
LOW_CONFIDENCE_PREFIX = (
    "Low confidence results — limited or weak signal detected. Showing best available matches.\n\n"
)
EMPTY_CONTEXT = "(No relevant incident events found in selected time window.)"

# Prompt frame around the incident context.
PROMPT_HEAD = (
    "You are an AI assistant that analyses system incidents and operational events.\n"
    "IMPORTANT RULES:\n"
    "  1. Answer ONLY from the incident events provided below.\n"
    "  2. You MUST use the provided events to formulate an answer — never say\n"
    "     'no data' or 'insufficient data' when events are listed above.\n"
    "  3. If the signal is weak or ambiguous, provide your best analysis and\n"
    "     explicitly state uncertainty (e.g. 'Based on limited evidence…').\n"
    "  4. Pay close attention to timestamps and sequence to identify root causes,\n"
    "     cascading failures, and recovery patterns.\n"
    "  5. Respond that data is unavailable ONLY when the Incident events section\n"
    "     below is explicitly empty.\n\n"
    "---\n"
    "Incident events:\n\n"
)
PROMPT_TAIL = "\n---\n\nQuestion: "
PROMPT_END = "\n\nAnswer:"

# Section labels of the context block: (heading, per-event label).
SECTIONS = [
    ("## Errors / Alerts", "Error"),
    ("## Deployments / Changes", "Deploy"),
    ("## Timeline", "Event"),
]

# Judge texts.
JUDGE_DEFAULT_EXPLANATION = "No explanation provided."
JUDGE_PARSE_FAILURE = "Evaluation failed: could not parse LLM response."

# Front-end rules: relevance pre-check and "no data" answer prefixes.
INCIDENT_WORD_PATTERN = (
    r"\b(service|error|fail(ure|ed|ing)?|down|crash|timeout|latency|slow|deploy(ment)?|pipeline|alert|log"
    r"|incident|outage|issue|spike|bug|exception|warn(ing)?|critical|payment|order|auth|gateway|api"
    r"|notification|inventory|database|db|connection|pool|queue|cpu|memory|disk|network|request|response"
    r"|k8s|kubernetes|docker|pod|container|server|node|monitor|alarm|anomaly|metric|event|health|trace"
    r"|system)\b"
)
TIME_WORD_PATTERN = r"\b(last|past)\s+(\d+\s+)?(hour|minute|day|week|month)s?\b|\byesterday\b|\btoday\b|\brecently\b"
NO_DATA_PREFIXES = [
    "No incident data found",
    "No sufficient data",
    "Unable to process incident",
    "LLM unavailable",
    "I don't have enough incident data",
]

# Evaluation harness.
SCORED_CATEGORIES = ["lookup", "multi-hop", "no-answer"]
WIDE_WINDOW_CATEGORIES = ["lookup", "multi-hop"]
RECALL_K = 5

# Judge prompt pieces (joined around the per-row parts).
JUDGE_CRITERIA = (
    "Evaluate the generated answer on these criteria:\n\n"
    '1. "groundedness" — Is every claim in the answer directly supported by the context?\n'
    "   1.0 = fully grounded (all claims traceable to the context)\n"
    "   0.5 = partially grounded (some claims lack context support)\n"
    "   0.0 = not grounded (hallucinated or contradicts context)\n\n"
    '2. "relevance" — Does the answer correctly and completely address the question?\n'
    "   1.0 = complete, accurate answer to the question\n"
    "   0.5 = partial or tangential answer\n"
    "   0.0 = irrelevant or wrong\n"
)
JUDGE_CORRECTNESS_CRITERION = (
    '\n3. "correctness" — Does the generated answer convey the same information '
    "as the expected answer?\n"
    "   1.0 = semantically equivalent\n"
    "   0.5 = partially correct or incomplete\n"
    "   0.0 = incorrect or contradicts the expected answer\n"
)
JUDGE_SCHEMA_HEAD = (
    "Return JSON:\n"
    "{\n"
    '  "groundedness": {"score": <float 0.0–1.0>, "explanation": "<1-2 sentences>"},\n'
    '  "relevance": {"score": <float 0.0–1.0>, "explanation": "<1-2 sentences>"}'
)
JUDGE_CORRECTNESS_SCHEMA = ',\n  "correctness": {"score": <float 0.0–1.0>, "explanation": "<1-2 sentences>"}'
