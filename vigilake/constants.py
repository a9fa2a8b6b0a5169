"""Fixed values the operators must agree on with the stored data."""

from __future__ import annotations

# Incident states, in lifecycle order.
STATES = (
    "detected", "triaging", "engaged", "acknowledged", "mitigating", "mitigated", "resolved",
    "reopened", "pir_drafting", "pir_drafted", "pir_failed", "closed", "merged",
    "false_positive", "abandoned",
)

# States an incident never leaves.
TERMINAL_STATES = ("closed", "merged", "false_positive", "abandoned")

# Permitted state changes, from -> to.
STATE_EDGES = (
    ("detected", "triaging"), ("detected", "false_positive"),
    ("triaging", "engaged"), ("triaging", "merged"), ("triaging", "false_positive"),
    ("engaged", "acknowledged"), ("engaged", "mitigated"), ("engaged", "abandoned"),
    ("engaged", "false_positive"),
    ("acknowledged", "mitigating"), ("acknowledged", "mitigated"), ("acknowledged", "abandoned"),
    ("mitigating", "mitigated"), ("mitigating", "acknowledged"),
    ("mitigated", "resolved"), ("mitigated", "mitigating"),
    ("resolved", "pir_drafting"), ("resolved", "reopened"),
    ("reopened", "acknowledged"),
    ("pir_drafting", "pir_drafted"), ("pir_drafting", "pir_failed"),
    ("pir_failed", "pir_drafting"), ("pir_failed", "pir_drafted"),
    ("pir_drafted", "closed"),
)

# Severity levels and their rank (4 is the most severe).
SEVERITY_RANK = {"sev1": 4, "sev2": 3, "sev3": 2, "sev4": 1}

# Spellings of a severity seen on alerts and pages.
SEVERITY_ALIASES = {
    "critical": "sev1", "page": "sev1", "sev1": "sev1", "p1": "sev1",
    "error": "sev2", "high": "sev2", "sev2": "sev2", "p2": "sev2",
    "warning": "sev3", "warn": "sev3", "sev3": "sev3", "p3": "sev3",
    "info": "sev4", "informational": "sev4", "none": "sev4", "sev4": "sev4", "p4": "sev4",
}

# Labels that identify an alert, in fingerprint order.
STABLE_LABELS = ("alertname", "service", "namespace", "cluster", "severity")

# Correlation and storm parameters.
CORRELATION_WINDOW_S = 300
MERGE_THRESHOLD = 0.62
STORM_THRESHOLD = 5
CLOSE_AFTER_S = 86_400
TIME_WEIGHT, TOPOLOGY_WEIGHT, LABEL_WEIGHT = 0.4, 0.4, 0.2

# Severity a service tier never opens below, and the fast burn rate.
TIER_FLOOR = {1: "sev2", 2: "sev3", 3: "sev4"}
FAST_BURN = 14.4

# Fatigue terms (name, weight, ceiling) and routing bands.
FATIGUE_TERMS = (
    ("recent_pages", 0.30, 2),
    ("night_pages", 0.25, 2),
    ("incident_time", 0.20, 240),
    ("long_rotation", 0.15, 5),
    ("sev1_load", 0.10, 3),
)
INVITE_SECONDARY_AT = 0.50
REROUTE_AT = 0.75

# Chat subtypes that are not conversation.
IGNORED_SUBTYPES = (
    "channel_join", "channel_leave", "channel_topic", "channel_purpose", "channel_name",
    "channel_archive", "channel_unarchive", "bot_message", "message_replied", "pinned_item",
    "unpinned_item",
)

# Metric bucket bounds.
BUCKETS = {
    "webhook_seconds": (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5),
    "time_to_war_room_seconds": (1.0, 2.0, 5.0, 10.0, 20.0, 30.0, 60.0, 120.0),
    "time_to_acknowledge_seconds": (10.0, 30.0, 60.0, 120.0, 300.0, 600.0, 1800.0),
    "alerts_per_incident": (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0),
    "pir_seconds": (1.0, 5.0, 10.0, 20.0, 30.0, 60.0, 90.0, 120.0),
    "pir_human_edit_ratio": (0.0, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0),
}

# Reference id prefixes by evidence kind.
REFERENCE_PREFIX = {
    "message": "msg", "timeline": "tl", "metric": "metric", "deploy": "deploy",
    "alert": "alert", "runbook": "rb",
}
REFERENCE_PATTERN = r"^(msg|tl|metric|deploy|alert|rb):(\S+)\z"

# Intent rules, first match wins (intent, pattern, confidence).
INTENT_RULES = (
    (
        "remediation_end",
        r"\b(rollback (is )?(done|complete|finished)|rolled ?back|deployed|applied|"
        r"promotion (is )?(done|complete)|restarted|failed ?over|"
        r"scale[ds]? (up|down)|fix (is )?(in|out|live|shipped))\b",
        0.90,
    ),
    (
        "recovery_signal",
        r"\b(recovered|recovering|back to normal|error rate (is )?(down|dropping|normal)|"
        r"lag (is )?(gone|zero|clearing)|looks (healthy|green|clean|good)|"
        r"traffic (is )?normal|p99 (is )?(back|normal)|all green)\b",
        0.90,
    ),
    (
        "remediation_start",
        r"\b(rolling ?back|roll ?back|restart(ing)?|failing ?over|promot(e|ing)|"
        r"scal(e|ing) (up|down)|deploy(ing)? (a )?(fix|hotfix|patch)|"
        r"kubectl (rollout|delete|scale|drain|cordon)|helm (rollback|upgrade)|"
        r"flush(ing)? (the )?cache|draining)\b",
        0.95,
    ),
    (
        "escalation",
        r"\b(escalat(e|ing|ion)|paging|need (help|more hands|another pair)|"
        r"calling in|waking|pulling in|can someone|who owns)\b",
        0.85,
    ),
    (
        "investigation",
        r"\b(check(ing)?|look(ing)? at|seeing|grep|logs?|dashboard|query|trace|"
        r"why|what changed|suspect|digging|investigat(e|ing))\b",
        0.70,
    ),
)
SNAPSHOT_INTENTS = ("remediation_start", "recovery_signal")
SUMMARY_CHARS = 200

# Example phrases per intent for the nearest-exemplar layer.
EXEMPLARS = {
    "remediation_start": (
        "rolling the deploy back now",
        "putting the previous version back out",
        "taking the bad node out of the pool",
        "bouncing the pods to clear it",
        "cutting traffic over to the standby",
        "reverting the config change from this morning",
        "bumping the replica count to absorb it",
        "turning the feature flag off",
    ),
    "remediation_end": (
        "previous version is back out there",
        "the revert has landed",
        "traffic is fully on the standby now",
        "flag is off everywhere",
        "pods came back up clean",
    ),
    "recovery_signal": (
        "errors are normal again now",
        "the graphs have come down",
        "queue has drained",
        "latency is where it was before",
        "no new alerts in the last ten minutes",
        "customers stopped reporting it",
    ),
    "investigation": (
        "pulling the last hour of traces",
        "comparing this against yesterday",
        "does anyone know what shipped this morning",
        "the numbers do not line up with the alert",
        "reading through the diff now",
    ),
    "escalation": (
        "this is bigger than the two of us",
        "someone from the database team needs to be here",
        "getting the on call for payments involved",
        "we are out of our depth on this one",
    ),
}
EXEMPLAR_THRESHOLD = 0.42
EXEMPLAR_MAX_CONFIDENCE = 0.65
EXEMPLAR_STOPWORDS = (
    "a", "an", "and", "at", "for", "in", "is", "it", "of", "on", "the", "to", "we",
)

# Personal data rules in priority order (class, pattern, priority).
PII_RULES = (
    ("AWS_KEY", r"\b(?:AKIA|ASIA|AIDA|AROA)[0-9A-Z]{16}\b", 100),
    ("SLACK_TOKEN", r"\bxox[baprs]-[0-9A-Za-z-]{10,}\b", 95),
    ("JWT", r"\beyJ[0-9A-Za-z_-]{6,}\.[0-9A-Za-z_-]{6,}\.[0-9A-Za-z_-]{6,}\b", 90),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 80),
    ("UPI", r"\b[A-Za-z0-9._-]{2,}@[A-Za-z]{3,}\b", 70),
    ("CARD", r"\b(?:\d[ -]?){12,18}\d\b", 60),
    ("PHONE", r"(?:\+91[\s-]?|\b0)?\b[6-9]\d{9}\b", 50),
    ("ORDER_ID", r"(?i)\b(?:ORD|ORDER|INV)[-_]?[0-9A-Z]{6,}\b", 40),
    ("IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 30),
)
PRIVATE_IP_PATTERN = r"^(10\.|192\.168\.|127\.|0\.)|^172\.(1[6-9]|2[0-9]|3[01])\.\d+\.\d+$"

# Keys whose values are blanked in recorded payloads.
SECRET_KEYS = (
    "authorization", "x-api-key", "api_key", "apikey", "token", "bot_token", "routing_key",
    "signing_secret", "password", "secret",
)
SECRET_MASK = "<REDACTED>"

# Claim support test.
SUPPORT_THRESHOLD = 0.35
CLAIM_TOKEN_PATTERN = r"[a-z0-9][a-z0-9._/-]*[a-z0-9]|[a-z0-9]"
CLAIM_STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "at", "for", "was", "were", "is",
    "are", "be", "been", "this", "that", "it", "we", "with", "as", "by", "from", "after",
    "before", "during", "which", "had", "has",
)
ENTITY_PATTERN = r"\b(?:[a-z0-9]+-[a-z0-9-]+|v?\d+\.\d+[\w.]*|[0-9a-f]{7,40}|U[A-Z0-9]{6,})\b"
NUMBER_PATTERN = r"(?<![\w.])(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?(?![\w])"
TRIVIAL_NUMBER_MAX = 10

# Draft fields that carry claims, in walk order.
CLAIM_FIELDS = (
    "summary", "timeline", "contributing_factors", "what_went_well", "what_went_wrong",
    "root_cause_hypothesis", "action_items",
)
CLAIM_MAX_CHARS = 600

# Transcript and deploy evidence bounds.
TRANSCRIPT_HEAD = 200
TRANSCRIPT_TAIL = 200
DEPLOY_LOOKBACK_H = 6
DEPLOY_TRAILING_MIN = 30
DEPLOYS_PER_INCIDENT = 20

# Words too common in commands to identify a runbook step.
GENERIC_COMMAND_WORDS = (
    "kubectl", "psql", "curl", "echo", "grep", "sudo", "bash", "sh", "get", "-n", "|", "&&",
)
STEP_MARKER_PATTERN = r"(?m)^<!--\s*step:([a-z0-9][a-z0-9-]*)\s*-->\s*$"
FRONT_MATTER_PATTERN = r"(?s)^---\s*\n(.*?)\n---\s*\n"
FENCE_PATTERN = r"(?s)```(?:[a-z]*\n)?(.*?)```"
COMMAND_WORD_PATTERN = r"[A-Za-z0-9_./:-]{3,}"
STEP_MIN_TOKENS = 2

# Sweep intervals.
NUDGE_AFTER_S = 600
NUDGE_INTERVAL_S = 300
ABANDON_AFTER_H = 24
HISTORY_SAMPLE = 15

# Spend limits (scope, USD).
BUDGET_LIMITS = {"incident": 0.50, "day": 5.00, "month": 50.00}

# On-call rota epoch, a Monday.
ROTATION_EPOCH = "2026-01-05"

# Evaluation gate (metric, tier, comparison, reference, tolerance).
GATE_RULES = (
    ("citation_precision", "HARD", "==", 1.0, 0.0),
    ("uncited_claims", "HARD", "==", 0.0, 0.0),
    ("fabricated_citations", "HARD", "==", 0.0, 0.0),
    ("prompt_drift", "HARD", "==", 0.0, 0.0),
    ("network_calls", "HARD", "==", 0.0, 0.0),
    ("unexpected_skeleton", "HARD", "==", 0.0, 0.0),
    ("replay_errors", "HARD", "==", 0.0, 0.0),
    ("timeline_f1", "SOFT", ">=", None, 0.03),
    ("action_item_recall", "SOFT", ">=", None, 0.03),
    ("storm_compression", "SOFT", ">=", 0.95, 0.0),
    ("cost_per_pir_usd", "BUDGET", "<=", 0.50, 0.0),
    ("p95_generation_ms", "BUDGET", "<=", 30_000.0, 0.0),
)
TIMELINE_BUCKET_S = 60
ACTION_MATCH_THRESHOLD = 0.6
JUDGE_DIMENSIONS = ("coherence", "root_cause", "action_items")
