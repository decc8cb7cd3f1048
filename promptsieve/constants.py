"""Fixed values.

Word lists, patterns, bounds, weights and formats in this module decide results and must
keep these exact values and this order.
"""

# --- actions -----------------------------------------------------------------------------
ACTION_RANK = {"allow": 0, "log": 1, "warn": 2, "block": 3}
SIGNATURE_CONFIDENCE = 0.9
TIER_RANK = {"free": 0, "pro": 1, "enterprise": 2}
SAFE_LABELS = ("safe", "benign", "normal", "clean")

# --- encodings ---------------------------------------------------------------------------
BASE64_RUN = r"[A-Za-z0-9+/]{20,}={0,2}"
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u180e"
CONFUSABLES = "\u0430\u0435\u0456\u043e\u0440\u0441\u0443\u0445"
HEX_ESCAPE = r"\\x[0-9a-fA-F]{2}"
URL_ESCAPE = r"%[0-9A-Fa-f]{2}"

SUSPICIOUS_PHRASES = (
    r"ignore\s*(all\s*)?(previous|prior|above)\s*(instructions?|prompts?|rules?)",
    r"disregard\s*(all\s*)?(previous|prior|above)",
    r"forget\s*(all\s*)?(previous|prior|above)",
    r"(do\s*anything\s*now|DAN\s*mode|jailbreak)",
    r"(system\s*prompt|reveal\s*instructions?)",
)

# --- evasion signals: name -> (description, confidence) ------------------------------------
EVASION_SIGNALS = {
    "excessive_length": ("Input exceeds maximum length", 1.0),
    "base64_encoding": ("Base64 encoded content detected", 0.8),
    "url_encoding": ("URL encoded content detected", 0.6),
    "unicode_obfuscation": ("Unicode lookalike characters detected", 0.7),
    "zero_width_chars": ("Zero-width characters detected", 0.75),
    "zero_width_evasion": ("Suspicious content hidden with zero-width chars", 0.9),
    "hex_escapes": ("Hex escape sequences detected", 0.7),
    "hex_escape_evasion": ("Suspicious content hidden with hex escapes", 0.9),
    "rot13_evasion": ("Suspicious content hidden with ROT13", 0.85),
    "char_insertion_evasion": ("Suspicious content hidden with char insertion", 0.85),
}
EVASION_ACTION = "warn"
EVASION_CATEGORY = "encoding-bypass"
MAX_TEXT_LENGTH = 50000
NOISE_RATIO = 0.85
MIN_ROT13_LENGTH = 10

# --- complexity ----------------------------------------------------------------------------
TIER_BOUNDS = (0.15, 0.35, 0.60)
REASONING_MARKERS = (
    "step by step", "step-by-step", "reason through", "reasoning", "prove", "explain why",
    "think through", "chain of thought", "derive", "work out", "justify", "walk me through",
)
TECHNICAL_TERMS = (
    "algorithm", "complexity", "theorem", "architecture", "concurrency", "optimize",
    "optimization", "asymptotic", "invariant", "race condition", "throughput", "latency",
    "distributed", "cryptograph", "compiler", "data structure", "recursion", "big-o",
    "time complexity",
)
ANALYSIS_VERBS = (
    "compare", "evaluate", "assess", "design", "architect", "propose", "recommend",
    "trade-off", "tradeoff", "migration", "strategy", "critique", "pros and cons", "analyze",
    "analyse", "plan for", "weigh",
)
SIMPLE_INDICATORS = (
    "hello", "hi ", "hey", "thanks", "thank you", "translate", "summarize", "tl;dr",
    "what time", "define ", "what is the capital", "say ",
)
DEEP_QUESTIONS = ("how ", "why ")
CODE_HINTS = (
    r"\b(def |class |import |function |const |let |var |public |private |"
    r"#include|SELECT |INSERT |=>|console\.log|print\()"
)
CODE_FENCE = "```"
MULTISTEP = (
    r"(\bstep\s*\d|\b\d+\.\s|\bfirst\b.*\bthen\b|\bnext\b.*\bthen\b|\bfinally\b)"
)
# dimension -> (weight, divisor of the raw count)
COMPLEXITY_WEIGHTS = {
    "tokens": (0.15, 2000.0),
    "code": (0.20, 1.0),
    "reasoning": (0.20, 2.0),
    "technical": (0.15, 3.0),
    "analysis": (0.20, 1.0),
    "multistep": (0.10, 1.0),
    "question": (0.10, 3.0),
    "simple": (-0.15, 2.0),
}

# --- routing and caching -------------------------------------------------------------------
ROUTER_PREFIX = "router:"
ROUTING_EXCLUSIONS = (
    "tools", "functions", "tool_choice", "parallel_tool_calls", "response_format",
)
LABEL_LIMIT = 200
MODEL_LIMIT = 100
CACHE_TTL_SECONDS = 3600

# --- redaction -----------------------------------------------------------------------------
REDACTED = "[REDACTED]"
SECRET_PATTERNS = (
    r"sk-ant-[a-zA-Z0-9-]+",
    r"sk-[a-zA-Z0-9]+",
    r"Bearer\s+[a-zA-Z0-9._-]+",
)
SECRET_HEADERS = ("authorization", "api-key", "x-api-key")

# --- limits --------------------------------------------------------------------------------
MAX_REQUEST_BYTES = 10 * 1024 * 1024
MAX_RESPONSE_BYTES = 50 * 1024 * 1024
STREAM_BUFFER_CHARS = 1024
RATE_PER_SECOND = 100
RATE_BURST = 200
CONNECTION_LIMIT = 50
EVENT_BATCH = 100

# --- histograms ----------------------------------------------------------------------------
REQUEST_BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
SCAN_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1)
