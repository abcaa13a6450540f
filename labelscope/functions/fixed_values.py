"""Fixed values.

These values must equal the ones of the evaluated workflow for results to
match it. They are stated plainly and in their natural order; change them
only through the parameters of the operators that use them.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must stay equal to the evaluated workflow)
# ---------------------------------------------------------------------------

# Labels scored by default (combined scoring).
DEFAULT_TARGETS = ("singleton", "factory", "observer")

# Labels present in the committed corpus; its per-origin result files were
# scored with all four.
CORPUS_LABELS = ("singleton", "factory", "observer", "decorator")

# Spelling variants mapped to a canonical label before the target check.
DEFAULT_SYNONYMS = {
    "factory method": "factory",
    "factory pattern": "factory",
    "abstract factory": "factory",
    "factory-method": "factory",
    "factorymethod": "factory",
    "observer pattern": "observer",
    "publisher-subscriber": "observer",
    "pub-sub": "observer",
    "strategy pattern": "strategy",
    "singleton pattern": "singleton",
    "decorator pattern": "decorator",
    "wrapper": "decorator",
}

# Published comparison scores (model, precision, recall, f1).
PUBLISHED_SCORES = (
    ("ChatGPT", 0.768, 0.857, 0.810),
    ("ChatGPT-Tuned", 0.724, 0.946, 0.820),
    ("Claude", 0.752, 0.762, 0.757),
    ("LLaMA", 0.779, 0.769, 0.774),
)

# Raw index label -> corpus label (collection 1).
RAW_LABEL_MAP = {
    "Factory": "factory",
    "Singleton": "singleton",
    "Observer": "observer",
    "Decorator": "decorator",
}

# File-stem keywords per label (collection 2); the first label in this order
# whose keyword occurs in the lower-cased stem wins.
LABEL_KEYWORDS = (
    ("singleton", ("singleton",)),
    ("factory", ("factory",)),
    ("observer", ("observer", "listener")),
    ("decorator", ("decorator", "wrapper")),
)

# Project directory prefixes (collection 2) and the default project name.
PROJECT_PREFIXES = ("Ant", "ArgoUML", "Azureus", "JHotDraw", "DrJava", "Eclipse", "Xerces", "Xalan")
DEFAULT_PROJECT = "PMARt"

# Source extensions kept by the corpus scan (case-sensitive).
SOURCE_EXTENSIONS = (".java", ".py", ".cpp", ".cs", ".js", ".ts")

# Origins, told apart by the file-name prefix "<ORIGIN>-".
ORIGINS = ("DPD", "PMART")

# Sampling.
SEED = 42
SAMPLES_PER_LABEL = 10

# Response handling.
# Extraction patterns, tried in this order after the whole text ("\s" is
# Python white space; "." also matches new lines).
FENCE_PATTERN = r"```json\s*(\{.*?\})\s*```"
BRACE_PATTERN = r"(\{.*\})"
PAYLOAD_KEY = "design_patterns"
FALLBACK_LABEL = "None"
FALLBACK_SCORE = "0"
FALLBACK_REASON = "No pattern detected or parse error"
MISSING_LABEL = "Unknown"
MISSING_SCORE = "0"
MISSING_REASON = ""
ERROR_PREFIX = "Error:"
JOINED_PROMPT_SEPARATOR = "\n\nSource Code to Analyze:\n"

# Per-provider request parameters:
# provider -> (message style, default temperature, max tokens)
PROVIDERS = {
    "openai": ("chat", 0.2, None),
    "google": ("joined", None, None),
    "ollama": ("chat", 0.2, None),
    "groq": ("chat", 0.2, 1024),
}
# A model id containing this text (lower-cased) is sent temperature 1.
FIXED_TEMPERATURE_MODEL = "gpt-5"
FIXED_TEMPERATURE = 1.0

# Labels that mean "nothing detected" (compared lower-cased).
NONE_MARKERS = ("none", "")

# Run id format (date and time, sorts by time).
RUN_ID_FORMAT = "yyyy-MM-dd_HH-mm-ss"

# Sample sizes of the report.
TOP_IGNORED = 5
EVIDENCE_SAMPLE = 5

# Text that pandas reads as missing in a CSV cell (default NA tokens).
CSV_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Characters Python's str.strip() removes: every character for which
# str.isspace() holds (built from that rule), and the same set as a regex
# class that Java regex and RE2 both accept.
PY_WHITESPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
PY_WHITESPACE_CLASS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in PY_WHITESPACE_CHARS) + "]"

# Decimals of the report's numbers: scores, means, extremes, seconds a call,
# total seconds, percentages.
SCORE_DIGITS, MEAN_DIGITS, EXTREME_DIGITS = 3, 1, 0
CALL_DIGITS, TOTAL_DIGITS, PERCENT_DIGITS = 2, 1, 1

# Report texts, in the order they are printed.
REPORT_RULE = "=" * 70
REPORT_TITLE = "ANALYSIS: "
REPORT_FILES = "Files processed: %d"
REPORT_IGNORED_HEAD = "[!] OUT-OF-SCOPE PATTERNS DETECTED (ignored in metrics):"
REPORT_IGNORED_LINE = "   - %s: %dx"
REPORT_TABLE_HEAD = ("Pattern", "TP", "FP", "FN", "Prec", "Recall", "F1")
REPORT_TABLE_HEAD_FORMAT = "%-20s %-6s %-6s %-6s %-8s %-8s %-8s"
REPORT_TABLE_ROW_FORMAT = "%-20s %-6d %-6d %-6d %-8s %-8s %-8s"
REPORT_TABLE_RULE = "-" * 70
REPORT_OVERALL = "OVERALL"
REPORT_MISSED_HEAD = "[X] MISSED DETECTIONS (sample of 5):"
REPORT_MISSED_LINE = "   - %s: expected '%s', got ['%s']"
REPORT_FP_HEAD = "[!] FALSE POSITIVES (sample of 5):"
REPORT_FP_LINE = "   - %s: expected '%s', wrongly detected '%s'"
REPORT_QUALITY_HEAD = "QUALITATIVE ANALYSIS"
REPORT_SECTION_RULE = "-" * 40
REPORT_CONFIDENCE = "  Avg Confidence: %s (min: %s, max: %s)"
REPORT_ADHERENCE = "  Avg Adherence:  %s (min: %s, max: %s)"
REPORT_RESPONSE_TIME = "  Avg Response Time: %ss (total: %ss)"
REPORT_SOURCE_HEAD = "BREAKDOWN BY SOURCE"
REPORT_SOURCE_LINE = "   %-8s: %d/%d correct (%s%%)"
REPORT_COMPARISON_HEAD = "MODEL COMPARISON"
REPORT_COMPARISON_COLUMNS = ("Model", "Precision", "Recall", "F1-Score")
REPORT_COMPARISON_HEAD_FORMAT = "%-25s %-12s %-12s %-12s"
REPORT_COMPARISON_ROW_FORMAT = "%-25s %-12s %-12s %-12s"
REPORT_BEST = "[1st] Best Model: %s (F1 = %s)"
REPORT_PUBLISHED_HEAD = "PUBLISHED RESULTS"
