"""Names, weights, word lists and patterns that results depend on."""

DEFAULT_PROJECT = "default"
DRAFT_MARK = "[AI-DRAFT]"
VERIFIED_MARK = "[VERIFIED]"

# Share of each layer in the gate score; normalised over the layers present.
GATE_WEIGHTS = {
    "deterministic": 0.30,
    "runtime": 0.30,
    "static": 0.20,
    "ai_gate": 0.15,
    "metrics_gate": 0.05,
}
# What a report says of the stage that decided; other stages speak through evaluators.
STAGE_REASONS = {
    "missing_tests": "Unverified: no test code",
    "structural": "Critical failure: structure",
    "security": "Security rejection",
    "dependency": "Dependency rejection",
    "deterministic": "Critical failure: deterministic checks",
    "runtime": "Critical failure: runtime",
    "no_evaluators": "No applicable evaluators succeeded",
    "ai_veto": "Veto by the AI gate",
}
EVALUATORS = [
    "structural",
    "deterministic",
    "runtime",
    "security_static",
    "dependency_vouch",
    "ai_gate",
    "metrics_gate",
    "python_static",
    "ruff",
    "eslint",
]
VERIFIED_FROM = 70.0
SECURITY_FLOOR = 60.0
DEPENDENCY_FLOOR = 70.0
AI_VETO_BELOW = 30.0
AI_CAP_BELOW = 70.0
UNTESTED_SCORE = 40.0

KEYWORD_SIMILARITY = 0.9
DRAFT_SIMILARITY = 0.4
WEAK_MATCH_BELOW = 0.45
RERANK_CANDIDATES = 15
SNIPPET_CHARS = 500
DESCRIPTION_MIN_LENGTH = 10
GENERATION_WORDS = ["create", "generate", "make", "implement", "write", "how to"]
REVIEW_WORDS = ["accepted", "published", "proceedings", "conference", "journal"]

EXTENSIONS = {
    "python": "py",
    "javascript": "js",
    "typescript": "ts",
    "markdown": "md",
    "json": "json",
}

# Modules that never count as an undeclared import.
STDLIB_MODULES = [
    "os", "sys", "json", "re", "math", "datetime", "typing", "asyncio",
    "logging", "ast", "pathlib", "abc", "collections", "functools",
    "itertools", "threading", "multiprocessing", "pickle", "shutil",
    "tempfile", "time", "uuid", "hashlib", "base64", "xml", "html",
    "unittest", "pytest", "typing_extensions", "random", "enum", "inspect",
    "traceback", "warnings", "importlib", "glob", "argparse",
]
# External packages accepted when a project declares none at all.
COMMON_PACKAGES = [
    "pandas", "numpy", "requests", "pydantic", "fastapi", "sqlalchemy",
    "tqdm", "yaml",
]
# Names left out of a dependency list (Python and Node built-ins).
BUILTIN_DEPENDENCIES = [
    "os", "sys", "json", "math", "datetime", "typing", "asyncio", "logging",
    "ast", "pathlib", "abc", "fs", "path", "http", "https", "crypto",
]
HEAVY_MODULES = [
    "torch", "tensorflow", "sklearn", "pandas", "matplotlib", "seaborn", "scipy",
]
JS_LANGUAGES = ["typescript", "javascript", "tsx", "jsx"]

SECRET_NAME_PATTERN = (
    "(API_KEY|PASSWORD|TOKEN|AUTH_TOKEN|PRIVATE_KEY|AWS_SECRET|SECRET_KEY)"
)
SECRET_TEXT_PATTERN = (
    r"(?i)\b(\w*(?:API_KEY|PASSWORD|TOKEN|AUTH_TOKEN|PRIVATE_KEY|AWS_SECRET|SECRET_KEY)\w*)"
    r"""\s*=\s*["'][^"'\n]{5,}["']"""
)
SQL_INJECTION_PATTERNS = [
    (r"""\.execute\(f["']""", "F-string SQL query"),
    (r"\.execute\(.*%", "String formatting (%) in SQL query"),
    (r"\.execute\(.*\+", "String concatenation in SQL query"),
]
SHELL_CALLS = ["run", "call", "Popen", "check_call", "check_output"]

# Assertion patterns per language with the group that is counted (0 = all).
ASSERTION_PATTERNS = {
    "javascript": (r"(?d)(expect|assert)\(.*\)", 1),
    "typescript": (r"(?d)(expect|assert)\(.*\)", 1),
    "cpp": (r"(?d)(assert|EXPECT_|ASSERT_)\(.*\)", 1),
    "java": (r"(?d)assert(True|False|Equals|NotNull|Same)\(.*\)", 1),
}
DEFAULT_ASSERTION_PATTERN = (r"(?d)assert.*\(.*\)", 0)

# Argument names models get wrong, in the order they are tried.
ARGUMENT_ALIASES = [
    ("file_path", "path"),
    ("filepath", "path"),
    ("file", "path"),
    ("code", "content"),
    ("source", "content"),
    ("text", "content"),
]
