"""Fixed values that results depend on."""

# Limits.
CHUNK_CHARS, CHUNK_OVERLAP = 1024, 128
WINDOW_WORDS, WINDOW_OVERLAP = 500, 50
MAX_FILE_BYTES = 2 * 1024 * 1024
MAX_CHUNKS_PER_FILE = 2000
RRF_CONSTANT = 20.0
BM25_K1, BM25_B, BM25_LEAST_IDF = 1.2, 0.75, 1e-6
RERANK_CANDIDATES, RERANK_TOP = 30, 7
CACHE_SIMILARITY = 0.90
BUDGET_CHARS = 32_000
TRUNCATION_SUFFIX = "[TRUNCATED TO SAVE TOKENS]"
LEAST_RESPONSE_BYTES = 20
STALE_DAYS = 180
HISTOGRAM_BOUNDS = (10, 50, 100, 250, 500, 1000, 5000, 30000)

# File selection.
EXTENSIONS = ("py", "md", "txt", "json", "js", "ts", "jsx", "tsx", "rs", "ps1", "scala")
SKIP_DIRS = (
    "node_modules", ".git", "chroma_db", "lancedb", "__pycache__", ".gemini", "build", "dist", "out", ".next", ".cache", ".doc", "target",
    ".venv", "venv", "env", "site-packages", ".tox", ".nox", "onnxruntime-win-x64-1.23.0", "ort_gpu", "cudnn9", "ZZOTHER", "qdrant_storage",
)
SKIP_FILES = ("tokenizer.json",)
SECRET_EXTENSIONS = ("rs", "ts", "tsx", "js", "jsx", "toml", "env", "json", "yaml", "yml")
SECRET_SKIP_DIRS = ("target", ".git", "node_modules")

# Stop words for keywords.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "be",
    "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "should", "could", "may", "might", "can", "what", "how",
    "where", "when", "why", "which", "who", "this", "that", "these",
)

# Responses without value, and the pattern of queries without value.
LOW_VALUE_RESPONSES = (
    "ok", "existing or verified doc.", "doc/test/refactor", "no code change", "no code changes", "no changes", "no fixes needed", "all passed",
    "no warnings", "no warnings.",
)
LOW_VALUE_QUERY = r"(?i)^run [0-9]+( doc check)?[ \t\n\r\f]*$"

# Redaction patterns, in their order.
REDACT = (
    r"(?i)[A-Z]:\\Users\\[^\\]+",
    r"/home/[^/\s]+",
    r"sk-[a-zA-Z0-9]{20,}",
    r"AIza[0-9A-Za-z\-_]{35}",
    r"AKIA[0-9A-Z]{16}",
    r"sk-ant-[a-zA-Z0-9\-_]{20,}",
    r"(ghp_|gho_|github_pat_)[a-zA-Z0-9_]{10,}",
    r"-----BEGIN [A-Z ]+-----",
    r"(?i)(secret|password|credential|token|api.?key).*\.(txt|json|env|yaml|yml|toml)",
)
REDACTED = "[REDACTED]"

# Secret patterns; lines with an opt-out or that read the environment are passed over.
SECRETS = (
    r'(?i)(key|token|secret|password|api_key)\s*=\s*"([^"]{20,})"',
    r'"(sk_live_[^"]*|sk_test_[^"]*)',
    r'"(AIza[^"]{30,})',
    r'"(ghp_[a-zA-Z0-9]{36}|github_pat_[^"]+)"',
    r'"(eyJ[a-zA-Z0-9_-]{20,}\.[a-zA-Z0-9_-]{20,}\.[a-zA-Z0-9_-]{20,})"',
    r'"(xoxb-[0-9]+-[0-9]+-[a-zA-Z0-9]+)"',
    r'"(AKIA[0-9A-Z]{16})"',
)
SECRET_PASS = ("scan-secrets-ignore", "env::var", 'env!("', "std::env::")

# Domain of a path, in order of the rules.
DOMAIN_RULES = (
    ("fintech", ("payment", "billing")),
    ("infrastructure", ("db", "store", "repository")),
    ("routing", ("handler", "route", "controller")),
    ("auth", ("auth", "session")),
    ("api", ("api", "client")),
    ("testing", ("test", "spec")),
)

# Kind of a web source, in order of the rules.
WEB_RULES = (
    ("stackoverflow", ("stackoverflow.com", "stackexchange.com")),
    ("official", ("doc.rust-lang.org", "docs.python.org", "react.dev", "reactjs.org", "developer.mozilla.org", "docs.microsoft.com")),
    ("repository", ("github.com", "gitlab.com", "bitbucket.org")),
    ("blog", ("medium.com", "dev.to", "blog.", "/blog/")),
)
SOURCE_BONUS = {"official": 0.3, "stackoverflow": 0.25, "repository": 0.15, "codebase": 0.1, "blog": 0.05}

# User-interface checks.
FORBIDDEN_SHADOWS = ("shadow-md", "shadow-lg", "shadow-xl", "shadow-2xl")
SKILL_HEADINGS = ("## Purpose", "## When to use")

# Programs that may be run, and subcommands and flags that may not.
SHELL_PROGRAMS = ("cargo", "git", "grep", "ls", "npm")
BLOCKED_SUBCOMMANDS = {"git": ("push", "clean", "rebase"), "cargo": ("uninstall",), "npm": ("uninstall",)}
BLOCKED_GIT_FLAGS = ("--hard", "--force", "--force-with-lease", "--amend", "-f")

# Which argument of a tool is a path, whether an empty one passes, and the warning.
PATH_ARGUMENTS = (
    ("security_audit", "path", False, "Path not under ALLOWED_ROOTS: "),
    ("get_file_history", "path", False, "Path not under ALLOWED_ROOTS: "),
    ("module_graph", "workspace_path", True, "workspace_path not under ALLOWED_ROOTS: "),
    ("compile_rules", "active_project_path", True, "active_project_path not under ALLOWED_ROOTS: "),
)
PATH_LISTS = (("refresh_file_index", "paths", "Path not under ALLOWED_ROOTS: "),)

# Fixed value: most words of a skill's content.
MAX_SKILL_WORDS = 5000

# Periods of the janitor.
JANITOR_WEB_DAYS, JANITOR_KEEP_ROWS, JANITOR_REVIEW_DAYS = 30, 100_000, 7
