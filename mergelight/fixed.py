"""Word lists, maps, patterns and limits that results depend on."""

# --- fixed values: languages -------------------------------------------------
SUPPORTED_LANGUAGES = ["python", "javascript", "typescript"]

# extension (lower case, with dot) -> language
LANGUAGE_BY_EXTENSION = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".go": "go",
    ".java": "java",
    ".rb": "ruby",
    ".rs": "rust",
    ".cpp": "cpp",
    ".c": "c",
    ".cs": "csharp",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin",
}

# text after the last dot, case kept -> language (used while reading PR files)
PR_FILE_LANGUAGE = {
    "py": "python",
    "js": "javascript",
    "ts": "typescript",
    "tsx": "typescript",
    "jsx": "javascript",
    "go": "go",
    "java": "java",
    "rb": "ruby",
    "rs": "rust",
}

# exact-case extension -> language (directory scan)
SCAN_LANGUAGE = {".py": "python", ".js": "javascript", ".ts": "typescript"}
SCAN_PRUNED_DIRS = ["__pycache__", ".git", ".venv", "venv", "node_modules", ".pytest_cache"]

# --- fixed values: file filter -----------------------------------------------
GENERATED_NAME_PARTS = [
    "_pb2.py",
    "_pb2_grpc.py",
    ".min.js",
    ".min.css",
    ".generated.",
    ".g.dart",
    "package-lock.json",
    "yarn.lock",
    "pnpm-lock.yaml",
    "Pipfile.lock",
    "poetry.lock",
    "go.sum",
    "Cargo.lock",
]
GENERATED_MARKERS = [
    "generated",
    "auto-generated",
    "do not edit",
    "this file is generated",
    "code generated by",
]
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg",
    ".woff", ".woff2", ".ttf", ".eot",
    ".zip", ".tar", ".gz", ".bz2",
    ".exe", ".dll", ".so", ".dylib",
    ".pdf", ".doc", ".docx",
    ".pyc", ".pyo", ".class",
]
MAX_FILE_CHARS = 500_000
MAX_CONTENT_BYTES = 1_000_000

# --- fixed values: test files ------------------------------------------------
TEST_NAME_ENDINGS = ["_test.py", ".test.js", ".test.ts", ".spec.js", ".spec.ts"]
TEST_FILE_PATTERNS = {
    "python": [
        "tests/test_{name}.py",
        "test/test_{name}.py",
        "tests/{name}_test.py",
        "{dir}/tests/test_{name}.py",
        "{dir}/test_{name}.py",
    ],
    "javascript": [
        "__tests__/{name}.test.js",
        "{name}.test.js",
        "{name}.spec.js",
        "tests/{name}.test.js",
        "{dir}/__tests__/{name}.test.js",
    ],
    "typescript": [
        "__tests__/{name}.test.ts",
        "{name}.test.ts",
        "{name}.spec.ts",
        "tests/{name}.test.ts",
        "{dir}/__tests__/{name}.test.ts",
    ],
}

# --- fixed values: security --------------------------------------------------
SENSITIVE_WORDS = [
    "auth", "login", "password", "token", "payment",
    "upload", "admin", "user", "session", "secret",
    "credential", "crypto", "encrypt", "decrypt",
    "sign", "verify", "certificate", "key", "oauth",
]

# (words looked for in the lower-cased path, purpose), first match wins
PATH_PURPOSES = [
    (["auth", "login", "signin"], "user authentication and login"),
    (["payment", "billing", "charge"], "payment processing"),
    (["upload", "file", "storage"], "file upload and storage"),
    (["admin"], "admin panel operations"),
    (["api", "route", "endpoint"], "API routing and endpoints"),
    (["model", "schema", "db"], "database models and queries"),
]
# (words looked for in the first 2,000 characters, purpose)
CONTENT_PURPOSES = [
    (["crypto", "encrypt"], "cryptographic operations"),
    (["session", "cookie"], "session management"),
]
DEFAULT_PURPOSE = "general application logic"

# (number, regular expression searched in one line ignoring case, title, severity, category)
SECURITY_RULES = [
    (1, r"""(password|secret|api_key|token|private_key)\s*=\s*["'][^"']{8,}""",
     "Hardcoded secret detected", "CRITICAL", "hardcoded-secret"),
    (2, r"subprocess\.call\(.*shell\s*=\s*True",
     "Shell injection risk via subprocess", "HIGH", "command-injection"),
    (3, r"subprocess\.(?:Popen|run)\(.*shell\s*=\s*True",
     "Shell injection risk via subprocess", "HIGH", "command-injection"),
    (4, r"os\.system\s*\(",
     "OS command execution via os.system", "HIGH", "command-injection"),
    (5, r"^[^#]*eval\s*\(",
     "Dangerous eval() usage", "HIGH", "code-injection"),
    (6, r"exec\s*\(",
     "Dangerous exec() usage", "HIGH", "code-injection"),
    (7, r"""execute\s*\(\s*f["']""",
     "Potential SQL injection via f-string", "HIGH", "sql-injection"),
    (8, r"""execute\s*\(\s*["'].*%s.*["'].*%\s*\(""",
     "Potential SQL injection via string formatting", "HIGH", "sql-injection"),
    (9, r"(?:md5|sha1)\s*\(",
     "Weak cryptographic hash function", "MEDIUM", "weak-crypto"),
    (10, r"pickle\.loads?\s*\(",
     "Unsafe deserialization with pickle", "HIGH", "unsafe-deserialization"),
    (11, r"yaml\.load\s*\([^)]*\)(?!\s*,\s*Loader)",
     "Unsafe YAML loading without safe loader", "HIGH", "unsafe-deserialization"),
    (12, r"random\.(random|randint|choice|uniform)\s*\(",
     "Non-cryptographic random in potential security context", "MEDIUM", "insecure-random"),
    (13, r"innerHTML\s*=",
     "Potential XSS via innerHTML assignment", "HIGH", "xss"),
    (14, r"document\.write\s*\(",
     "Potential XSS via document.write", "HIGH", "xss"),
    (15, r"dangerouslySetInnerHTML",
     "React dangerouslySetInnerHTML usage", "MEDIUM", "xss"),
]
# Rule 5 has a pattern that its usual regex engine rejects, so it never
# fires there; it takes part only when parity with that behaviour is switched off.
RULES_THAT_NEVER_FIRE = [5]
RULE_SUGGESTION = (
    "Review this line for security implications and apply appropriate remediation."
)
RULE_CONFIDENCE = 0.9

# --- fixed values: source text patterns --------------------------------------
PY_DEF = r"^\s*(async\s+)?def\s+(\w+)\s*\(([^)]*)\)"
JS_FUNCTION = (
    r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?"
    r"(?:function|\([^)]*\)\s*=>))"
)
ES6_IMPORT = r"""import\s+(?:.*?\s+from\s+)?["']([^"']+)["']"""
REQUIRE_CALL = r"""require\s*\(\s*["']([^"']+)["']\s*\)"""
IMPORT_EXTENSIONS = [".py", ".js", ".ts", ".tsx", ".jsx"]
CHUNK_BOUNDARY_STARTS = ["def ", "class ", "function ", "async "]

# --- fixed values: findings --------------------------------------------------
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
SEVERITY_ICONS = {
    "CRITICAL": "\U0001f6a8",
    "HIGH": "⚠️",
    "MEDIUM": "\U0001f4a1",
    "LOW": "ℹ️",
    "INFO": "\U0001f4dd",
}
DEFAULT_ICON = "\U0001f4dd"
LINE_PROXIMITY = 3
TITLE_STOP_WORDS = [
    "the", "a", "an", "in", "on", "at", "to", "for",
    "is", "of", "and", "or", "this", "that",
]
AGENTS = ["BugDetector", "SecurityScanner", "StyleAdvisor", "TestCoverage"]

# per agent: confidence threshold, confidence when missing, then field defaults
RESPONSE_DEFAULTS = {
    "BugDetector": dict(
        threshold=0.6, confidence=0.0, severity="MEDIUM", category="logic-error",
        title="Potential bug", description="Bug detected", suggestion="Review this code"),
    "SecurityScanner": dict(
        threshold=0.5, confidence=0.0, severity="MEDIUM", category="security-vulnerability",
        title="Potential security issue", description="Security issue detected",
        suggestion="Review for security"),
    "StyleAdvisor": dict(
        threshold=0.6, confidence=0.0, severity="LOW", category="style-violation",
        title="Style deviation", description="Style issue detected",
        suggestion="Follow repo conventions"),
    "TestCoverage": dict(
        threshold=None, confidence=0.7, severity="MEDIUM", category="missing-test",
        title="Missing test coverage", description="Function lacks test",
        suggestion="Add test cases"),
}
# TestCoverage answers about a file that has no test file
NO_TEST_FILE_DEFAULTS = dict(
    confidence=0.8, title="No test file for ", description="No test coverage",
    suggestion="Create test file")
BASIC_COVERAGE_LIMIT = 5

# --- fixed values: conventions -----------------------------------------------
CONVENTION_DEFAULTS = dict(
    naming_style="snake_case",
    uses_type_hints=True,
    uses_docstrings=True,
    docstring_style="google",
    max_function_length=50,
    uses_black_formatting=False,
    uses_async=False,
    test_naming_pattern="test_*",
)
MERGED_PRS_TO_LEARN_FROM = 3
CALLS_IN_FLIGHT = 5
MAX_SAMPLES = 20
MAX_SAMPLE_CHARS = 2_000
MIN_SAMPLE_CHARS = 20
PROMPT_SAMPLES = 10
MAX_PATTERNS = 10
CACHE_SECONDS = 86_400

# --- fixed values: text cuts and limits --------------------------------------
PROMPT_CHARS = {"bug": 8_000, "security": 8_000, "style": 6_000, "coverage": 6_000}
PROMPT_TEST_CHARS = 4_000
PROMPT_SAMPLE_CHARS = 6_000
RECENT_JOBS = 50
CALLS_PER_MINUTE = 30
NO_FILES_SUMMARY = "No reviewable files in this PR."

# Characters that count as white space when text is stripped or split in words.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
