"""Fixed values the results depend on, and the package's own size limits."""

# ---- fixed values: results must agree with them exactly ----

IGNORE_DEFAULT = (
    "__pycache__|.git|.DS_Store|.idea|.venv|.pytest_cache|tmp|"
    "run_history|artifacts|__init__.py|.pre-commit-config.yaml|"
    ".env|.env.sample|.envrc|CLAUDE.md|.ruff_cache|build|dist"
)

HASH_MISSING = "FILE_MISSING"
HASH_ERROR = "HASH_ERROR"

TEXT_CHECK_BYTES = 1024
TREE_MAX_DEPTH = 5
STALE_POLL_MS = 2500

LANGUAGE_BY_SUFFIX = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".cpp": "cpp",
    ".hpp": "cpp",
    ".c": "c",
    ".h": "c",
    ".cs": "csharp",
    ".html": "html",
    ".css": "css",
    ".json": "json",
    ".xml": "xml",
    ".md": "markdown",
    ".sh": "bash",
    ".rb": "ruby",
    ".php": "php",
    ".go": "go",
    ".rs": "rust",
    ".swift": "swift",
    ".kt": "kotlin",
    ".sql": "sql",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
    ".ini": "ini",
    ".cfg": "ini",
    ".dockerfile": "dockerfile",
    ".tf": "terraform",
    ".log": "log",
    ".txt": "",
}

PROJECT_MARKERS = (
    "pyproject.toml",
    "setup.py",
    "requirements.txt",
    "package.json",
    "node_modules",
    "Cargo.toml",
    ".git",
    "pom.xml",
    "build.gradle",
)

EXTENSION_GROUPS = {
    "Python": ("py",),
    "JavaScript": ("js",),
    "TypeScript": ("ts", "tsx"),
    "Text": ("txt", "md"),
    "Configuration": ("json", "yaml", "yml", "toml", "ini"),
}

MODE_ALL = "All Files"
MODE_SINGLE = "Single File"

NO_TEXT_FILES = "# No text files selected or available to display content."
STALE_TOOLTIP_HEAD = "Files have changed since this history state was captured:"
STALE_HEADLINES = {
    "missing": "Files Missing!",
    "error": "File Errors!",
    "modified": "Files Modified since this state. You may want to refresh.",
}

# headings of the pack format
CODE_HEADING = "# Code from: "
IMPORTS_HEADING = "# Imports (potentially includes more than needed):"
SELECTED_HEADING = "# Selected Classes/Functions:"
TREE_HEADING = "# Folder Tree of "

# error texts
SYNTAX_ERROR = "Syntax error in {name}: line {line} - {reason}"
PARSE_ERROR = "Failed to parse Python file {name}: {reason}"
BLOCK_ERROR = ": Error processing - "
FILE_NOT_FOUND = ("FileNotFoundError", "One or more files could not be found")
BAD_SESSION_ID = ("ValidationError", "Invalid session ID format", "Valid UUID string")
BAD_PATH = "Invalid file path provided"

ACTIONS = ("process_files", "get_python_symbols", "update_selection", "save_session", "load_session")

# str.isspace() and str.splitlines() of Python, as characters
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK_CHARS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

# ---- the package's own limits: how much one task, one row or one broadcast may hold ----

# Largest key a single window task may order; a bigger key is cut into ordered slices.
ROWS_PER_SLICE = 1_000_000
# Largest text one output row may hold; a longer pack continues in further numbered parts (columns part, parts).
PART_BYTES = 64 * 1024 * 1024
# Largest table, as JSON text, that is sent whole to every executor.
BROADCAST_BYTES = 32 * 1024 * 1024
# Largest list or map one output row may hold; a bigger one continues in further shards (column shard).
SHARD_ROWS = 100_000
