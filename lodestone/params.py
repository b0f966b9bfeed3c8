"""Every knob of the engine, and the fixed lists that decide what counts as a source file."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    window_lines: int = 50
    overlap_lines: int = 10
    max_chunk_chars: int = 2000
    max_embed_chars: int = 6000
    top_k: int = 12
    candidates: int = 3
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    rrf_k: int = 60
    min_score: float = 0.25
    context_lines: int = 5
    shown_lines: int = 3
    history_turns: int = 4
    history_answer_chars: int = 500
    max_file_bytes: int = 500_000
    limit_requests: int = 3
    limit_seconds: int = 60
    top_languages: int = 8
    question_chars: tuple[int, int] = (3, 2000)


DEFAULTS = Params()

# They must be these for the same files, languages and questions to come out.
SKIP_DIRS = [
    ".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", "out", ".next", ".nuxt", ".output", "target", ".tox", ".nox", ".mypy_cache",
    ".pytest_cache", ".ruff_cache", "coverage", ".cache", ".parcel-cache", ".turbo", "vendor", "third_party", ".idea", ".vscode", ".gradle", ".dart_tool",
]
AST_LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript"}
DISPLAY_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby", ".php": "php",
    ".c": "c", ".cpp": "cpp", ".html": "html", ".css": "css", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".md": "markdown", ".sql": "sql", ".sh": "bash",
}
TEXT_EXTENSIONS = [
    ".c", ".h", ".cpp", ".cc", ".hpp", ".java", ".go", ".rs", ".rb", ".php", ".swift", ".kt", ".scala", ".lua", ".sh", ".bash", ".sql", ".graphql", ".proto",
    ".html", ".css", ".scss", ".vue", ".svelte", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".json", ".json5", ".jsonc", ".md", ".rst", ".txt",
]
SKIP_EXTENSIONS = [
    ".pyc", ".pyo", ".so", ".dll", ".dylib", ".exe", ".bin", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".mp3", ".mp4", ".wav", ".avi",
    ".mov", ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".woff", ".woff2", ".ttf", ".eot",
    ".otf", ".lock",
]
GENERATED_SUFFIXES = [".min.js", ".min.css", ".bundle.js", "_pb2.py", "_pb2_grpc.py"]
LOCK_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "cargo.lock", "poetry.lock"]
STARTERS = [
    ("auth", "How does authentication work?", "What auth middleware is used?"),
    ("route", "How are routes defined?", "What does the routing structure look like?"),
    ("model", "What are the main data models?", "How is the database schema structured?"),
    ("config", "What configuration options are available?", "How is the app configured?"),
    ("test", "How is testing set up?", "What testing framework is used?"),
    ("middleware", "What middleware is applied?", "How does the request pipeline work?"),
    ("api", "What API endpoints are available?", "How is the API structured?"),
    ("util", "What utility functions exist?", "What helper modules are available?"),
    ("component", "What are the main UI components?", "How is the component hierarchy organized?"),
    ("service", "What services does the app use?", "How are services structured?"),
    ("db", "How is the database connected?", "What ORM or query layer is used?"),
    ("handler", "How are requests handled?", "What are the main handler functions?"),
    ("app.", "What does the main entry point do?", "How is the application initialized?"),
    ("main.", "What does the main entry point do?", "How is the application bootstrapped?"),
    ("index.", "What does the main entry point do?", "How is the app started?"),
]
# End of fixed values.
SOURCE_EXTENSIONS = [*AST_LANGUAGES, *TEXT_EXTENSIONS]
