"""Path rules: which files are read, which findings count, which paths are risky."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import basename, suffix

# The sets below decide results and are stated as they must be.
EXCLUDED_DIRS = ["dist", "build", ".next", "__pycache__", "node_modules", ".venv", "venv", "static", "vendor", "vendored", "assets", "third_party", "third-party", "sec-report", "reports", "coverage", "test-results", "artifacts", "vuln-result"]
EXCLUDED_NAMES = [".env", "package-lock.json", "yarn.lock", "Pipfile.lock", "poetry.lock", "Gemfile.lock"]
EXCLUDED_SUFFIXES = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".pdf", ".lock"]
EXCLUDED_NAME_PATTERN = r"^(\.env\..+|.+\.env|.+\.min\.js|.+\.min\.css|.+\.pb\.go|.+_pb2\.py|.+\.generated\..+)$"
SOURCE_SUFFIXES = [".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rb", ".java", ".cs", ".php", ".rs", ".swift", ".kt", ".yml", ".yaml", ".toml", ".json", ".xml", ".tf", ".hcl", ".sh", ".bash", ".zsh", ".sql"]
TEMPLATE_VIEW_SUFFIXES = [".jinja2", ".html", ".htm"]
TEST_MARKERS = ["/test/", "/tests/", "/spec/", "/specs/", "/__tests__/", "/fixtures/", "/mocks/", "/stubs/"]
TEST_SUFFIXES = ["_test.py", "_spec.rb", ".test.js", ".test.ts", ".spec.js", ".spec.ts"]
CALLER_TEST_PREFIXES = ["tests/", "test/", "__tests__/"]
CALLER_TEST_FRAGMENTS = ["/test/", "/tests/", "__tests__", ".test.", ".spec.", "\\test\\", "\\tests\\"]
VENDORED_MARKERS = ["/node_modules/", "/vendor/", "/third_party/"]
LOCKFILES = ["package-lock.json", "yarn.lock", "poetry.lock", "Pipfile.lock"]
CODE_SUFFIXES = [".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".java", ".kt", ".rb"]
SAMPLE_SUFFIXES = [".example", ".sample", ".template", ".tmpl", ".dist"]
BUDGET_RISK_PREFIXES = ["auth/", "authentication/", "authorisation/", "authorization/", "login/", "session/", "oauth/", "sso/", "payments/", "billing/", "checkout/", "stripe/", "admin/", "management/", "internal/", "api/", "endpoints/", "routes/", "crypto/", "security/", "secrets/", "upload/", "uploads/", "files/", "db/", "database/", "models/", "migrations/"]
VERIFIER_RISK_PREFIXES = ["auth/", "authentication/", "authorization/", "permissions/", "billing/", "payments/", "admin/", "tenancy/", "orgs/", "accounts/", "webhooks/", "integrations/", "uploads/", "media/", "attachments/", "import/", "imports/", "avatar/", "avatars/", "documents/", "files/", "assets/uploads/", "static/uploads/", "webhooks/ingest/"]


def _any(tests: list[Column]) -> Column:
    return reduce(or_, tests)


def readable_source(path: Column, content: Column, templates: bool = False) -> Column:
    """F1 and, with ``templates``, F2: whether a file is kept for analysis."""
    name, end = basename(path), suffix(path)
    out = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED_DIRS)))
    out = out | name.isin(EXCLUDED_NAMES) | name.rlike(EXCLUDED_NAME_PATTERN) | end.isin(EXCLUDED_SUFFIXES)
    out = out | (F.instr(F.substring(content, 1, 8192), "\u0000") > 0)
    wanted = end.isin(SOURCE_SUFFIXES + (TEMPLATE_VIEW_SUFFIXES if templates else []))
    return ~out & (wanted | name.rlike(r"^(Dockerfile|Makefile)($|\.)"))


def _rooted(path: Column) -> Column:
    """The path under a root, empty and "." segments left out and ".." resolved where a name precedes it."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when((x == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def drop_rule(path: Column) -> Column:
    """test_or_fixture_path, then lockfile_or_vendored, else null."""
    rooted, name = _rooted(path), basename(path)
    test = _any([rooted.contains(x) for x in TEST_MARKERS] + [name.endswith(x) for x in TEST_SUFFIXES])
    vendored = _any([rooted.contains(x) for x in VENDORED_MARKERS]) | name.isin(LOCKFILES)
    return F.when(test, "test_or_fixture_path").when(vendored, "lockfile_or_vendored")


def risky(path: Column, prefixes: list[str]) -> Column:
    """starts with a prefix, or has it after a slash; case and slash direction don't matter."""
    low = F.translate(F.lower(path), "\\", "/")
    return _any([low.startswith(p) | low.contains(f"/{p}") for p in prefixes])


def sample_file(path: Column) -> Column:
    """F6."""
    return _any([F.lower(path).endswith(x) for x in SAMPLE_SUFFIXES])


def code_file(path: Column) -> Column:
    """F7."""
    return _any([F.lower(path).endswith(x) for x in CODE_SUFFIXES])


def caller_test_file(path: Column) -> Column:
    """tests as the search for callers sees them."""
    low = F.lower(path)
    return _any([low.startswith(x) for x in CALLER_TEST_PREFIXES] + [low.contains(x) for x in CALLER_TEST_FRAGMENTS])


def safe_member(path: Column, size: Column, limit: int = 2_000_000) -> Column:
    """A relative path without NUL, ".." or root, and at most ``limit`` bytes."""
    bad = (F.instr(path, "\u0000") > 0) | path.startswith("/") | F.array_contains(F.split(path, "/"), "..") | (path == "")
    return ~bad & (size <= limit)
