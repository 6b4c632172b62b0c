"""Fixed values. Results depend on every one of them, so they are stated plainly here."""

from __future__ import annotations

# --- fixed values: topics, in the order that breaks ties -----------------------------------------
# (category, heading, topic searched by meaning, keyword searched literally)
CATEGORIES = [
    (
        "architecture-decisions",
        "Architecture decisions",
        "architecture decisions, technical trade-offs, and the reasoning behind technology choices",
        "architecture",
    ),
    (
        "resolved-bugs",
        "Resolved bugs and root causes",
        "bugs that were debugged and fixed, their root cause and the solution applied",
        "bug",
    ),
    (
        "conventions",
        "Conventions and patterns",
        "coding conventions, naming patterns, project structure and style rules adopted",
        "convention",
    ),
    (
        "environment-gotchas",
        "Environment gotchas",
        "setup steps, environment configuration, build tooling problems and their workarounds",
        "setup",
    ),
]
CATEGORY_NAMES = [name for name, _, _, _ in CATEGORIES]

# --- fixed values: annotation types --------------------------------------------------------------
SUMMARY = "SUMMARY"
DESCRIPTION = "DESCRIPTION"
PROFILE = "HIERARCHICAL_PROFILE_SUMMARY"

# --- fixed values: search and window limits ------------------------------------------------------
DEFAULT_WINDOW_DAYS = 14
EARLIEST_MILLIS = -8_640_000_000_000_000
DEFAULT_SEARCH_LIMIT = 8
MAX_SEARCH_LIMIT = 100
SIMILARITY_THRESHOLD = 0.35
TRACE_LIMIT = 3
UNTITLED = "Untitled session"

# --- fixed values: entry and bullet caps ---------------------------------------------------------
MAX_BULLETS_PER_ENTRY = 6
MAX_BULLET_LENGTH = 280
MAX_ENTRIES_PER_CATEGORY = 4
MINIMUM_RUN_ON_LENGTH = 5
MINIMUM_TERM_LENGTH = 3

# --- fixed values: accepted target documents -----------------------------------------------------
TARGETS = {"agents": "AGENTS.md", "claude": "CLAUDE.md"}

# --- fixed values: names never listed from a repository ------------------------------------------
IGNORED_NAMES = ["node_modules", ".git", "dist", "build", ".github", "coverage"]

# --- fixed values: words too common to tell projects apart ---------------------------------------
GENERIC_TERMS = """
agent agents api app apps assets bench benchmark bin build claude cli codex common component
components config constants context copilot core coverage cursor data dist doc docs e2e example
examples fixture fixtures gemini helper helpers hook hooks index integration layout layouts lib log
logs main memory middleware migration migrations mock mocks model models modules node output package
page pages provider providers public readme route routes schema schemas scripts server service
services shared spec specs src state store style styles temp test tests tmp tools types unit utils
view views web www
""".split()

# --- fixed values: openings that describe work still to do ---------------------------------------
PENDING_OPENINGS = [
    "resolve", "address", "continue", "merge", "finalize", "prioritize", "update", "implement",
    "investigate", "complete", "review", "verify", "publish", "create", "add", "fix", "run", "start",
    "prepare", "schedule", "follow up", "send", "draft", "test", "refactor", "remove", "migrate",
]

# --- fixed values: past forms that do not end in "ed" --------------------------------------------
IRREGULAR_PAST = """
began bought brought built came caught chose cut dealt drew drove fell felt fought found froze gave
got grew held hid hit kept knew laid led left let lit lost made meant met paid put ran read rewrote
rose said sat saw sent set shut sold sought spent split spoke stood swept taught thought threw told
took troubleshot understood went won wrote
""".split()

# --- fixed values: labels that redaction leaves behind -------------------------------------------
PLACEHOLDERS = [
    "redacted", "email", "jwt", "github-token", "slack-token", "aws-key", "api-key",
    "url-with-credentials", "phone", "local path",
]

# --- our own neutral defaults: marker lines, block wording, internal link scheme ------------------
MARKER_START = "<!-- project-memory:start -->"
MARKER_END = "<!-- project-memory:end -->"
BLOCK_TITLE = "Project memory"
PROVENANCE = 'Generated from recorded work sessions — project "%s", last %s days, on %s.'
LINK_SCHEME = "session"
