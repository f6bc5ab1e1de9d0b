"""Fixed values of the data model: types, vocabularies, word lists."""

from __future__ import annotations

EVENTS = (
    "project_id string, id string, session_id string, agent_role string, start_time double, end_time double, text string,"
    " event_kind string, tool_name string, files array<string>, commit string, seq long"
)

# Preference order, community weight and verb of each edge type.
EDGE_TYPES = {"Supersedes": (3, 0.6, "supersedes"), "Refutes": (2, 0.3, "refutes"), "Resolves": (1, 0.8, "resolves"), "RelatesTo": (0, 1.0, "relates to")}

# Prefixes of ids and reasons that judged nodes and edges carry.
JUDGED_ID, JUDGED_REASON = "jev-", "jev-native: "

SEVERITY = {"High": 3, "Medium": 2}  # anything else: 1

# Stop words of the index tokenizer.
INDEX_STOP = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can to of in for "
    "on with at by from as into through during before after above below between under again further then once here there when "
    "where why how all each few more most other some such no nor not only own same so than too very just because but and or if "
    "while about what which who whom this that these those it its they them their we our you your he she his her i me my"
).split()

# Stop words of community labels, the same list without one word.
COMMUNITY_STOP = [w for w in INDEX_STOP if w != "shall"]

# Stop words of the content tokenizer.
CONTENT_STOP = (
    "the a an and or of to in for on with at by from as is are was were be been being this that these those it its they them "
    "their we our you your i me my he she his her will would should could can may might shall must do does did not no nor so "
    "than too very just because but if while about what which who whom when where why how all any both each few more most other "
    "some such only own same then once here there also into out up down over under again further against between through during "
    "before after above below"
).split()

# Tool classes.
WRITE_TOOLS = (
    "edit write multiedit apply_patch applypatch patch create_file replace str_replace move remove rm delete notebook_edit insert_content search_and_replace"
).split()
CHECK_TOOLS = "test run_tests lint typecheck type_check build compile diagnostics".split()
SHELL_TOOLS = "bash shell terminal run_command".split()
CHECK_COMMANDS = [
    "cargo test", "cargo build", "cargo check", "cargo clippy", "npm test", "npm run", "npx tsc", "tsc ", "pytest", "python -m pytest", "go test",
    "go build", "go vet", "make test", "make check", "ruff", "eslint", "prettier --check", "bun test", "bunx tsc", "vitest", "jest",
]
READ_COMMANDS = [
    "ls", "cat ", "head ", "tail ", "grep", "rg ", "rg/", "find ", "wc ", "which ", "git status", "git log", "git diff", "git show", "git branch", "echo ", "pwd",
]
CLEAR_MARKS = ["0 failed", "0 failures", "0 failing", "all tests passed", "no failures"]
FAIL_MARKS = ["failed", "failure", "error[", "error:", "assertionerror", "compilation error", "does not compile", "✗"]

# Markers of rules and decisions in notes.
DECISION_MARKERS = [
    "we use", "we chose", "we decided", "we do", "uses ", "instead of", "over ", "chosen", "decided", "settled", "picked", "committed to",
    "the project uses", "convention:", "pattern:", "architecture:",
]
RULE_MARKERS = [
    "must", "must not", "never", "always", "do not", "don't ", "avoid ", "required", "has to", "only use", "no third-party", "forbidden", "prohibited",
    "should be", "keep ", "use ", "prefer ", "make sure", "ensure ", "needs to", "mandatory", "standard library only",
]

# Directional relation choices -> (edge type, source, target).
RELATIONS = {
    "later_supersedes_earlier": ("Supersedes", "later", "earlier"), "later_resolves_earlier": ("Resolves", "later", "earlier"),
    "later_relates_earlier": ("RelatesTo", "later", "earlier"), "later_refutes_earlier": ("Refutes", "later", "earlier"),
    "earlier_supersedes_later": ("Supersedes", "earlier", "later"), "earlier_resolves_later": ("Resolves", "earlier", "later"),
    "earlier_relates_later": ("RelatesTo", "earlier", "later"), "earlier_refutes_later": ("Refutes", "earlier", "later"),
}
