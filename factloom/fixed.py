"""Names, orders and tables the results depend on. Plain data, no logic."""

# Link kinds in schema order; the position is the kind's rank.
LINK_KINDS = [
    "calls", "calls-port", "depends-on-port", "hands-off", "listens-to", "calls-out", "wires", "routes",
    "implements", "refines", "inherits", "uses-type", "holds", "constructs", "matches-on",
    "reads", "queues",
    "tests", "re-exports", "expands", "decorates",
    "refers-to",
]

# Link kind families; refers-to is in none.
LINK_FAMILIES = {
    "call": ["calls", "calls-port", "depends-on-port", "hands-off", "listens-to", "calls-out", "wires", "routes"],
    "type": ["implements", "refines", "inherits", "uses-type", "holds", "constructs", "matches-on"],
    "data": ["reads", "queues"],
    "structure": ["tests", "re-exports", "expands", "decorates"],
}

# Link kinds whose origin is declared, and those that exist at compile time only.
DECLARED_KINDS = ["implements", "refines", "re-exports", "inherits", "decorates", "holds"]
COMPILE_TIME_KINDS = ["expands", "decorates", "inherits"]

# Link kinds that carry a direction.
DIRECTED_KINDS = ["calls", "calls-out", "hands-off", "listens-to", "routes"]

CONFIDENCES = ["resolved", "guessed", "declared"]
ITEM_KINDS = ["fn", "struct", "enum", "trait", "impl", "mod", "macro", "const", "static", "type-alias", "union"]
VISIBILITIES = ["pub", "crate", "super", "restricted", "private"]
PORT_KINDS = ["rpc", "http", "cli", "topic", "crate", "sql", "pub", "redis", "fs", "tty"]
NOT_IO_KINDS = ["crate", "pub", "declared"]
SECTIONS = ["platform-services", "third-party", "events", "data-stores", "os", "libraries", "unresolved"]
SIDES = ["driving", "driven"]

# Columns of the two drawing rules, left to right, and the rank of each column.
COLUMN_RANKS = {
    "driving": 0, "public-api": 0, "domain": 1, "internals": 1, "driven": 2, "leaves": 2, "externals": 3,
}
HEXAGON_SIDES = ["driving", "domain", "driven"]
RAIL_COLUMN = "externals"

# (target kind, use context) -> link kind, access; a fn call and the test and trait cases are in the operator.
USE_TABLE = [
    ("fn", "call", "calls", None), ("fn", "value", "refers-to", None),
    ("const", "call", "reads", "read"), ("const", "value", "reads", "read"),
    ("static", "call", "reads", "read"), ("static", "value", "reads", "read"),
    ("struct", "call", "constructs", None), ("struct", "construct", "constructs", None),
    ("struct", "value", "constructs", None),
    ("union", "call", "constructs", None), ("union", "construct", "constructs", None),
    ("union", "value", "constructs", None),
    ("struct", "type", "uses-type", None), ("union", "type", "uses-type", None),
    ("enum", "type", "uses-type", None), ("type-alias", "type", "uses-type", None),
    ("struct", "impl-self", "uses-type", None), ("union", "impl-self", "uses-type", None),
    ("enum", "impl-self", "uses-type", None),
    ("struct", "field", "holds", None), ("union", "field", "holds", None),
    ("enum", "field", "holds", None), ("type-alias", "field", "holds", None),
    ("trait", "impl-trait", "implements", None), ("trait", "supertrait", "refines", None),
    ("trait", "type", "depends-on-port", None), ("trait", "field", "depends-on-port", None),
    ("macro", "macro", "expands", None),
    ("variant", "call", "constructs", None), ("variant", "construct", "constructs", None),
    ("variant", "value", "constructs", None), ("variant", "pattern", "matches-on", None),
    ("external", "call", "calls-out", None), ("external", "value", "refers-to", None),
    ("external", "construct", "constructs", None), ("external", "type", "uses-type", None),
    ("external", "impl-self", "uses-type", None), ("external", "field", "holds", None),
    ("external", "impl-trait", "implements", None), ("external", "supertrait", "refines", None),
    ("external", "macro", "expands", None),
]

# Session states and triggers, and every legal edge (from, trigger, to).
SESSION_STATES = [
    "planning", "running", "asks", "deviation", "gate", "gate-failed", "done", "in-review", "merged", "archived",
    "yours",
]
TRANSITIONS = [
    ("planning", "delegate", "running"), ("planning", "save-plan", "yours"),
    ("running", "ask", "asks"), ("asks", "answer", "running"),
    ("running", "denied", "deviation"), ("deviation", "typology", "running"),
    ("running", "group-done", "gate"), ("gate", "gate-passed", "running"), ("gate", "fix-round", "running"),
    ("gate", "budget-spent", "gate-failed"), ("gate", "last-gate-passed", "done"),
    ("gate-failed", "one-more", "running"), ("gate-failed", "replan", "running"),
    ("gate-failed", "accept-as-is", "running"), ("gate-failed", "accept-as-is-last", "done"),
    ("done", "pr-created", "in-review"), ("in-review", "merged", "merged"), ("merged", "archived", "archived"),
]

# Words after FROM, JOIN, INTO or UPDATE that are no table.
NOT_TABLES = ["select", "set", "only", "lateral", "unnest"]
# Database drivers' dialects, in the order they are looked for.
DIALECTS = ["postgres", "mysql", "sqlite"]
# Commit types of a conventional subject.
COMMIT_TYPES = ["feat", "fix", "refactor", "perf", "test", "docs", "style", "build", "ci", "chore", "revert"]

# Overlay kind -> the channel it is drawn in.
OVERLAY_CHANNELS = {"sessions": "outline", "plan": "fill", "findings": "fill", "delta": "fade"}
FOLD_ITEM_THRESHOLD = 80
FOLD_SCALE_FLOOR = 0.7

# Declaration lines are counted by the keyword before the name, which these words may come before; and macro_rules on its own.
DECL_KINDS = ["fn", "struct", "enum", "trait", "type", "const", "static", "mod"]
DECL_MODIFIERS = ["pub", "default", "const", "async", "unsafe", "extern"]

# Dot folders that a scan of files enters: at any level, and at the top alone.
DOT_FOLDERS = (".arch",)
TOP_DOT_FOLDERS = (".cargo",)
