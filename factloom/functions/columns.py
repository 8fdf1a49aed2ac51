"""Column expressions over facts, texts and logs. All are built-in functions but ``structure_fingerprint``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom import fixed
from factloom.functions.fingerprint import fingerprints

# ---------------------------------------------------------------- predicates and classes


def non_test(cfg: Column) -> Column:
    """True unless the cfg text holds the word ``test``."""
    words = F.split(cfg, r"[^\p{IsAlphabetic}\p{N}]+")
    return ~F.coalesce(F.array_contains(words, "test"), F.lit(False))


def is_io(kind: Column) -> Column:
    return ~kind.isin(fixed.NOT_IO_KINDS)


def link_family(kind: Column) -> Column:
    """The family of a link kind; null for kinds outside the families."""
    out = F.lit(None).cast("string")
    for family, kinds in fixed.LINK_FAMILIES.items():
        out = F.when(kind.isin(kinds), family).otherwise(out)
    return out


def kind_rank(kind: Column) -> Column:
    """Position of a link kind in schema order, from 0."""
    return F.array_position(F.array(*[F.lit(k) for k in fixed.LINK_KINDS]), kind) - 1


def link_origin(kind: Column) -> Column:
    return F.when(kind.isin(fixed.DECLARED_KINDS), "declared")


def is_compile_time(kind: Column) -> Column:
    return kind.isin(fixed.COMPILE_TIME_KINDS)


def confidence_level(confidence: Column, level: Column) -> Column:
    """Only a resolved link keeps its rule's level."""
    return F.when(confidence == "resolved", level).otherwise(F.lit("warn"))


def check_state(status: Column, conclusion: Column) -> Column:
    done = status == "completed"
    return (
        F.when(done & F.coalesce(conclusion == "success", F.lit(False)), "passed")
        .when(done & F.coalesce(conclusion.isin("neutral", "skipped"), F.lit(False)), "skipped")
        .when(done, "failed")
        .otherwise("pending")
    )


def status_state(state: Column) -> Column:
    """The same for commit statuses."""
    return F.when(state == "success", "passed").when(state == "pending", "pending").otherwise("failed")


def request_state(state: Column, merged_at: Column) -> Column:
    return F.when(state == "open", "open").when(merged_at.isNotNull(), "merged").otherwise("closed")


def denial_cause(reason: Column) -> Column:
    return (
        F.when(reason.contains(" is outside element "), "scope")
        .when(reason.contains(" has not read it") | reason.contains(" changed since element "), "stale")
        .otherwise("command")
    )


def lint_level(setting: Column) -> Column:
    """Level of a lint setting given as text; null when the lint is off."""
    return F.when(setting == "block", "block").when(setting.isin("true", "warn"), "warn")


def is_gate_line(author: Column, text: Column, tool_author: str = "tool") -> Column:
    return (author == tool_author) & F.coalesce(text.startswith("gate · "), F.lit(False))


def is_public(visibility: Column, reexported: Column, entry: Column) -> Column:
    return (visibility == "pub") | F.coalesce(reexported, F.lit(False)) | F.coalesce(entry, F.lit(False))


def is_source_file(path: Column) -> Column:
    """Files facts come from: sources, migrations, manifests, lock files, the top cargo config."""
    parts = F.split(path, r"[/\\]")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    name = F.element_at(parts, -1)
    config_dir = (F.size(dirs) == 1) & (F.coalesce(F.try_element_at(dirs, F.lit(1)), F.lit("")) == ".cargo")
    holds = config_dir | (
        (F.coalesce(F.try_element_at(dirs, F.lit(1)), F.lit("")) != "target")
        & ~F.exists(dirs, lambda d: d.startswith("."))
    )
    manifest = name.isin("Cargo.toml", "Cargo.lock")
    source = name.endswith(".rs") | (name.endswith(".sql") & F.array_contains(dirs, "migrations"))
    wanted = F.when(config_dir, name.isin("config", "config.toml")).otherwise(manifest | source)
    return holds & ~name.startswith(".") & wanted


# ---------------------------------------------------------------- identity


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def facts_key(path: Column, file_hash: Column, package: Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.replace(path, F.lit("\\"), F.lit("/")), file_hash, package), 256)


def element_id(session: Column, intention: Column, site: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", session, intention, site), 256), 1, 8)


def tree_key(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(":"), name)


def tree_key_kind(key: Column) -> Column:
    """``commit`` or ``worktree``; null for any other text."""
    return F.nullif(F.regexp_extract(key, r"(?s)^(commit|worktree):(.*)$", 1), F.lit(""))


def tree_key_name(key: Column) -> Column:
    return F.when(tree_key_kind(key).isNotNull(), F.regexp_extract(key, r"(?s)^(commit|worktree):(.*)$", 2))


def git_blob_id(content: Column, bits: int = 160) -> Column:
    """Object id of a file's bytes; ``bits`` is 160 or 256."""
    octets = F.encode(content, "UTF-8")
    whole = F.concat(
        F.encode(F.concat(F.lit("blob "), F.octet_length(octets).cast("string"), F.lit("\0")), "UTF-8"), octets
    )
    return F.sha1(whole) if bits == 160 else F.sha2(whole, 256)


def structure_fingerprint(text: Column) -> Column:
    """Hash of what other files can see of a source text: its tokens outside function bodies.

    Comments and whitespace do not count. Items declared inside a body do, and so do bodies of constant functions and
    initializers. One pass over the tokens, to any depth. Attributes and macro calls inside a body are body; nested block
    comments end at the first end mark. The pass is a Python helper on Arrow batches: as nested built-in functions it copied its
    state at each token.
    """
    return F.arrow_udf(fingerprints, "string")(text.cast("binary"))


# ---------------------------------------------------------------- text


def site_of(item_id: Column, file: Column, module: Column) -> Column:
    """``<file>::<path of the item in its module>``, impl blocks named by their type."""
    path = F.when(item_id.contains("#"), F.regexp_replace(item_id, r"#[^#]*$", "")).otherwise(item_id)
    marker = F.concat(F.lit("::"), module, F.lit("::"))
    at = F.position(marker, path)
    root = F.when(path.contains("::"), F.regexp_replace(path, r"(?s)^.*?::", "")).otherwise(path)
    inside = F.when(at > 0, F.substring(path, at + F.length(marker), F.length(path))).otherwise(path)
    local = F.when(module == "", root).otherwise(inside)
    local = F.when(local.startswith("impl "), F.regexp_replace(local, r"(?s)^impl (?:.* for )?", "")).otherwise(local)
    return F.concat(file, F.lit("::"), local)


def kebab_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<!^)([A-Z])", "-$1"))


def table_name(word: Column) -> Column:
    """The table a word of SQL names, lower case; null when it is no name."""
    last = F.element_at(F.split(word, r"\."), -1)
    bare = F.regexp_replace(last, r"^[\"`\[\]]+|[\"`\[\]]+$", "")
    return F.when(bare.rlike(r"^[\p{IsAlphabetic}\p{N}_]+$") & ~bare.rlike(r"^[0-9]"), F.lower(bare))


def host_in(text: Column) -> Column:
    """The one host with a dot named by http(s) literals; null when none or several."""
    found = F.regexp_extract_all(text, F.lit(r"https?://([\p{IsAlphabetic}\p{N}.-]*)"), F.lit(1))
    hosts = F.filter(F.array_distinct(found), lambda h: h.contains("."))
    return F.when(F.size(hosts) == 1, F.get(hosts, F.lit(0)))


def commit_trailers(block: Column) -> Column:
    """``Key: value`` lines as an array of (key, value); keys may repeat, empty keys are dropped."""
    lines = F.filter(F.split(block, "\n"), lambda l: l.contains(":"))
    pairs = F.transform(
        lines,
        lambda l: F.struct(
            F.trim(F.substring_index(l, ":", 1)).alias("key"),
            F.trim(F.regexp_replace(l, r"^[^:]*:", "")).alias("value"),
        ),
    )
    return F.filter(pairs, lambda t: t["key"] != "")


def element_trailer(trailers: Column, suffix: str = "-Element") -> Column:
    """Value of the first trailer whose key ends in ``suffix``."""
    mine = F.filter(trailers, lambda t: t["key"].endswith(suffix))
    return F.get(mine, F.lit(0))["value"]


def conventional_subject(kind: Column, area: Column, summary: Column) -> Column:
    """``type(area): summary``; null when the type is unknown or the summary is not one line."""
    text = F.regexp_replace(summary, r"^\s+|\s+$", "")
    ok = kind.isin(fixed.COMMIT_TYPES) & (text != "") & ~text.contains("\n")
    head = F.when(area.isNull(), kind).otherwise(F.concat(kind, F.lit("("), area, F.lit(")")))
    return F.when(ok, F.concat(head, F.lit(": "), text))


def tail(text: Column, size: int) -> Column:
    """The last ``size`` bytes cut at a character boundary, with ``…`` in front when cut."""
    octets = F.encode(text, "UTF-8")
    cut = F.substring(octets, -size, size)
    # A cut inside a character leaves 1 to 3 continuation bytes (0x80-0xBF) in front.
    lead = F.regexp_extract(F.hex(cut), r"^((?:[89AB][0-9A-F])*)", 1)
    kept = F.unhex(F.substring(F.hex(cut), F.length(lead) + 1, F.lit(2 * size)))
    return F.when(F.octet_length(octets) <= size, text).otherwise(
        F.concat(F.lit("…"), F.decode(kept, "UTF-8"))
    )


def short(text: Column, size: int = 160) -> Column:
    """The first line, at most ``size`` characters, with ``…`` when cut."""
    line = F.regexp_replace(F.substring_index(text, "\n", 1), r"\r$", "")
    return F.when(F.char_length(line) > size, F.concat(F.substring(line, 1, size), F.lit("…"))).otherwise(line)


def one_line(tool_input: Column) -> Column:
    """A tool's JSON input in one line: its path, command or pattern when it has one."""
    named = F.coalesce(*[F.get_json_object(tool_input, f"$.{k}") for k in ("file_path", "path", "command", "pattern")])
    return short(F.coalesce(named, tool_input))


def markdown_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def line_of(text: Column, at: Column) -> Column:
    """1-based line of the character at 1-based position ``at``."""
    before = F.substring(text, F.lit(1), at - 1)
    return (F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def column_of(text: Column, at: Column) -> Column:
    """1-based column, in characters, of the character at position ``at``."""
    before = F.substring(text, F.lit(1), at - 1)
    return (F.char_length(F.substring_index(before, "\n", -1)) + 1).cast("bigint")


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_path(path: Column) -> Column:
    """The path with ``.`` dropped and ``..`` applied; leading ``..`` stay."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    can_pop = lambda acc: (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "..") & can_pop(acc), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(
            F.array_append(acc, p)
        ),
    )
    root = F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(root, F.array_join(walked, "/"))


def covers(parent: Column, target: Column) -> Column:
    """A target covers itself and what is under it."""
    return (parent == target) | target.startswith(F.concat(parent, F.lit("::")))


def witness_place(file: Column, tool: Column) -> Column:
    return F.coalesce(file, tool)


def witness_line(line: Column) -> Column:
    return F.coalesce(line, F.lit(0)).cast("bigint")


def witness_text(file: Column, line: Column, tool: Column) -> Column:
    return F.coalesce(F.concat(file, F.lit(":"), line.cast("string")), tool)


def tool_result_text(content: Column) -> Column:
    """Text of a tool result given as JSON: a string, or an array of text parts joined by newlines."""
    parts = F.from_json(content, "array<struct<text:string>>")
    texts = F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull())
    plain = F.from_json(F.concat(F.lit('{"v":'), content, F.lit("}")), "v string")["v"]
    return (
        F.when(content.startswith("["), F.array_join(texts, "\n"))
        .when(content.startswith('"'), plain)
        .otherwise(F.lit(""))
    )


def rule_text(subject: Column, relation: Column, target: Column) -> Column:
    return F.concat_ws(" ", subject, F.lit("must not"), relation, target)


def glob_regex(glob: Column) -> Column:
    """A path glob as a regex for the whole path; ``*`` crosses ``/``, ``**`` stands for whole directories."""
    out = F.regexp_replace(glob, r"([.+^$()|\\])", r"\\$1")
    out = F.regexp_replace(out, r"\[!", "[^")
    out = F.regexp_replace(out, r"^\*\*/", "\u0001")
    out = F.regexp_replace(out, r"/\*\*/", "\u0002")
    out = F.regexp_replace(out, r"/\*\*$", "\u0003")
    out = F.regexp_replace(out, r"\*+", ".*")
    out = F.replace(out, F.lit("?"), F.lit("."))
    out = F.regexp_replace(out, r",(?=[^{}]*\})", "|")
    out = F.replace(F.replace(out, F.lit("{"), F.lit("(?:")), F.lit("}"), F.lit(")"))
    out = F.replace(out, F.lit("\u0001"), F.lit("(?:/?|.*/)"))
    out = F.replace(out, F.lit("\u0002"), F.lit("(?:/|/.*/)"))
    out = F.replace(out, F.lit("\u0003"), F.lit("/.*"))
    return F.concat(F.lit("(?s)^"), out, F.lit("$"))


def glob_folder(glob: Column) -> Column:
    """The folder that every path of a glob lies in, or the glob itself if it has no wildcard; the root is empty."""
    start = F.regexp_extract(glob, r"^[^*?\[{]*", 0)
    return F.when(start == glob, glob).otherwise(F.regexp_extract(start, "(?s)^(.*)/[^/]*$", 1))


def area_paths(base: Column, files: Column) -> Column:
    """The globs of a module at ``base``: its file when there is one, its directory when it has files."""
    file, folder = F.concat(base, F.lit(".rs")), F.concat(base, F.lit("/"))
    return F.filter(
        F.array(
            F.when(F.array_contains(files, file), file),
            F.when(F.exists(files, lambda f: f.startswith(folder)), F.concat(folder, F.lit("**"))),
        ),
        lambda p: p.isNotNull(),
    )


def ancestors(path: Column) -> Column:
    """Every directory holding the path, the path itself and the empty root included."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )


#: What a word before a declaration's keyword takes along.
_TAKES = {"pub": r"(?:\([^)]*\))?", "extern": r'(?:\s+"[^"]*")?'}


def declaration_line(kinds: Sequence[str]) -> str:
    """The pattern of a line with nothing but modifiers before one of the keywords and a name."""
    before = "|".join(word + _TAKES.get(word, "") for word in fixed.DECL_MODIFIERS)
    return rf"^\s*(?:(?:{before})\s+)*(?:{'|'.join(kinds)})\s+[A-Za-z_]"


def declarations(text: Column) -> dict[str, Column]:
    """Counts of declaration lines by kind, ``decls`` for all kinds, ``lines`` for newlines."""
    lines = F.split(text, "\n")

    def matching(pattern: str) -> Column:
        return F.size(F.filter(lines, lambda l: l.rlike(pattern))).cast("bigint")

    out = {kind: matching(declaration_line([kind])) for kind in fixed.DECL_KINDS}
    out["decls"] = matching("(?:" + declaration_line([*fixed.DECL_KINDS, "union"]) + r"|^\s*macro_rules!\s)")
    out["lines"] = (F.size(lines) - 1).cast("bigint")
    return out
