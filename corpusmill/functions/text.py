"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: ticket label -> branch type
LABEL_TYPES = {"feature": "feat", "enhancement": "feat", "bug": "fix", "refactor": "refactor", "documentation": "docs", "test": "test"}
# fixed values: patterns of commit subjects, of titles, and of a leading short hash
COMMIT_PREFIX = r"^([a-z]+)(\(.+\))?!?:"
BREAKING = r"^[a-z]+(\(.+\))?!:"
FEATURE = r"^feat(\(.+\))?!?:"
TITLE_PREFIX = r"^(\w+)(?:\(.*?\))?!?:\s"
SHORT_HASH = r"^[0-9a-f]{3,40} "
# fixed values: what a secret scan takes for a placeholder
PLACEHOLDERS = ["changeme", "change-me", "change_me", "placeholder", "example", "example.com", "dummy", "test", "testing", "redacted", "xxx", "xxxx", "xxxxx", "none", "null", "todo", "your-key", "your_key", "your-token", "your_token", "my-secret", "my_secret", "secret", "password"]
PLACEHOLDER_LENGTH = 7
# fixed values: formats that are secrets by themselves, and keywords whose quoted value may be one
SECRET_FORMATS = {"aws_access_key": r"AKIA[0-9A-Z]{16}", "github_token": r"ghp_[0-9A-Za-z]{36}|github_pat_[0-9A-Za-z_]{22,}", "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----"}
SECRET_KEYWORDS = ["password", "secret", "api_key", "token"]


def first_line(text: Column) -> Column:
    """The first line of the text without outer white space, trimmed."""
    return F.trim(F.element_at(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n"), 1))


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


def slug(title: Column, most: int = 40) -> Column:
    """Lower case, runs of other characters to one hyphen, at most `most` characters cut at a hyphen; none left: `untitled`."""
    whole = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.left(whole, F.lit(most))
    at = F.regexp_replace(cut, "-[^-]*$", "")
    short = F.when(F.char_length(at) > 0, at).otherwise(cut)
    return F.when(whole == "", "untitled").when(F.char_length(whole) <= most, whole).otherwise(F.regexp_replace(short, "-+$", ""))


def branch_type(labels: Column, title: Column) -> Column:
    """No labels: feat. Else the first known label, then a conventional prefix of the title with a known type, then chore."""
    types = F.create_map(*[F.lit(x) for kv in LABEL_TYPES.items() for x in kv])
    known = F.filter(labels, lambda x: x.isin(list(LABEL_TYPES)))
    prefix = F.regexp_extract(title, TITLE_PREFIX, 1)
    return F.when(labels.isNull() | (F.size(labels) == 0), "feat").when(F.size(known) > 0, F.element_at(types, F.element_at(known, 1))).when(prefix.isin(sorted(set(LABEL_TYPES.values()))), prefix).otherwise("chore")


def commit_message(subject: Column) -> Column:
    """The subject without a leading short hash."""
    return F.regexp_replace(subject, SHORT_HASH, "")


def commit_type(subject: Column) -> Column:
    found = F.regexp_extract(commit_message(subject), COMMIT_PREFIX, 1)
    return F.when(found == "", "other").otherwise(found)


def is_breaking(subject: Column) -> Column:
    message = commit_message(subject)
    return message.rlike(BREAKING) | F.contains(message, F.lit("BREAKING CHANGE:"))


def is_feature(subject: Column) -> Column:
    """A feature that is not breaking."""
    return commit_message(subject).rlike(FEATURE) & ~is_breaking(subject)


def next_version(major: Column, minor: Column, patch: Column, breaking: Column, feature: Column) -> Column:
    """Breaking: major (minor before 1.0); feature: minor; else patch."""
    bump = version_bump(major, breaking, feature)
    text = lambda *p: F.concat(F.lit("v"), F.concat_ws(".", *[x.cast("string") for x in p]))
    zero = F.lit(0)
    return F.when(bump == "major", text(major + 1, zero, zero)).when(bump == "minor", text(major, minor + 1, zero)).otherwise(text(major, minor, patch + 1))


def version_bump(major: Column, breaking: Column, feature: Column) -> Column:
    return F.when(breaking, F.when(major > 0, "major").otherwise("minor")).when(feature, "minor").otherwise("patch")


def version_key(tag: Column, prefix: str = "") -> Column:
    """Numbers of a version tag, comparable; null if it is none."""
    body = F.substring(tag, len(prefix) + 1, 1000)
    parts = [F.regexp_extract(body, r"^v?(\d+)\.(\d+)\.(\d+)$", i).try_cast("int") for i in (1, 2, 3)]
    return F.when(F.startswith(tag, F.lit(prefix)) & parts[2].isNotNull(), F.array(*parts))


def is_placeholder(value: Column) -> Column:
    v = F.trim(value)
    return (F.char_length(v) <= PLACEHOLDER_LENGTH) | F.lower(v).isin(PLACEHOLDERS) | v.rlike("^<.*>$") | v.rlike(r"^\*+$") | F.contains(v, F.lit("..."))


def _decimal(x: Column) -> Column:
    return F.format_string("%.1f", x)


def format_count(n: Column) -> Column:
    """1.5K style; below a thousand as it is."""
    out = n.cast("string")
    for power, unit in ((3, "K"), (6, "M"), (9, "B")):
        out = F.when(F.abs(n) >= 10**power, F.concat(_decimal(n / 10**power), F.lit(unit))).otherwise(out)
    return out


def format_size(n: Column) -> Column:
    """2.0 KB style; below a kilobyte whole bytes."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        out = F.when(F.abs(n) >= 1024**i, F.concat(_decimal(n / 1024**i), F.lit(f" {unit}"))).otherwise(out)
    return out


def env_name(namespace: Column, key: Column, lead: str = "APP") -> Column:
    """Environment name of a key: a dot of the namespace becomes two underscores, and one stands before the key."""
    return F.concat(F.lit(lead + "_"), F.replace(F.upper(namespace), F.lit("."), F.lit("__")), F.lit("_"), F.upper(key))


def layered(*layers: tuple[str, Column], empty_is_absent: bool = False) -> tuple[Column, Column]:
    """(value, provenance): the first layer that has a value, and its name (`missing` if none has)."""
    own = [(n, F.nullif(c, F.lit("")) if empty_is_absent and i == 0 else c) for i, (n, c) in enumerate(layers)]
    source = F.lit("missing")
    for name, c in reversed(own):
        source = F.when(c.isNotNull(), F.lit(name)).otherwise(source)
    return F.coalesce(*[c for _, c in own]), source


def module_name(path: Column) -> Column:
    """Dotted module name of a source path: suffix, `__init__` and a leading `src` dropped."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), "^src/", "")
    return F.replace(bare, F.lit("/"), F.lit("."))


def is_test_module(module: Column) -> Column:
    return F.exists(F.split(module, r"\."), lambda s: (s == "tests") | F.startswith(s, F.lit("test_")))


def collapse_whitespace(text: Column) -> Column:
    """Trailing blanks of lines dropped, three and more newlines become two; only white space becomes one newline."""
    t = F.regexp_replace(F.regexp_replace(text, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n")
    return F.when(text == "", text).when(F.regexp_replace(t, r"\s", "") == "", "\n").otherwise(t)


def strip_comments(text: Column) -> Column:
    """HTML comments dropped, with the newline after one that begins a line; blank runs become one blank line."""
    t = F.regexp_replace(text, r"(?s)(^|(?<=\n))<!--.*?-->\n?", "")
    return F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", ""), r"\n{3,}", "\n\n")


def compact_table_line(line: Column) -> Column:
    """Cells of a pipe-table line trimmed; runs of three and more pipes become two."""
    cells = F.transform(F.split(line, r"\|"), lambda c: F.trim(c))
    return F.when(line.rlike(r"^\|.*\|$") & (F.char_length(line) > 1), F.regexp_replace(F.array_join(cells, "|"), r"\|{3,}", "||")).otherwise(line)


def strip_key_quotes(text: Column) -> Column:
    return F.regexp_replace(text, r'"([a-zA-Z_][\w.]*)"(?=\s*:)', "$1")


def headings(text: Column) -> Column:
    """Array of (level, text) of markdown headings of levels 1 to 3."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^#{1,3}\s+\S"))
    return F.transform(lines, lambda x: F.struct(F.char_length(F.regexp_extract(x, "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(x, r"^#+\s+", "")).alias("text")))


def strip_tags(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags dropped, white space put together."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]*>", " "), r"\s+", " "))
