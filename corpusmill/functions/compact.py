"""Text and JSON compaction: ten rewrites, presets, and a pipeline that keeps a rewrite only where it helps.

A rewrite takes a Document and returns one; the pipeline runs them over a column in one Arrow UDF. Sizes are
counted by `count_tokens`, an approximate counter named as such: the exact vocabulary is not at hand.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.detect import detect, load_yaml

MISSING = object()
CDATA, XML_TOKEN = "<![CDATA[", re.compile(r"(<!\[CDATA\[.*?\]\]>|<[^>]*>)", re.S)
SHORTEST, PIECE = 20, re.compile(r"\w{1,6}|[^\w\s]|\s+")
STRUCTURED = {"json", "yaml", "xml", "toml", "csv"}


@dataclass(frozen=True)
class Document:
    text: str
    format: str
    data: object = MISSING  # parsed JSON, where there is any


def load(text: str | None) -> Document:
    text = text or ""
    kind = detect(text)
    return Document(text, kind, json.loads(text) if kind == "json" else MISSING)


def count_tokens(text: str) -> int:
    """Approximate tokens: a word counts one for each six letters begun, a mark or a run of blanks one."""
    return len(PIECE.findall(text))


def _dump(data: object) -> str:
    return json.dumps(data, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _on_data(change: Callable[[object], object]) -> Callable[[Document], Document]:
    def apply(d: Document) -> Document:
        if d.data is MISSING:
            return d
        data = change(d.data)
        if data is d.data:
            return d
        return replace(d, text=_dump(data), data=data)

    return apply


def _tight_xml(text: str) -> str:
    """Blanks between tags and around texts dropped; what stands beside a CDATA section keeps its own."""
    out: list[str] = []
    tokens = [t for t in XML_TOKEN.split(text.strip()) if t]
    tag = [t[0] == "<" and t[-1] == ">" and not t.startswith(CDATA) for t in tokens]
    for i, token in enumerate(tokens):
        if token[0] == "<" and (tag[i] or token.startswith(CDATA)):
            out.append(token)
            continue
        after, before = i > 0 and tag[i - 1], i + 1 < len(tokens) and tag[i + 1]
        if after and before and token.isspace():
            continue
        token = token.lstrip(" \t") if after else token
        out.append(token.rstrip(" \t") if before else token)
    return "".join(out)


def _flow_yaml(text: str) -> str | None:
    """YAML on one line; comments would be lost, so a text with one stays."""
    data = None if any(x.lstrip().startswith("#") for x in text.split("\n")) else load_yaml(text)
    if data is None:
        return None
    import yaml

    return yaml.safe_dump(data, default_flow_style=True, sort_keys=False, width=10**9, allow_unicode=False).strip()


def minify(d: Document) -> Document:
    if d.format == "json" and d.data is not MISSING:
        tight = _dump(d.data)
    elif d.format == "xml":
        tight = _tight_xml(d.text)
    elif d.format == "yaml":
        tight = _flow_yaml(d.text)
    else:
        tight = None
    return d if tight is None else replace(d, text=tight)


def _empty(x: object) -> bool:
    return x is None or (isinstance(x, (str, list, dict)) and not x)


def without_empty(x: object) -> object:
    """Null, empty texts, lists and objects dropped from the leaves up; false and 0 stay."""
    if isinstance(x, dict):
        return {k: v for k, v in ((k, without_empty(v)) for k, v in x.items()) if not _empty(v)}
    if isinstance(x, list):
        return [v for v in map(without_empty, x) if not _empty(v)]
    return x


def flattened(x: object, most: int | None = None, depth: int = 0) -> object:
    """Objects that hold one key alone are folded into a dotted key, at most `most` times on the way down; later keys win."""
    if isinstance(x, list):
        return [flattened(v, most, depth) for v in x]
    if not isinstance(x, dict):
        return x
    out: dict[str, object] = {}
    for key, value in x.items():
        own = depth
        while isinstance(value, dict) and len(value) == 1 and (most is None or own < most):
            (inner, value), own = next(iter(value.items())), own + 1
            key = f"{key}.{inner}"
        out[key] = flattened(value, most, own)
    return out


def rounded(x: object, digits: int = 2) -> object:
    if isinstance(x, dict):
        return {k: rounded(v, digits) for k, v in x.items()}
    if isinstance(x, list):
        return [rounded(v, digits) for v in x]
    return round(x, digits) if isinstance(x, float) else x


def _cell(x: object) -> str:
    if x is None or isinstance(x, bool):
        return json.dumps(x)
    if isinstance(x, (dict, list)):
        return json.dumps(x, separators=(",", ": "), ensure_ascii=False).replace("|", "\\u007c")
    return json.dumps(str(x)) if "|" in str(x) else str(x)


def as_table(rows: object) -> str | None:
    """A list of objects as a header and pipe-separated rows, keys in order of first sight; anything else: None."""
    if not isinstance(rows, list) or not rows or not all(isinstance(r, dict) for r in rows):
        return None
    keys = list(dict.fromkeys(k for r in rows for k in r))
    return "\n".join(["|".join(keys), *("|".join(_cell(r[k]) if k in r else "" for k in keys) for r in rows)])


def tabular(d: Document) -> Document:
    def inner(x: object) -> object:
        if isinstance(x, dict):
            return {k: inner(v) for k, v in x.items()}
        return (as_table(x) or x) if isinstance(x, list) else x

    if d.data is MISSING:
        return d
    if isinstance(d.data, list):
        table = as_table(d.data)
        return d if table is None else Document(table, d.format)
    data = inner(d.data)
    return d if data == d.data else Document(json.dumps(data, separators=(",", ":"), ensure_ascii=False), d.format)


def strip_quotes(d: Document) -> Document:
    return replace(d, text=re.sub(r'"([a-zA-Z_][\w.]*)"(?=\s*:)', r"\1", d.text, flags=re.A), data=MISSING) if d.format == "json" else d


def deduplicated(x: object) -> object:
    """Long texts that stand more than once become aliases, the heaviest first; a `_refs` table beside `_data` holds them."""
    seen: Counter[str] = Counter()
    every: set[str] = set()

    def count(v: object) -> None:
        if isinstance(v, str):
            every.add(v)
            seen[v] += len(v) >= SHORTEST
        for w in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
            count(w)

    count(x)
    worth = sorted((s for s, n in seen.items() if n > 1), key=lambda s: -len(s) * seen[s])
    if not worth or isinstance(x, dict) and ("_refs" in x or "_data" in x):
        return x
    lead = "$R"
    while any(s.startswith(lead) for s in every):
        lead = "$" + lead
    alias = {s: f"{lead}{i}" for i, s in enumerate(worth)}

    def swap(v: object) -> object:
        if isinstance(v, dict):
            return {k: swap(w) for k, w in v.items()}
        if isinstance(v, list):
            return [swap(w) for w in v]
        return alias.get(v, v) if isinstance(v, str) else v

    return {"_refs": {a: s for s, a in alias.items()}, "_data": swap(x)}


def _fenced(lines: list[str], unclosed: bool = False) -> list[bool]:
    """Of each line, whether it belongs to a fenced block; a fence ends with a line led by as many backticks. One never closed is none, or reaches to the end."""
    out = [False] * len(lines)
    opened, ticks = -1, 0
    for i, line in enumerate(lines):
        body = line.lstrip()
        n = len(body) - len(body.lstrip("`"))
        if opened < 0:
            if n >= 3 and "`" * n not in body[n:]:
                opened, ticks = i, n
        elif n >= ticks:
            out[opened : i + 1] = [True] * (i + 1 - opened)
            opened = -1
    if unclosed and opened >= 0:
        out[opened:] = [True] * (len(lines) - opened)
    return out


def _squeeze(lines: list[str], fenced: list[bool]) -> list[str]:
    """No more than one blank line between lines, two breaks at either end, and none beside a fence."""
    full = [i for i, (x, f) in enumerate(zip(lines, fenced, strict=True)) if x or f]
    if not full:
        return lines[:3]
    out = [""] * min(full[0], 2)
    for here, following in zip(full, [*full[1:], None], strict=True):
        out.append(lines[here])
        if following is None:
            out += [""] * min(len(lines) - 1 - here, 2)
        elif following - here > 1 and not (fenced[here] or fenced[following]):
            out.append("")
    return out


def collapse_whitespace(d: Document) -> Document:
    if d.format in STRUCTURED or not d.text:
        return d
    if not d.text.strip():
        return replace(d, text="\n" if "\n" in d.text else "")
    lines = d.text.split("\n")
    fenced = _fenced(lines)
    lines = [x if f else x.rstrip(" \t") for x, f in zip(lines, fenced, strict=True)]
    return replace(d, text="\n".join(_squeeze(lines, fenced)))


def compact_tables(d: Document) -> Document:
    """Cells of a table's rows trimmed; empty cells in a row run into one, so columns may be lost."""
    if d.format != "markdown" or "|" not in d.text:
        return d
    lines = d.text.split("\n")
    for i, inside in enumerate(_fenced(lines, unclosed=True)):
        row = lines[i]
        if inside or len(row) < 2 or not (row.startswith("|") and row.endswith("|")):
            continue
        cells = [c.strip() for c in row[1:-1].split("|")]
        kept = [c for c, before in zip(cells, [True, *map(bool, cells)], strict=False) if c or before]
        lead = "||" if len(cells) > 1 and not cells[0] and not cells[1] else "|"
        if lead == "||" or len(kept) == len(cells):
            text = "|" + "|".join(cells) + "|"
            while "|||" in text:
                text = text.replace("|||", "||")
        else:
            text = "|" + "|".join(kept) + "|"
        lines[i] = text
    return replace(d, text="\n".join(lines))


def strip_comments(d: Document) -> Document:
    if d.format not in ("markdown", "text") or "<!--" not in d.text:
        return d
    lines = d.text.split("\n")
    fenced = _fenced(lines)
    out: list[str] = []
    start = 0
    for stop in range(1, len(lines) + 1):
        if stop < len(lines) and fenced[stop] == fenced[start]:
            continue
        block = "\n".join(lines[start:stop])
        out.append(block if fenced[start] else _uncommented(block + "\n" * (stop < len(lines))))
        if fenced[start] and stop < len(lines):
            out.append("\n")
        start = stop
    return replace(d, text="".join(out))


def _uncommented(text: str) -> str:
    """Comments cut out, one that leads its line with the line's break; where three breaks or more meet, two stay."""
    kept, at = [], 0
    while (start := text.find("<!--", at)) >= 0 and (stop := text.find("-->", start + 4)) >= 0:
        kept.append(text[at:start])
        at = stop + 3
        if (start == 0 or text[start - 1] == "\n") and text[at : at + 1] == "\n":
            at += 1
    text = "".join(kept) + text[at:]
    while "\n\n\n" in text:
        text = text.replace("\n\n\n", "\n\n")
    return text


STRATEGIES: dict[str, Callable[[Document], Document]] = {
    "minify": minify,
    "drop_nulls": _on_data(without_empty),
    "flatten": _on_data(flattened),
    "tabular": tabular,
    "round_numbers": _on_data(rounded),
    "strip_quotes": strip_quotes,
    "dedup_values_with_refs": _on_data(deduplicated),
    "collapse_whitespace": collapse_whitespace,
    "compact_tables": compact_tables,
    "strip_html_comments": strip_comments,
}
# fixed values: which rewrites a preset runs, in order
PRESETS = {
    "safe": ["minify", "collapse_whitespace"],
    "moderate": ["minify", "drop_nulls", "flatten", "dedup_values_with_refs", "tabular", "strip_quotes", "collapse_whitespace", "compact_tables", "strip_html_comments"],
    "aggressive": ["minify", "drop_nulls", "flatten", "tabular", "round_numbers", "dedup_values_with_refs", "strip_quotes", "collapse_whitespace", "compact_tables", "strip_html_comments"],
}


def attempt(name: str, d: Document) -> Document:
    try:
        return STRATEGIES[name](d)
    except RecursionError:  # too deep for the walkers: unchanged
        return d


def chain(d: Document, names: list[str]) -> tuple[Document, list[str]]:
    """Rewrites in order; one is kept if it has fewer tokens, or as many and fewer characters."""
    applied, size = [], None
    for name in names:
        new = attempt(name, d)
        if new.text == d.text:
            continue
        size = count_tokens(d.text) if size is None else size
        n = count_tokens(new.text)
        if (n, len(new.text)) < (size, len(d.text)):
            applied.append(name)
            d, size = new, n
    return d, applied


def _saved(before: int, after: int) -> float:
    return (1 - after / before) * 100 if before else 0.0


REPORT = "struct<format:string,compacted:string,applied:array<string>,original_tokens:int,compacted_tokens:int,savings:double>"


def compact(text: Column, preset: str = "safe", strategies: list[str] | None = None) -> Column:
    names = strategies or PRESETS[preset]

    @F.pandas_udf(REPORT)
    def udf(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            d = load(t)
            out, applied = chain(d, names)
            a = count_tokens(d.text)
            b = count_tokens(out.text) if applied else a
            rows.append((d.format, out.text, applied, a, b, _saved(a, b)))
        return pd.DataFrame(rows, columns=["format", "compacted", "applied", "original_tokens", "compacted_tokens", "savings"])

    return udf(text)


def compact_check(text: Column) -> Column:
    """Saving of each rewrite alone (they do not add up), and of the safe preset as a chain; the text is unchanged."""

    @F.pandas_udf("struct<format:string,tokens:int,estimates:map<string,double>,savings:double>")
    def udf(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            d = load(t)
            n = count_tokens(d.text)
            tried = {k: attempt(k, d).text for k in STRATEGIES}
            alone = {k: round(_saved(n, count_tokens(t)), 2) for k, t in tried.items() if t != d.text}
            rows.append((d.format, n, {k: v for k, v in alone.items() if v > 0}, _saved(n, count_tokens(chain(d, PRESETS["safe"])[0].text))))
        return pd.DataFrame(rows, columns=["format", "tokens", "estimates", "savings"])

    return udf(text)


def rewrite(text: Column, name: str) -> Column:
    """One rewrite of each text, whatever its size afterwards."""

    @F.pandas_udf("string")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(lambda t: attempt(name, load(t)).text)

    return udf(text)


def tokens(text: Column) -> Column:
    """The approximate count as a built-in: letters, digits and underscores by sixes, other marks and runs of blanks one each."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]{1,6}|[^\p{L}\p{N}_ \t\n\r\f]|[ \t\n\r\f]+")), F.lit(0))


def _worth(c: Column, kind: T.DataType) -> Column:
    """A typed value, null where it is empty from the leaves up; false and 0 stay."""
    if isinstance(kind, T.StructType):
        kept = [_worth(c[f.name], f.dataType).alias(f.name) for f in kind]
        some = reduce(lambda a, b: a | b, [k.isNotNull() for k in kept])
        return F.when(some, F.struct(*kept))
    if isinstance(kind, T.ArrayType):
        return F.nullif(F.filter(F.transform(c, lambda x: _worth(x, kind.elementType)), lambda x: x.isNotNull()), F.array().cast(kind))
    return F.nullif(c, F.lit("")) if isinstance(kind, T.StringType) else c


def drop_nulls(text: Column, schema: T.StructType) -> Column:
    """JSON objects of a known schema without null and empty values, by built-ins alone; fields come in the schema's order."""
    once = F.transform(F.array(F.from_json(text, schema)), lambda x: F.to_json(_worth(x, schema)))  # a bound value is parsed once
    return F.coalesce(F.element_at(once, 1), F.lit("{}"))
