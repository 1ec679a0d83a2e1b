"""Format detection: what the lines of a text show is gathered once, then formats are tried from the strictest to the loosest."""

from __future__ import annotations

import csv
import json
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: formats in the order in which they are tried, and what is none of them
FORMATS = ["json", "xml", "yaml", "markdown", "toml", "csv", "text"]
# fixed values: root tags that mean a page and not XML
PAGE_TAGS = {
    "a", "abbr", "article", "aside", "b", "blockquote", "body", "br", "button", "code", "col", "dd", "details", "div", "dl", "dt", "em", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "i", "iframe", "img", "input", "label", "li", "link", "main", "meta", "nav", "ol", "option", "p", "pre", "script", "section",
    "select", "small", "span", "strong", "style", "sub", "summary", "sup", "table", "tbody", "td", "textarea", "tfoot", "th", "thead", "title", "tr", "u", "ul", "video",
}
# fixed values: points for signs of Markdown, and how many make it Markdown
TABLE_POINTS, FENCE_POINTS, LINK_POINTS, HEADING_POINTS, ENOUGH = 2, 1, 1, 2, 2
DELIMITERS = ",;\t|"


def _wordy(c: str) -> bool:
    return c.isalnum() or c == "_"


@dataclass
class Lines:
    """Signs of formats, counted line by line."""

    mappings: int = 0  # `key: value`, a list item, or a document mark
    depths: set[int] = field(default_factory=set)  # of headings led by hashes
    boxed: int = 0  # lines between two bars
    ruled: int = 0  # of those, lines of dashes, colons and blanks
    fences: int = 0
    links: int = 0

    def add(self, line: str) -> None:
        body = line.strip()
        if not body:
            return
        first = line[0]
        if first == "#":
            depth = len(line) - len(line.lstrip("#"))
            if depth <= 6 and line[depth : depth + 1].isspace():
                self.depths.add(depth)
        elif first == "|":
            if len(body) > 1 and line.endswith("|"):
                self.boxed += 1
                self.ruled += not body.strip("|:- \t") and body.strip("|") != ""
        elif first == "`":
            self.fences += line.startswith("```") and all(map(_wordy, line[3:]))
        elif _wordy(first):
            key, colon, _ = line.partition(":")
            self.mappings += bool(colon) and all(_wordy(c) or c.isspace() for c in key)
        if body[0] == "-":
            self.mappings += line.startswith("---") or body[1:2].isspace() and bool(body[1:].strip())
        if not self.links:
            at = line.find("](")
            self.links += at > 1 and "[" in line[: at - 1] and line.find(")", at + 3) > 0

    def markdown(self) -> int:
        table = self.boxed and self.ruled
        return min(len(self.depths), HEADING_POINTS) + TABLE_POINTS * bool(table) + FENCE_POINTS * (self.fences > 1) + LINK_POINTS * bool(self.links)


def _quietly(read: Callable[[str], object], text: str, *errors: type[Exception]) -> object:
    """What a parser makes of a text; None if it fails, or if the text is nested too deep for it."""
    try:
        return read(text)
    except (*errors, RecursionError):
        return None


def _json(text: str, _: Lines) -> bool:
    return text[0] in "[{" and _quietly(json.loads, text, ValueError) is not None


def _xml(text: str, _: Lines) -> bool:
    if text[0] != "<" or ">" not in text:
        return text.startswith("<?xml")
    stop = 1
    while stop < len(text) and _wordy(text[stop]):
        stop += 1
    root = text[1:stop].lower()
    return text.startswith("<?xml") or bool(root) and root not in PAGE_TAGS and (text[stop] == ">" or text[stop].isspace())


def load_yaml(text: str) -> object:
    """A mapping or list, or None; without the parser nothing is taken for YAML."""
    try:
        import yaml
    except ImportError:
        return None
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    data = _quietly(lambda t: yaml.load(t, Loader=loader), text, yaml.YAMLError, ValueError)  # noqa: S506
    return data if isinstance(data, (dict, list)) else None


def _yaml(text: str, lines: Lines) -> bool:
    return lines.mappings > 0 and load_yaml(text) is not None


def _markdown(_: str, lines: Lines) -> bool:
    return lines.markdown() >= ENOUGH


def _toml(text: str, _: Lines) -> bool:
    return "=" in text and bool(_quietly(tomllib.loads, text, tomllib.TOMLDecodeError))


def _widths(rows: list[str], mark: str) -> set[int]:
    """How many cells the lines have. Quotes hold a cell together only if all that open a cell close it too; else they are plain characters."""
    found = _quietly(lambda t: {len(r) for r in csv.reader(t, delimiter=mark, strict=True) if r}, rows, csv.Error)
    return {x.count(mark) + 1 for x in rows} if found is None else found


def _csv(text: str, _: Lines) -> bool:
    """A grid: with one of the delimiters every line has as many cells, two at least."""
    rows = [x for x in text.split("\n") if x.strip()]
    if len(rows) < 2:
        return False
    for mark in DELIMITERS:
        if mark in rows[0]:
            widths = _widths(rows, mark)
            if len(widths) == 1 and widths.pop() > 1:
                return True
    return False


PROBES = dict(zip(FORMATS, (_json, _xml, _yaml, _markdown, _toml, _csv), strict=False))


def detect(text: str | None) -> str:
    text = (text or "").strip()
    if not text:
        return FORMATS[-1]
    lines = Lines()
    for line in text.split("\n"):
        lines.add(line)
    for name, holds in PROBES.items():
        if holds(text, lines):
            return name
    return FORMATS[-1]


def suspicious(text: Column) -> Column:
    """Whether a text can be anything but prose: brackets, bars, hashes, dashes or backticks that lead a line, keys, links, or two lines with a delimiter."""
    return F.coalesce(text.rlike(r"(?m)^\s*[{\[<\-#|`]|^\w[\w\s]*:|=|\]\(|[,;\t|].*\n"), F.lit(False))


def detect_format(text: Column) -> Column:
    """The probes need parsers, so this is an Arrow UDF; texts that can only be plain prose are settled before it."""

    @F.pandas_udf("string")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(detect)

    return F.when(suspicious(text), udf(text)).otherwise(FORMATS[-1])
