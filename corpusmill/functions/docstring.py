"""Docstrings of the Google, NumPy and Sphinx styles: summary, raised errors, examples."""

from __future__ import annotations

import inspect
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SECTION = re.compile(r"^(args|arguments|parameters|returns?|yields?|raises|examples?|notes?|attributes|see also|warnings?|references)\s*:?\s*$", re.I)
SCHEMA = "struct<summary:string,raises:array<struct<name:string,text:string>>,examples:array<string>>"


def _sections(lines: list[str]) -> dict[str, list[str]]:
    """Lines of each named section; a NumPy heading's underline is dropped."""
    out: dict[str, list[str]] = {"": []}
    name = ""
    for i, line in enumerate(lines):
        m = SECTION.match(line)
        ruled = i + 1 < len(lines) and re.fullmatch(r"-{3,}", lines[i + 1].strip())
        if m and (line.rstrip().endswith(":") or ruled):
            name = m[1].lower()
            out.setdefault(name, [])
        elif not (re.fullmatch(r"-{3,}", line.strip()) and name and not out[name]):
            out[name].append(line)
    return out


def _entries(lines: list[str]) -> list[tuple[str, str]]:
    """`Name: text` with deeper lines that go on (Google), or `Name` alone with its text indented below (NumPy)."""
    body = inspect.cleandoc("\n" + "\n".join(lines)).split("\n") if lines else []
    out: list[list[str]] = []
    for line in body:
        if not line.strip():
            continue
        if line[0].isspace() and out:
            out[-1][1] = f"{out[-1][1]} {line.strip()}".strip()
        else:
            name, _, text = line.partition(":")
            out.append([name.strip(), text.strip()])
    return [(n, t) for n, t in out]


def parse(raw: str | None) -> tuple[str | None, list[tuple[str, str]], list[str]]:
    if not raw or not raw.strip():
        return None, [], []
    text = inspect.cleandoc(raw.expandtabs())
    lines = text.split("\n")
    summary = []
    for line in lines:
        if not line.strip() or SECTION.match(line) or line.startswith(":"):
            break
        summary.append(line.strip())
    sphinx = re.findall(r"^:raises?\s+([\w.]+)\s*:\s*(.*(?:\n[ \t]+.*)*)", text, re.M)
    if sphinx or re.search(r"^:(param|returns?|type|rtype)\b", text, re.M):
        return " ".join(summary) or None, [(n, " ".join(t.split())) for n, t in sphinx], []
    own = _sections(lines)
    shown = [inspect.cleandoc("\n" + "\n".join(own[k])).strip() for k in ("example", "examples") if k in own]
    return " ".join(summary) or None, _entries(own.get("raises", [])), [x for x in shown if x]


def parse_docstring(text: Column) -> Column:
    @F.pandas_udf(SCHEMA)
    def udf(s: pd.Series) -> pd.DataFrame:
        rows = [(a, [{"name": n, "text": t} for n, t in r], e) for a, r, e in map(parse, s)]
        return pd.DataFrame(rows, columns=["summary", "raises", "examples"])

    return udf(text)
