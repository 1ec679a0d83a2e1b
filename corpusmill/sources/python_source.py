"""Python source files as fact tables: modules, functions, classes, variables, imports, calls, references, definitions.

Files are listed on the driver, read whole by the executors and parsed with the standard library in mapInPandas, one row a file; the views below
are projections of that nested row. A file that does not parse gives a row with an error and no facts.
"""

from __future__ import annotations

import ast
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import module_name

SKIPPED_SEGMENTS = [".git", ".tox", ".venv", "venv", "__pycache__", "node_modules", "site-packages", "build", "dist"]
_PARAM = "struct<name:string,annotation:string,default:string>"
_FUNCTION = f"struct<class_name:string,name:string,kind:string,params:array<{_PARAM}>,return_type:string,docstring:string,decorators:array<string>,line_start:int,line_end:int,is_async:boolean,signature:string,body:string>"
SCHEMA = (
    "path string, module string, error string, docstring string, all_exports array<string>, main_guard_line int,"
    f"functions array<{_FUNCTION}>,"
    "classes array<struct<name:string,bases:array<string>,decorators:array<string>,docstring:string,line_start:int,line_end:int>>,"
    "variables array<struct<name:string,annotation:string,value_repr:string,line:int>>,"
    "imports array<struct<target:string,names:array<string>,alias:string,is_relative:boolean,level:int,line:int>>,"
    "calls array<struct<symbol:string,line:int,`column`:int,pos:long,context:string,call_expression:string,confidence:double>>,"
    "definitions array<struct<name:string,kind:string,start:long,end:long,line:int>>,"
    "refs array<string>"
)
COLUMNS = ["path", "module", "error", "docstring", "all_exports", "main_guard_line", "functions", "classes", "variables", "imports", "calls", "definitions", "refs"]
KINDS = {"property": "property", "staticmethod": "staticmethod", "classmethod": "classmethod", "abstractmethod": "abstract"}


def _text(node: ast.AST | None) -> str | None:
    return None if node is None else ast.unparse(node)


def _leaf(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return node.attr
    return None


def _params(a: ast.arguments) -> list[dict]:
    plain = [*a.posonlyargs, *a.args]
    defaults: list = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    out = [(p.arg, p.annotation, d) for p, d in zip(plain, defaults, strict=True)]
    if a.vararg:
        out.append(("*" + a.vararg.arg, a.vararg.annotation, None))
    out += [(p.arg, p.annotation, d) for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
    if a.kwarg:
        out.append(("**" + a.kwarg.arg, a.kwarg.annotation, None))
    return [{"name": n, "annotation": _text(t), "default": _text(d)} for n, t, d in out]


def _function(f: ast.FunctionDef | ast.AsyncFunctionDef, owner: str | None) -> dict:
    decorators = [ast.unparse(d) for d in f.decorator_list]
    kind = next((KINDS[d.split(".")[-1]] for d in decorators if d.split(".")[-1] in KINDS), "method" if owner else "function")
    params = _params(f.args)
    shown = [p["name"] + (f": {p['annotation']}" if p["annotation"] else "") + (f" = {p['default']}" if p["default"] else "") for p in params]
    ret = _text(f.returns)
    is_async = isinstance(f, ast.AsyncFunctionDef)
    signature = ("async " if is_async else "") + f"def {f.name}({', '.join(shown)})" + (f" -> {ret}" if ret else "")
    doc = ast.get_docstring(f)
    body = f.body[1:] if doc is not None else f.body
    return {"class_name": owner, "name": f.name, "kind": kind, "params": params, "return_type": ret, "docstring": doc, "decorators": decorators, "line_start": f.lineno, "line_end": f.end_lineno, "is_async": is_async, "signature": signature, "body": "\n".join(map(ast.unparse, body))}


class _Walk(ast.NodeVisitor):
    """Calls, definitions and non-call uses of names, in source order."""

    def __init__(self, source: str):
        self.starts = [0]
        for line in source.splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line.encode()))
        self.calls: list[dict] = []
        self.definitions: list[dict] = []
        self.refs: set[str] = set()
        self.context: list[str] = []

    def at(self, line: int, column: int) -> int:
        return self.starts[line - 1] + column

    def _definition(self, node, kind: str) -> None:
        self.definitions.append({"name": node.name, "kind": kind, "start": self.at(node.lineno, node.col_offset), "end": self.at(node.end_lineno, node.end_col_offset), "line": node.lineno})
        self.context.append(node.name)
        self.generic_visit(node)
        self.context.pop()

    def visit_FunctionDef(self, node):
        for d in [*node.args.defaults, *node.args.kw_defaults]:
            self._use(d)
        self._definition(node, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        self._definition(node, "class")

    def _use(self, node) -> None:
        if isinstance(node, (ast.Name, ast.Attribute)) and (name := _leaf(node)):
            self.refs.add(name)
        elif isinstance(node, ast.Constant) and isinstance(node.value, str) and node.value.isidentifier():
            self.refs.add(node.value)

    def visit_Call(self, node):
        name = _leaf(node.func)
        if name:
            self.calls.append({"symbol": name, "line": node.lineno, "column": node.col_offset, "pos": self.at(node.lineno, node.col_offset), "context": self.context[-1] if self.context else None, "call_expression": ast.unparse(node)[:80], "confidence": 1.0 if isinstance(node.func, ast.Name) else 0.5})
        for x in [*node.args, *(k.value for k in node.keywords)]:
            self._use(x)
        self.generic_visit(node)

    def visit_Return(self, node):
        self._use(node.value)
        self.generic_visit(node)

    def _items(self, node):
        for x in [*getattr(node, "elts", []), *getattr(node, "values", [])]:
            self._use(x)
        self.generic_visit(node)

    visit_List = visit_Tuple = visit_Set = visit_Dict = _items


def parse(path: str, source: str, module: str) -> dict:
    empty = {"path": path, "module": module, "error": None, "docstring": None, "all_exports": None, "main_guard_line": None} | {k: [] for k in ("functions", "classes", "variables", "imports", "calls", "definitions", "refs")}
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        return empty | {"error": type(e).__name__}
    out = empty | {"docstring": ast.get_docstring(tree)}
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out["functions"].append(_function(node, None))
        elif isinstance(node, ast.ClassDef):
            out["classes"].append({"name": node.name, "bases": [ast.unparse(b) for b in node.bases], "decorators": [ast.unparse(d) for d in node.decorator_list], "docstring": ast.get_docstring(node), "line_start": node.lineno, "line_end": node.end_lineno})
            out["functions"] += [_function(m, node.name) for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
        elif isinstance(node, ast.Import):
            out["imports"] += [{"target": a.name, "names": [a.name], "alias": a.asname, "is_relative": False, "level": 0, "line": node.lineno} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out["imports"].append({"target": node.module, "names": [a.name for a in node.names], "alias": node.names[0].asname, "is_relative": node.level > 0, "level": node.level, "line": node.lineno})
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            for t in targets:
                if not isinstance(t, ast.Name):
                    continue
                if t.id == "__all__" and isinstance(node.value, (ast.List, ast.Tuple)):
                    out["all_exports"] = [x.value for x in node.value.elts if isinstance(x, ast.Constant)]
                elif t.id != "__all__":
                    out["variables"].append({"name": t.id, "annotation": _text(getattr(node, "annotation", None)), "value_repr": _text(node.value), "line": node.lineno})
        elif isinstance(node, ast.If) and ast.unparse(node.test).replace('"', "'") == "__name__ == '__main__'":
            out["main_guard_line"] = node.lineno
    walk = _Walk(source)
    walk.visit(tree)
    return out | {"calls": walk.calls, "definitions": walk.definitions, "refs": sorted(walk.refs)}


def _tree(root: str, suffix: str) -> list[tuple[str, object]]:
    """(path, file info) below root, in order, without environment and cache folders.

    Spark's own listing leaves out names that begin with an underscore, and with them every __init__.py.
    """
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(root)}")
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    paths = ((i.path[len(base) :].strip("/"), i) for i in found if i.type == fs.FileType.File and i.path.endswith(suffix))
    return sorted(((p, i) for p, i in paths if not set(p.split("/")) & set(SKIPPED_SEGMENTS)), key=lambda x: x[0])


def read_files(spark: SparkSession, root: str, suffix: str = ".py", files_a_task: int = 256) -> DataFrame:
    """(path, text) of the source files below root, a local or remote folder that every executor can open."""
    from pyarrow import fs

    paths = [(p,) for p, _ in _tree(root, suffix)]

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(root)}")
        for b in batches:
            rows = []
            for p in b["path"]:
                with system.open_input_stream(f"{base}/{p}") as f:
                    rows.append((p, f.read().decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["path", "text"])

    listed = spark.createDataFrame(paths, "path string").repartition(max(1, -(-len(paths) // files_a_task)))
    return listed.mapInPandas(load, "path string, text string")


def is_source(path: Column, skipped: list[str] = SKIPPED_SEGMENTS, suffix: str = ".py") -> Column:
    """Whether a path is a source file outside the skipped folders."""
    return F.endswith(path, F.lit(suffix)) & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, skipped)))


def tree_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two fingerprints (path, modified): added, removed or modified."""
    both = before.select("path", F.col("modified").alias("old")).join(after.select("path", F.col("modified").alias("new")), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def fingerprint(spark: SparkSession, root: str, suffix: str = ".py") -> DataFrame:
    """(path, modified) of every source file: equal tables mean that nothing changed."""
    return spark.createDataFrame([(p, i.mtime_ns) for p, i in _tree(root, suffix)], "path string, modified long")


def parse_modules(files: DataFrame) -> DataFrame:
    """One nested row a file from (path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([parse(p, t or "", m) for p, t, m in zip(b["path"], b["text"], b["module"], strict=True)], columns=COLUMNS)

    return files.withColumn("module", module_name(F.col("path"))).mapInPandas(run, SCHEMA)


def views(modules: DataFrame) -> dict[str, DataFrame]:
    """The exploded fact tables of parsed modules."""
    out = {"modules": modules.select("path", "module", "error", "docstring", "all_exports", "main_guard_line")}
    for name in ("functions", "classes", "variables", "imports", "calls", "definitions"):
        out[name] = modules.select("path", "module", F.explode(name).alias("x")).select("path", "module", "x.*")
    out["refs"] = modules.select("path", "module", F.explode("refs").alias("name"))
    return out
