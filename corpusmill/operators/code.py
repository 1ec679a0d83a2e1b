"""Queries over the fact tables of a code corpus: search, callers and callees, exports, liveness, diffs, docs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Views = dict[str, DataFrame]
# fixed values: decorator prefixes that make a function an entry point, by framework
ENTRY_DECORATORS = {
    "cyclopts": ["app.default", "app.command"],
    "click": ["click.command", "click.group", "app.command"],
    "flask": ["app.route", "blueprint.route"],
    "fastapi": ["app.get", "app.post", "app.put", "app.delete", "app.patch", "router.get", "router.post", "router.put", "router.delete", "router.patch"],
}
PROTOCOLS = ["Protocol", "typing.Protocol"]
RESULT = ["module", "class_name", "name", "symbol_kind", "line"]


def _functions(v: Views) -> DataFrame:
    return v["functions"].withColumns({"symbol_kind": F.col("kind"), "line": F.col("line_start")})


def _classes(v: Views) -> DataFrame:
    return v["classes"].withColumns({"class_name": F.lit(None).cast("string"), "symbol_kind": F.lit("class"), "line": F.col("line_start")})


def _variables(v: Views) -> DataFrame:
    return v["variables"].withColumns({"class_name": F.lit(None).cast("string"), "symbol_kind": F.lit("variable")})


def _has(column: Column, part: str | None) -> Column:
    return F.lit(True) if part is None else F.contains(column, F.lit(part))


def search(v: Views, name: str | None = None, returns: str | None = None, kind: str | None = None, inherits: str | None = None) -> DataFrame:
    """(module, class_name, name, symbol_kind, line) of the symbols that match every filter given.

    Names and return types match by substring, bases exactly. A base asks for classes only and ignores the
    return type. Without a kind: a class whose name matches is returned in place of its methods (unless a return
    type is asked for, when all its methods are tried by that alone); without a name no class is returned.
    """
    named = _has(F.col("name"), name)
    returning = F.lit(True) if returns is None else F.coalesce(F.contains("return_type", F.lit(returns)), F.lit(False))
    if inherits is not None:
        found = _classes(v).where(F.array_contains("bases", inherits) & named)
        return found.where(F.lit(kind in (None, "class"))).select(*RESULT)
    if kind == "variable":
        return _variables(v).where(named & F.lit(returns is None)).select(*RESULT)
    if kind == "class":
        return _classes(v).where(named & F.lit(returns is None)).select(*RESULT)
    f = _functions(v)
    if kind is not None:
        return f.where(named & returning & (F.col("kind") == kind)).select(*RESULT)
    owner_named = F.lit(False) if name is None else F.coalesce(F.contains("class_name", F.lit(name)), F.lit(False))
    taken = owner_named & F.lit(returns is None)
    out = f.where(returning & ~taken & (named | owner_named)).select(*RESULT)
    if name is not None and returns is None:
        out = out.unionByName(_classes(v).where(named).select(*RESULT))
    if returns is None:
        out = out.unionByName(_variables(v).where(named).select(*RESULT))
    return out


def filter_modules(modules: DataFrame, parts: list[str]) -> DataFrame:
    """Modules whose name has one of the parts, ignoring case."""
    if not parts:
        return modules
    return modules.where(F.lower("module").rlike("|".join("\\Q" + p.lower() + "\\E" for p in parts)))


def describe(v: Views, detail: str = "summary") -> DataFrame:
    """Module listing: toc (counts), summary (public signatures), detailed (with docstrings and parameters)."""
    f = v["functions"].join(v["modules"].select("module", "all_exports"), "module")
    shown = public(F.col("name"), F.col("all_exports"))
    if detail == "toc":
        f_n = v["functions"].where("class_name is null").groupBy("module").agg(F.count("*").alias("functions"))
        c_n = v["classes"].groupBy("module").agg(F.count("*").alias("classes"))
        zero = F.lit(0)
        return v["modules"].join(f_n, "module", "left").join(c_n, "module", "left").select("module", F.coalesce("functions", zero).alias("functions"), F.coalesce("classes", zero).alias("classes"), F.coalesce(F.size("all_exports"), F.lit(-1)).alias("exports"))
    own = f.where(shown & F.col("class_name").isNull())
    if detail == "summary":
        return own.select("module", "signature", "line_start")
    return own.select("module", "signature", "line_start", "line_end", "docstring", F.size("params").alias("n_params"), "decorators")


def callers(v: Views, symbols: DataFrame | None = None) -> DataFrame:
    """Call sites of each symbol by name alone; the receiver does not count. symbols: (name)."""
    calls = v["calls"].select(F.col("symbol").alias("name"), "module", "line", "column", "context", "call_expression", "confidence")
    return calls if symbols is None else symbols.select("name").distinct().join(calls, "name")


def workspace_callers(v: Views, symbols: DataFrame) -> DataFrame:
    """Call sites in every package, the module led by its package: `package::module`."""
    package = F.regexp_extract("module", r"^[^.]*", 0)
    return callers(v, symbols).withColumn("module", F.concat_ws("::", package, "module"))


def filter_tests(callers: DataFrame, type_uses: DataFrame, mode: str | None = None, exclude_tests: bool = False) -> tuple[DataFrame, DataFrame]:
    """Callers and type uses (each with a module) without what stands in tests: `none` drops both, `related` the type uses alone.

    A mode given outright goes before the flag, which means `none`.
    """
    from corpusmill.functions.text import is_test_module

    mode = mode or ("none" if exclude_tests else None)
    keep = ~is_test_module(F.col("module"))
    return (callers.where(keep) if mode == "none" else callers), (type_uses.where(keep) if mode in ("none", "related") else type_uses)


def is_outside(name: Column) -> Column:
    """Whether a dotted name belongs to the language: a builtin, or a module of its standard library."""
    import builtins
    import sys

    names = [n for n in dir(builtins) if not n.startswith("_")]
    return name.isin(names) | F.substring_index(name, ".", 1).isin(sorted(sys.stdlib_module_names))


def move_callers(files: DataFrame, module: str, names: list[str]) -> DataFrame:
    """(path, names): files that import one of the names from a module, for a move of them.

    A look at the text comes first, then what the file imports; one that has the text and does not parse is kept, with no names.
    """
    from corpusmill.sources import python_source as P

    likely = P.parse_modules(files.where(F.contains("text", F.lit(f"from {module} import"))))
    own = F.filter("imports", lambda i: ~i["is_relative"] & (i["target"] == module))
    found = F.array_intersect(F.flatten(F.transform(own, lambda i: i["names"])), F.array(*map(F.lit, names)))
    return likely.select("path", F.array_sort(found).alias("names"), "error").where((F.size("names") > 0) | F.col("error").isNotNull()).drop("error")


def tests_naming(tests: DataFrame, symbol: str, module: str) -> DataFrame:
    """(path) of test files (path, text) that name a symbol; only where none does, of those that import its module."""
    direct = tests.where(F.contains("text", F.lit(symbol))).select("path")
    line = rf"(?m)^\s*(from|import)\s+{re.escape(module)}\b"
    fallback = tests.where(F.rlike("text", F.lit(line))).select("path")
    none = direct.agg((F.count("*") == 0).alias("none"))
    return direct.unionByName(fallback.crossJoin(F.broadcast(none)).where("none").select("path"))  # one row


def public(name: Column, exports: Column) -> Column:
    """Exported, where a module says what it exports (nothing, if the list is empty); else without a leading underscore."""
    return F.when(exports.isNotNull(), F.array_contains(exports, name)).otherwise(~F.startswith(name, F.lit("_")))


def symbol_corpus(v: Views, skipped: list[str]) -> DataFrame:
    """(qualname, kind, signature, doc_first_line) of the public functions and classes of modules that parse and lie in no skipped folder."""
    from corpusmill.functions.text import first_line

    clear = ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skipped)))
    modules = v["modules"].where(F.col("error").isNull() & clear).select("module", "all_exports")
    f = v["functions"].where("class_name is null").select("module", "name", F.lit("function").alias("kind"), "signature", "docstring")
    c = v["classes"].select("module", "name", F.lit("class").alias("kind"), F.concat(F.lit("class "), "name", F.lit("("), F.array_join("bases", ", "), F.lit(")")).alias("signature"), "docstring")
    own = f.unionByName(c).join(modules, "module").where(public(F.col("name"), F.col("all_exports")))
    return own.select(F.concat_ws(".", "module", "name").alias("qualname"), "kind", "signature", first_line(F.col("docstring")).alias("doc_first_line"))


def package_edges(v: Views) -> DataFrame:
    """(src, dst, target): absolute imports of another package, resolved to the module if there is one, else to the package."""
    package = lambda c: F.regexp_extract(c, r"^[^.]*", 0)
    known = v["modules"].select(F.col("module").alias("known")).distinct()
    packages = v["modules"].select(package(F.col("module")).alias("dst")).distinct()
    i = v["imports"].where("not is_relative").select(package(F.col("module")).alias("src"), "target", package(F.col("target")).alias("dst")).where("src <> dst")
    return i.join(packages, "dst", "left_semi").join(known, F.col("target") == F.col("known"), "left").select("src", "dst", F.coalesce("known", "dst").alias("target"))


def callees(v: Views) -> DataFrame:
    """Calls inside any definition of a name, nested definitions included; calls of the name itself are not.

    An interval join within a module: the place of the call lies in the definition's byte range.
    """
    d, c = v["definitions"].alias("d"), v["calls"].alias("c")
    inside = (F.col("d.module") == F.col("c.module")) & F.col("c.pos").between(F.col("d.start"), F.col("d.end") - 1) & (F.col("c.symbol") != F.col("d.name"))
    return d.join(c, inside).select("d.module", F.col("d.name").alias("name"), F.col("c.symbol").alias("callee"), F.col("c.line").alias("line"), F.col("c.pos").alias("pos")).distinct()


def import_edges(v: Views) -> DataFrame:
    """(src, dst) module edges: absolute by name, relative by climbing; unknown targets and self are dropped, repeats kept."""
    i = v["imports"]
    packages = v["modules"].select("module", F.col("path").rlike("(^|/)__init__\\.py$").alias("is_package"))
    parts = F.split("module", r"\.")
    up = F.size(parts) - F.col("level") + F.when(F.col("is_package"), 1).otherwise(0)
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(up, F.lit(0))), ".")
    target = F.when(F.col("is_relative"), F.concat_ws(".", F.nullif(base, F.lit("")), "target")).otherwise(F.col("target"))
    # `from . import x` names modules of the package itself
    reach = F.when(F.col("is_relative") & F.col("target").isNull(), F.transform("names", lambda n: F.concat_ws(".", base, n))).otherwise(F.array(target))
    edges = i.join(packages, "module").select(F.col("module").alias("src"), F.explode(reach).alias("dst"))
    return edges.join(v["modules"].select(F.col("module").alias("dst")), "dst", "left_semi").where("src <> dst").select("src", "dst")


def definition(v: Views, name: str) -> DataFrame:
    """A plain name: its one top-level definition, or an error if there are several; dotted: the first class and method."""
    owner, _, leaf = name.rpartition(".")
    if owner:
        found = v["functions"].where((F.col("class_name") == owner) & (F.col("name") == leaf))
        return found.orderBy("path", "line_start").limit(1).select("module", "class_name", "name", F.col("line_start").alias("line"))
    top = v["functions"].where("class_name is null").select("module", "name", "line_start").unionByName(v["classes"].select("module", "name", "line_start")).where(F.col("name") == name)
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("name"))
    guard = F.when(n > 1, F.raise_error(F.lit(f"{name} is defined more than once"))).otherwise(F.col("line_start"))
    return top.select("module", F.lit(None).cast("string").alias("class_name"), "name", guard.cast("int").alias("line"))


def reexports(v: Views, name: str) -> DataFrame:
    """Modules that export or import a name and do not define it."""
    defined = v["functions"].where("class_name is null").select("module", "name").unionByName(v["classes"].select("module", "name")).where(F.col("name") == name)
    exported = v["modules"].where(F.array_contains("all_exports", name)).select("module")
    imported = v["imports"].where(F.array_contains("names", name)).select("module")
    return exported.unionByName(imported).distinct().join(defined, "module", "left_anti")


def type_refs(v: Views, name: str) -> DataFrame:
    """Uses of a type by whole name: a parameter, else the return type, of a function; a variable's annotation or value."""
    whole = rf"(?U)(?<![\w.]){re.escape(name)}(?![\w.])"
    hit = lambda c: F.coalesce(c.rlike(whole), F.lit(False))
    f = v["functions"].withColumn("ref_type", F.when(F.exists("params", lambda p: hit(p["annotation"])), "param").when(hit(F.col("return_type")), "return"))
    f = f.where("ref_type is not null").select(F.when(F.col("class_name").isNull(), F.col("name")).otherwise(F.concat_ws(".", "class_name", "name")).alias("function"), "module", F.col("line_start").alias("line"), "ref_type")
    a = v["variables"].where(hit(F.col("annotation")) | hit(F.col("value_repr"))).select(F.col("name").alias("function"), "module", "line", F.lit("alias").alias("ref_type"))
    return f.unionByName(a)


def entry_points(v: Views) -> DataFrame:
    """(name, module, kind, framework, line): tests before decorated functions, main guards and exports besides."""
    framework = F.lit(None).cast("string")
    for name, prefixes in reversed(list(ENTRY_DECORATORS.items())):
        starts = F.exists("decorators", lambda d: reduce(lambda a, b: a | b, [F.startswith(d, F.lit(p)) for p in prefixes]))
        framework = F.when(starts, name).otherwise(framework)
    f = v["functions"].withColumn("framework", F.when(F.startswith("name", F.lit("test_")), "pytest").otherwise(framework)).where("framework is not null")
    one = f.select("name", "module", F.when(F.col("framework") == "pytest", "test").otherwise("decorator").alias("kind"), "framework", F.col("line_start").alias("line"))
    guard = v["modules"].where("main_guard_line is not null").select(F.lit("__main__").alias("name"), "module", F.lit("main_guard").alias("kind"), F.lit("main").alias("framework"), F.col("main_guard_line").alias("line"))
    lines = v["functions"].where("class_name is null").select("module", "name", F.col("line_start").alias("line")).unionByName(v["classes"].select("module", "name", F.col("line_start").alias("line")))
    exports = v["modules"].select("module", F.explode("all_exports").alias("name")).join(lines, ["module", "name"], "left")
    exports = exports.select("name", "module", F.lit("export").alias("kind"), F.lit("all").alias("framework"), F.coalesce("line", F.lit(0)).alias("line"))
    return one.unionByName(guard).unionByName(exports)


def namespace_modules(v: Views) -> DataFrame:
    """Modules that are imported as objects, by the last part of their name."""
    i = v["imports"]
    whole = i.where("not is_relative and size(names) = 1 and names[0] = target").select(F.substring_index("target", ".", -1).alias("stem"))
    parts = i.where("target is null or not (size(names) = 1 and names[0] = target)").select(F.explode("names").alias("stem"))
    stems = whole.unionByName(parts).distinct()
    return v["modules"].select("module", F.substring_index("module", ".", -1).alias("stem")).join(stems, "stem", "left_semi").select("module")


def dead_symbols(v: Views) -> DataFrame:
    """(module, class_name, name, kind, line) of symbols that nothing calls, refers to, exports, decorates or imports.

    Names alone count, so homonyms keep each other alive. Test modules are users, never candidates. A method
    also lives if it overrides a called method of a base of the corpus, or, unless its name begins with one
    underscore, anything of a base from outside.
    """
    used = v["calls"].select(F.col("symbol").alias("name")).unionByName(v["refs"].select("name")).unionByName(entry_points(v).select("name")).unionByName(v["imports"].select(F.explode("names").alias("name")).where("name <> '*'").join(v["modules"].select(F.substring_index("module", ".", -1).alias("name")), "name", "left_anti")).distinct()
    bases = v["classes"].select("module", F.col("name").alias("class_name"), F.explode("bases").alias("base"))
    base_names = bases.select(F.substring_index("base", ".", -1).alias("name")).distinct()
    tests = F.exists(F.split("module", r"\."), lambda s: (s == "tests") | F.startswith(s, F.lit("test_"))) | (F.substring_index("module", ".", -1) == "conftest")
    exports = v["modules"].select("module", F.explode("all_exports").alias("name")).distinct()
    spaces = namespace_modules(v).withColumn("space", F.lit(True))
    protocols = bases.where(F.col("base").isin(PROTOCOLS)).select("module", "class_name").distinct().withColumn("protocol", F.lit(True))

    f = v["functions"].where(~tests & ~F.col("name").rlike("^(__.*__|test_.*)$") & (F.size("decorators") == 0))
    f = f.join(used, "name", "left_anti").join(exports, ["module", "name"], "left_anti")
    f = f.join(spaces, "module", "left").where(F.col("space").isNull() | F.startswith("name", F.lit("_")) | F.col("class_name").isNotNull())
    f = f.join(protocols, ["module", "class_name"], "left").where("protocol is null")
    # methods kept alive through their class's bases
    methods = v["functions"].where("class_name is not null").select(F.col("class_name").alias("base"), "name").distinct().withColumn("overrides", F.lit(True))
    inner = v["classes"].select(F.col("name").alias("base")).distinct().withColumn("inner", F.lit(True))
    calls = v["calls"].select(F.col("symbol").alias("name")).distinct().withColumn("called", F.lit(True))
    kept = (
        f.where("class_name is not null").select("module", "class_name", "name").join(bases, ["module", "class_name"]).join(inner, "base", "left").join(methods, ["base", "name"], "left").join(calls, "name", "left")
        .where((F.col("inner").isNull() & (~F.startswith("name", F.lit("_")) | F.startswith("name", F.lit("__")))) | (F.col("overrides") & F.col("called")))
        .select("module", "class_name", "name").distinct()
    )
    f = f.join(kept, [f.module.eqNullSafe(kept.module), f.class_name.eqNullSafe(kept.class_name), f.name == kept.name], "left_anti")
    f = f.select("module", "class_name", "name", F.when(F.col("class_name").isNull(), "function").otherwise("method").alias("kind"), F.col("line_start").alias("line"))
    c = v["classes"].where(~tests & (F.size("decorators") == 0) & ~F.col("name").rlike("(Error|Exception)$") & ~F.arrays_overlap("bases", F.array(*map(F.lit, PROTOCOLS))))
    c = c.join(used, "name", "left_anti").join(base_names, "name", "left_anti").join(exports, ["module", "name"], "left_anti")
    return f.unionByName(c.select("module", F.lit(None).cast("string").alias("class_name"), "name", F.lit("class").alias("kind"), F.col("line_start").alias("line")))


def structural_diff(base: DataFrame, head: DataFrame, keys: list[str], signature: str) -> DataFrame:
    """Keys with their change between two snapshots: added, removed, or modified where the signature differs."""
    a = base.select(*keys, F.col(signature).alias("before"), F.lit(True).alias("in_base"))
    b = head.select(*keys, F.col(signature).alias("after"), F.lit(True).alias("in_head"))
    change = F.when(F.col("in_base").isNull(), "added").when(F.col("in_head").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "modified")
    return a.join(b, keys, "full_outer").withColumn("change", change).where("change is not null").select(*keys, "change", "before", "after")


def doc_lines(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.posexplode(F.split("text", "\n")).alias("k", "line_text")).select("path", (F.col("k") + 1).alias("line"), "line_text")


def doc_refs(docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, path, line): lines with the symbol between two backticks, or, ignoring case, in a heading.

    A symbol is found inside longer words too. Each marked stretch is cut into its parts of the lengths that
    symbols have, and those meet the symbols in an equi join. Symbols grow with the sources and sizes of parsed
    tables are guesses, so they are never broadcast.
    """
    wanted = symbols.select("symbol").where("symbol <> ''").distinct()
    lengths = [r["n"] for r in wanted.select(F.char_length("symbol").alias("n")).distinct().orderBy("n").collect()]  # at most the longest symbol's
    lines = doc_lines(docs)
    ticks = F.split("line_text", "`")
    quoted = lines.where(F.contains("line_text", F.lit("`"))).select("path", "line", F.explode(F.slice(ticks, F.lit(2), F.greatest(F.size(ticks) - 2, F.lit(0)))).alias("stretch"))
    headed = lines.select("path", "line", F.lower(F.regexp_extract("line_text", r"^#+\s+(.*)$", 1)).alias("stretch")).where("stretch <> ''")

    def parts(stretches: DataFrame) -> DataFrame:
        cut = lambda n: F.transform(F.sequence(F.lit(1), F.char_length("stretch") - n + 1), lambda i: F.substring("stretch", i, n))
        every = F.flatten(F.filter(F.transform(F.array(*map(F.lit, lengths or [1])), lambda n: F.when(F.char_length("stretch") >= n, cut(n))), lambda x: x.isNotNull()))
        return stretches.select("path", "line", F.explode(F.array_distinct(every)).alias("part"))

    own = wanted.withColumn("low", F.lower("symbol")).hint("merge")
    found = parts(quoted).join(own, F.col("part") == F.col("symbol")).unionByName(parts(headed).join(own, F.col("part") == F.col("low")))
    return found.select("symbol", "path", "line").distinct()


def undocumented(docs: DataFrame, symbols: DataFrame) -> DataFrame:
    return symbols.select("symbol").join(doc_refs(docs, symbols).select("symbol").distinct().hint("merge"), "symbol", "left_anti")


def fenced(docs: DataFrame) -> DataFrame:
    """Lines of docs inside code fences."""
    from pyspark.sql import Window

    mark = F.col("line_text").rlike("^\\s*```")
    w = Window.partitionBy("path").orderBy("line")
    return doc_lines(docs).withColumn("depth", F.sum(mark.cast("int")).over(w)).where(~mark & (F.col("depth") % 2 == 1)).drop("depth")


def stale_signatures(docs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Signatures in code fences that none of the same-named real ones equals. signatures: (name, signature)."""
    found = fenced(docs).withColumn("name", F.regexp_extract("line_text", r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)", 1)).where("name <> ''")
    found = found.withColumn("doc_sig", F.regexp_replace(F.trim("line_text"), r":?\s*$", ""))
    joined = found.join(signatures.select("name", F.col("signature").alias("real")), "name")
    return joined.groupBy("name", "path", "line", "doc_sig").agg(F.every(F.col("real") != F.col("doc_sig")).alias("stale")).where("stale").drop("stale")


def grep(files: DataFrame, pattern: str, regex: bool = False, cap: int = 50) -> DataFrame:
    """Matching lines in path and line order up to the cap, with how many there are in all and whether some were cut."""
    lines = doc_lines(files)
    hit = lines.where(F.col("line_text").rlike(pattern) if regex else F.contains("line_text", F.lit(pattern)))
    total = hit.agg(F.count("*").alias("total"))
    return hit.orderBy("path", "line").limit(cap).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > cap)


def classify_callers(calls: DataFrame, symbol_module: str) -> DataFrame:
    """Call lines by file: production, or test, direct if the file's name holds the module's leaf name."""
    leaf = symbol_module.rsplit(".", 1)[-1]
    name = F.substring_index("path", "/", -1)
    kind = F.when(~F.contains(name, F.lit("test")), "production").when(F.contains(name, F.lit(leaf)), "test_direct").otherwise("test_indirect")
    return calls.withColumn("kind", kind).groupBy("kind", "path").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def mirror(modules: DataFrame, tests: DataFrame) -> DataFrame:
    """(name, problem): modules without a test and tests without a module, leading underscores aside."""
    m = modules.select(F.regexp_replace("name", "^_+", "").alias("key"), F.col("name").alias("module"))
    t = tests.select(F.regexp_replace(F.regexp_replace("name", "^test_", ""), "^_+", "").alias("key"), F.col("name").alias("test"))
    both = m.join(t, "key", "full_outer").where("module is null or test is null")
    return both.select(F.coalesce("module", "test").alias("name"), F.when(F.col("test").isNull(), "missing").otherwise("orphan").alias("problem"))


def god_classes(v: Views, most_lines: int = 500, most_methods: int = 15) -> DataFrame:
    methods = v["functions"].where("class_name is not null").groupBy("module", F.col("class_name").alias("name")).agg(F.count("*").alias("n_methods"))
    c = v["classes"].join(methods, ["module", "name"], "left").withColumns({"n_methods": F.coalesce("n_methods", F.lit(0)), "n_lines": F.col("line_end") - F.col("line_start") + 1})
    return c.where((F.col("n_lines") > most_lines) | (F.col("n_methods") > most_methods)).select("module", "name", "n_lines", "n_methods")
