"""A source tree written from the rows of `part`: input of the code queries, and its facts stated from the same rows in SQL.

Eight parts make a module: a class, and seven functions with decorators, defaults, annotations, nested and recursive
calls, private and shared names. Modules import and export each other, some have a main guard, some do not parse;
every other one has a test file and every fourth one a page of documentation. The files go through the parser; the
facts that SQL states are computed from the part keys, not from the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage, table
from corpusmill.sources import python_source as P


def whole(x: str, n: int) -> str:
    return f"CAST(floor(({x}) / {n}) AS BIGINT)"


def named(x: str) -> str:
    """The name of what part x defines, as an expression of either dialect."""
    return f"(CASE ({x}) % 8 WHEN 0 THEN concat('C', {x}) WHEN 6 THEN concat('h', ({x}) % 11) WHEN 7 THEN concat('_f', {x}) ELSE concat('f', {x}) END)"


M, J = whole("k", 8), "(k % 8)"
MODULE = "concat('p', m % 5, '.m', m)"
BROKEN = "(m % 50 = 49)"
#: The module that one imports from, what a function calls, what a class derives from.
FROM = f"(CASE WHEN m % 4 >= 2 THEN greatest(m - 5, 0) ELSE {whole('m', 2)} END)"
CALLEE = f"(CASE WHEN j = 4 THEN {named('k')} ELSE {named(whole('k', 2))} END)"
BASE = f"(CASE m % 3 WHEN 0 THEN concat('C', 8 * {whole('m', 2)}) WHEN 1 THEN 'Protocol' ELSE 'Outside' END)"
ANNOTATION = "(CASE j WHEN 1 THEN concat('C', 8 * m) WHEN 2 THEN concat('list[C', 8 * m, ']') WHEN 3 THEN concat('x.C', 8 * m) ELSE 'int' END)"
RETURNS = "(CASE j WHEN 4 THEN concat('C', 8 * m) WHEN 6 THEN NULL ELSE 'str' END)"
HEIGHT = "(CASE j WHEN 0 THEN CASE WHEN m % 4 = 1 THEN 17 ELSE 14 END WHEN 1 THEN 6 WHEN 2 THEN 4 WHEN 3 THEN 7 ELSE 5 END)"
TEST = "concat('test_', CASE WHEN m % 14 = 0 THEN 'x' ELSE 'm' END, m)"

_BLOCK = rf"""CASE j
 WHEN 0 THEN concat_ws('\n', concat('class C', k, '(', {BASE}, '):'), concat('    \"\"\"', p_name, ' keeper.\"\"\"'), '', concat('    def run(self, x: int = ', p_size, ') -> C', k, ':'), concat('        return ', {CALLEE}, '(x)'), '',
   '    @property', '    def size(self) -> int:', '        return 1', '', '    def _idle(self):', '        return None', CASE WHEN m % 4 = 1 THEN concat_ws('\n', '', '    def more(self):', '        return None') END, '', '')
 WHEN 1 THEN concat_ws('\n', '@app.command', {{head}}, {{doc}}, concat('    return ', {CALLEE}, '(a)'), '', '')
 WHEN 2 THEN concat_ws('\n', {{head}}, concat('    return ', {CALLEE}, '(a)'), '', '')
 WHEN 3 THEN concat_ws('\n', {{head}}, {{doc}}, '    def inner():', concat('        return ', {CALLEE}, '(a)'), '    return inner()', '', '')
 ELSE concat_ws('\n', concat(CASE WHEN j = 5 THEN 'async ' ELSE '' END, {{head}}), {{doc}}, concat('    return ', {CALLEE}, '(a)'), '', '') END"""
_HEAD = f"concat('def ', {named('k')}, '(a: ', {ANNOTATION}, ', b=', p_size, ')', coalesce(concat(' -> ', {RETURNS}), ''), ':')"
_BLOCK = _BLOCK.replace("{head}", _HEAD).replace("{doc}", r"""concat('    \"\"\"', p_name, '.\"\"\"')""")
_IMPORT = f"""CASE m % 4 WHEN 0 THEN 'import json' WHEN 1 THEN concat('from p', t % 5, '.m', t, ' import ', {named('8 * t + 1')}, ', ', {named('8 * t + 2')})
 WHEN 2 THEN concat('from . import m', t) ELSE concat('from .m', t, ' import ', {named('8 * t + 1')}) END"""
_THIRD = f"""CASE m % 3 WHEN 0 THEN concat('__all__ = ["', {named('8 * m + 1')}, '", "', {named('8 * m + 2')}, '", "', {named('8 * t + 1')}, '"]') WHEN 1 THEN '__all__ = []' ELSE concat('LIMIT', m, ': int = ', m) END"""
_GUARD = rf"""CASE WHEN m % 6 = 0 THEN concat('if __name__ == "__main__":\n    ', {named('8 * m + 1')}, '(1)\n') ELSE '' END"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_name", "p_size").selectExpr("*", f"{M} AS m", f"{J} AS j")
    return p.selectExpr("*", f"{FROM} AS t")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of every module and test file."""
    p = _parts(spark, sf_dir).selectExpr("*", f"{_BLOCK} AS block")
    m = p.groupBy("m", "t").agg(F.array_sort(F.collect_list(F.struct("k", "block"))).alias("b"))  # eight at most
    text = rf"""CASE WHEN {BROKEN} THEN 'def broken(:' ELSE concat('\"\"\"Module ', m, '.\"\"\"\n', {_IMPORT}, '\n', {_THIRD}, '\nALIAS', m, ' = C', 8 * m, '\n\n\n', array_join(transform(b, x -> x.block), '\n'), '\n', {_GUARD}) END"""
    src = m.selectExpr("concat('src/p', m % 5, '/m', m, '.py') AS path", f"{text} AS text")
    test = rf"concat('from ', {MODULE}, ' import ', {named('8 * m + 1')}, '\n\n\ndef ', {TEST}, '():\n    assert ', {named('8 * m + 1')}, '(1) == \"', {named('8 * m + 5')}, '\"\n')"
    return src.unionByName(m.where("m % 2 = 0").selectExpr(f"concat('tests/unit/', {TEST}, '.py') AS path", f"{test} AS text"))


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The fact tables of the source tree, parsed once."""
    return P.views(cut_lineage(P.parse_modules(sources(spark, sf_dir))))


_DOC = rf"""concat('# Module m', m, '\n\nUse `', {named('8 * m + 3')}, '` first.\n> quoted\n\n## ', {named('8 * m + 5')}, ' and more\n\n```python\ndef ', {named('8 * m + 1')}, '(a: C', 8 * m, ', b = ', CASE WHEN m % 8 = 4 THEN -1 ELSE p_size END, ') -> str:\n```\nAfter a fence: ', {named('8 * m + 2')}, '.\n\n## ', {named('8 * m + 5')}, ' and more\nLater words.\n')"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a page for every fourth module, with names in backticks, headings and fences."""
    p = _parts(spark, sf_dir).where("j = 1 AND m % 4 = 0")
    return p.selectExpr("concat('docs/m', m, '.md') AS path", f"{_DOC} AS text")


# the same facts from the same rows, in the other dialect
_FACTS = {
    "base_": f"SELECT *, {FROM} AS t FROM (SELECT p_partkey AS k, p_name, p_size, {M} AS m, {J} AS j FROM part)",
    "mods_": f"SELECT DISTINCT m, t, {BROKEN} AS broken, {MODULE} AS module, concat('src/p', m % 5, '/m', m, '.py') AS path FROM base_",
    "placed_": f"SELECT b.*, 7 + sum({HEIGHT}) OVER (PARTITION BY b.m ORDER BY b.k) - {HEIGHT} AS line, s.module, s.path FROM base_ b JOIN mods_ s ON s.m = b.m WHERE NOT s.broken".replace("(CASE j", "(CASE b.j").replace("m % 4 = 1", "b.m % 4 = 1"),
    "tall_": f"SELECT m, 6 + sum({HEIGHT}) AS lines FROM base_ GROUP BY m",
    "tests_": f"SELECT m, concat('tests/unit/', {TEST}, '.py') AS path, concat('tests.unit.', {TEST}) AS module, {TEST} AS name FROM mods_ WHERE m % 2 = 0",
    "modules_": f"""SELECT path, module, CASE WHEN broken THEN 'SyntaxError' END AS error, CASE WHEN NOT broken THEN concat('Module ', m, '.') END AS docstring,
  CASE WHEN broken THEN NULL WHEN m % 3 = 0 THEN [{named('8 * m + 1')}, {named('8 * m + 2')}, {named('8 * t + 1')}] WHEN m % 3 = 1 THEN CAST([] AS VARCHAR[]) END AS all_exports,
  CASE WHEN NOT broken AND m % 6 = 0 THEN lines + 1 END AS main_guard_line FROM mods_ JOIN tall_ USING (m)
  UNION ALL SELECT path, module, NULL, NULL, NULL, NULL FROM tests_""",
    "functions_": f"""SELECT path, module, CAST(NULL AS VARCHAR) AS class_name, {named('k')} AS name, 'function' AS kind, {RETURNS} AS return_type, CASE WHEN j = 1 THEN ['app.command'] ELSE CAST([] AS VARCHAR[]) END AS decorators,
   line + (j = 1)::INT AS line_start, line + CASE j WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 4 ELSE 2 END AS line_end,
   concat(CASE WHEN j = 5 THEN 'async ' ELSE '' END, 'def ', {named('k')}, '(a: ', {ANNOTATION}, ', b = ', p_size, ')', CASE WHEN {RETURNS} IS NULL THEN '' ELSE concat(' -> ', {RETURNS}) END) AS signature, [{ANNOTATION}, ''] AS annotations, CASE WHEN j <> 2 THEN concat(p_name, '.') END AS docstring FROM placed_ WHERE j > 0
  UNION ALL SELECT path, module, {named('k')}, 'run', 'method', concat('C', k), CAST([] AS VARCHAR[]), line + 3, line + 4, concat('def run(self, x: int = ', p_size, ') -> C', k), ['', 'int'], NULL FROM placed_ WHERE j = 0
  UNION ALL SELECT path, module, {named('k')}, 'size', 'property', 'int', ['property'], line + 7, line + 8, 'def size(self) -> int', [''], NULL FROM placed_ WHERE j = 0
  UNION ALL SELECT path, module, {named('k')}, '_idle', 'method', NULL, CAST([] AS VARCHAR[]), line + 10, line + 11, 'def _idle(self)', [''], NULL FROM placed_ WHERE j = 0
  UNION ALL SELECT path, module, {named('k')}, 'more', 'method', NULL, CAST([] AS VARCHAR[]), line + 13, line + 14, 'def more(self)', [''], NULL FROM placed_ WHERE j = 0 AND m % 4 = 1
  UNION ALL SELECT path, module, NULL, name, 'function', NULL, CAST([] AS VARCHAR[]), 4, 5, concat('def ', name, '()'), CAST([] AS VARCHAR[]), NULL FROM tests_""",
    "classes_": f"SELECT path, module, {named('k')} AS name, [{BASE}] AS bases, CAST([] AS VARCHAR[]) AS decorators, line AS line_start, line + CASE WHEN m % 4 = 1 THEN 14 ELSE 11 END AS line_end FROM placed_ WHERE j = 0",
    "variables_": "SELECT path, module, concat('ALIAS', m) AS name, CAST(NULL AS VARCHAR) AS annotation, concat('C', 8 * m) AS value_repr, 4 AS line FROM mods_ WHERE NOT broken UNION ALL SELECT path, module, concat('LIMIT', m), 'int', CAST(m AS VARCHAR), 3 FROM mods_ WHERE NOT broken AND m % 3 = 2",
    "imports_": f"""SELECT path, module, CASE m % 4 WHEN 0 THEN 'json' WHEN 1 THEN concat('p', t % 5, '.m', t) WHEN 3 THEN concat('m', t) END AS target,
   CASE m % 4 WHEN 0 THEN ['json'] WHEN 1 THEN [{named('8 * t + 1')}, {named('8 * t + 2')}] WHEN 2 THEN [concat('m', t)] ELSE [{named('8 * t + 1')}] END AS names, m % 4 >= 2 AS is_relative, (m % 4 >= 2)::INT AS level FROM mods_ WHERE NOT broken
  UNION ALL SELECT path, module, concat('p', m % 5, '.m', m), [{named('8 * m + 1')}], false, 0 FROM tests_""",
    "calls_": f"""SELECT path, module, {CALLEE} AS symbol, line + CASE j WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 2 END AS line, CASE j WHEN 0 THEN 'run' WHEN 3 THEN 'inner' ELSE {named('k')} END AS context FROM placed_
  UNION ALL SELECT path, module, 'inner', line + 4, {named('k')} FROM placed_ WHERE j = 3
  UNION ALL SELECT path, module, {named('8 * m + 1')}, lines + 2, NULL FROM mods_ JOIN tall_ USING (m) WHERE NOT broken AND m % 6 = 0
  UNION ALL SELECT path, module, {named('8 * m + 1')}, 5, name FROM tests_""",
    # which definition holds which call, nested ones counted for all around them
    "inside_": f"""SELECT DISTINCT * FROM (SELECT module, context AS name, symbol AS callee, line FROM calls_ WHERE context IS NOT NULL
  UNION ALL SELECT module, {named('k')}, {CALLEE}, line + CASE j WHEN 0 THEN 4 ELSE 3 END FROM placed_ WHERE j IN (0, 3)) WHERE callee <> name""",
    "refs_": f"SELECT DISTINCT path, module, name FROM (SELECT path, module, 'a' AS name FROM placed_ WHERE j > 0 UNION ALL SELECT path, module, 'x' FROM placed_ WHERE j = 0 UNION ALL SELECT path, module, unnest(all_exports) FROM modules_)",
    "docs_": f"SELECT concat('docs/m', m, '.md') AS path, m, p_size FROM base_ WHERE j = 1 AND m % 4 = 0",
}
_NEEDS = {"placed_": ["base_", "mods_"], "mods_": ["base_"], "tall_": ["base_"], "tests_": ["mods_"], "modules_": ["mods_", "tall_", "tests_"], "functions_": ["placed_", "tests_"], "classes_": ["placed_"], "variables_": ["mods_"], "imports_": ["mods_", "tests_"], "calls_": ["placed_", "mods_", "tall_", "tests_"], "inside_": ["calls_", "placed_"], "refs_": ["placed_", "modules_"], "docs_": ["base_"]}


def facts(*names: str, recursive: bool = False) -> str:
    """WITH items that state the named facts (without their underscore) from `part`."""
    wanted: list[str] = []

    def add(n: str) -> None:
        for x in _NEEDS.get(n, []):
            add(x)
        if n not in wanted:
            wanted.append(n)

    for n in names:
        add(n + "_")
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(f"{n} AS ({_FACTS[n]})" for n in wanted) + "\n"
