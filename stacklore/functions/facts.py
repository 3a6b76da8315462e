"""Facts about Python source.

Python syntax needs Python's own parser, so one Arrow function parses each text
once and returns a flat list of facts. It judges nothing: every rule and score
below is a Spark expression over that list, evaluated in the row it came from,
so scoring a catalogue needs no shuffle.
"""

import ast

import pyarrow as pa
from pyspark.sql import Column, functions as F

from stacklore import constants as K
from stacklore.functions.code import sql_injection_findings
from stacklore.functions.text import col
from stacklore.schemas import FACTS

_ARROW_FACTS = pa.list_(pa.struct([
    ("kind", pa.string()), ("name", pa.string()), ("detail", pa.string()),
    ("size", pa.int32()), ("params", pa.int32()), ("flag", pa.bool_()),
    ("lineno", pa.int32()), ("end_lineno", pa.int32()),
]))
_BRANCHES = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.Try, ast.ExceptHandler,
             ast.With, ast.AsyncWith, ast.IfExp)


def _walk(root):
    """The nodes of ``ast.walk`` in its order, without those that say load or store."""
    found = [root]
    for node in found:
        for field in node._fields:
            value = getattr(node, field, None) if field != "ctx" else None
            if isinstance(value, ast.AST):
                found.append(value)
            elif isinstance(value, list):
                found.extend([v for v in value if isinstance(v, ast.AST)])
    return found


def _constant(node):
    if isinstance(node, ast.Compare):
        return all(map(_constant, [node.left, *node.comparators]))
    return isinstance(node, ast.Constant)


def _complexity(function):
    nodes = _walk(function)
    return 1 + sum(isinstance(n, _BRANCHES) for n in nodes) + sum(
        len(n.values) - 1 for n in nodes if isinstance(n, ast.BoolOp))


def _hollow(function):
    def constant_of(statement):
        value = getattr(statement, "value", None)
        held = isinstance(statement, ast.Expr) and isinstance(value, ast.Constant)
        return value.value if held else None

    body = [s for s in function.body if not isinstance(constant_of(s), str)]
    if len(body) != 1:
        return not body
    only = body[0]
    if isinstance(only, ast.Return):
        returned = getattr(only.value, "id", None)
        return returned is not None and returned in {a.arg for a in function.args.args}
    return isinstance(only, ast.Pass) or constant_of(only) is Ellipsis


def _import(node):
    return [dict(kind="import", name=a.name, detail="import", size=0) for a in node.names]


def _import_from(node):
    return [dict(kind="import", name=node.module, detail="from", size=node.level)]


def _function(node):
    args = node.args
    count = len(args.args) + len(args.kwonlyargs) + bool(args.vararg) + bool(args.kwarg)
    detail = "function" if isinstance(node, ast.FunctionDef) else "async"
    return [dict(kind="function", name=node.name, detail=detail, size=_complexity(node),
                 params=count, flag=_hollow(node))]


def _methods(node):
    return [dict(kind="method", name=m.name, detail=node.name, lineno=m.lineno,
                 end_lineno=m.end_lineno) for m in node.body if isinstance(m, ast.FunctionDef)]


def _text_assign(node):
    text = node.value.value if isinstance(node.value, ast.Constant) else None
    named = [t for t in node.targets if isinstance(t, ast.Name) and isinstance(text, str)]
    return [dict(kind="text_assign", name=t.id, size=len(text)) for t in named]


def _call(node):
    name = getattr(node.func, "id", None) or getattr(node.func, "attr", None)
    if not isinstance(name, str):
        return []
    shell = [k for k in node.keywords
             if k.arg == "shell" and getattr(k.value, "value", None) is True]
    owner = getattr(getattr(node.func, "value", None), "id", None)
    return [dict(kind="call", name=name, detail=owner, size=len(shell),
                 flag=all(map(_constant, node.args)))]


# What each kind of fact reads, and from which nodes.
_READERS = {
    "import": {ast.Import: _import, ast.ImportFrom: _import_from},
    "function": dict.fromkeys((ast.FunctionDef, ast.AsyncFunctionDef), _function),
    "class": {ast.ClassDef: lambda n: [dict(kind="class", name=n.name)]},
    "method": {ast.ClassDef: _methods},
    "text_assign": {ast.Assign: _text_assign},
    "call": {ast.Call: _call},
    "assert": {ast.Assert: lambda n: [dict(kind="assert", flag=_constant(n.test))]},
    "name": {ast.Name: lambda n: [dict(kind="name", name=n.id)],
             ast.Attribute: lambda n: [dict(kind="name", name=n.attr)]},
}


def parse_facts(source, kinds):
    """All facts of the wanted kinds, or one ``syntax_error`` fact."""
    readers = {}
    for kind in kinds:
        for node_type, read in _READERS[kind].items():
            readers.setdefault(node_type, []).append(read)
    try:
        tree = ast.parse(source or "")
        top = set(map(id, tree.body))
        found = []
        for node in _walk(tree):
            for read in readers.get(type(node), ()):
                for fact in read(node):
                    fact.setdefault("lineno", node.lineno)
                    fact.setdefault("end_lineno", node.end_lineno)
                    if fact["kind"] == "import":
                        fact["flag"] = id(node) in top
                    found.append(fact)
        return found
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return [{"kind": "syntax_error", "detail": type(error).__name__}]


def _parser(*kinds):
    @F.arrow_udf(FACTS)
    def parse(source: pa.Array) -> pa.Array:
        return pa.array([parse_facts(s, kinds) for s in source.to_pylist()], type=_ARROW_FACTS)

    return parse


def code_facts(code) -> Column:
    return _parser("import", "function", "class", "text_assign", "call")(col(code))


def test_facts(test) -> Column:
    return _parser("assert", "call", "name")(col(test))


def unit_facts(code) -> Column:
    return _parser("function", "method")(col(code))


def of_kind(facts, *kinds) -> Column:
    return F.filter(col(facts), lambda f: f["kind"].isin(*kinds))


def broken(facts) -> Column:
    return F.exists(col(facts), lambda f: f["kind"] == "syntax_error")


def imported_modules(facts) -> Column:
    """Full names of absolute imports, each once."""
    absolute = F.filter(of_kind(facts, "import"), lambda f: (f["size"] == 0) & (f["name"] != ""))
    return F.array_distinct(F.transform(absolute, lambda f: f["name"]))


def top_module(name) -> Column:
    return F.substring_index(name, ".", 1)


def assertions(facts) -> Column:
    """Assertions that are not constant: statements and calls named ``assert...``."""
    return F.filter(col(facts), lambda f: ~f["flag"] & (
        (f["kind"] == "assert") | ((f["kind"] == "call") & f["name"].startswith("assert"))))


def tests_use_code(code, test) -> Column:
    """Whether the test names a public definition of the code."""
    defined = F.transform(
        F.filter(of_kind(code, "function", "class"), lambda f: ~f["name"].startswith("_")),
        lambda f: f["name"])
    used = F.transform(of_kind(test, "name"), lambda f: f["name"])
    return broken(code) | broken(test) | (F.size(defined) == 0) | F.arrays_overlap(defined, used)


def hollow_functions(facts) -> Column:
    return F.transform(
        F.filter(of_kind(facts, "function"), lambda f: f["flag"]), lambda f: f["name"])


def heavy_imports(facts) -> Column:
    top = F.filter(of_kind(facts, "import"), lambda f: f["flag"] & f["name"].isNotNull())
    names = F.transform(top, lambda f: top_module(f["name"]))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: n.isin(*K.HEAVY_MODULES))))


def security_findings(facts, code) -> Column:
    """array<struct<lineno, message>> over syntax facts and line patterns."""
    def finding(condition, lineno, *message):
        return F.when(condition, F.struct(
            lineno.alias("lineno"), F.concat(*message).alias("message")))

    def judge(f):
        call = f["kind"] == "call"
        secret = ((f["kind"] == "text_assign") & (f["size"] > 4)
                  & F.upper(f["name"]).rlike(K.SECRET_NAME_PATTERN))
        pickled = call & f["name"].isin("load", "loads") & (f["detail"] == "pickle")
        shell = call & f["name"].isin(*K.SHELL_CALLS) & (f["size"] > 0)
        return F.array_compact(F.array(
            finding(secret, f["lineno"],
                    F.lit("Potential hardcoded secret in variable '"), f["name"], F.lit("'")),
            finding(call & f["name"].isin("eval", "exec"), f["lineno"],
                    F.lit("Dangerous usage of '"), f["name"], F.lit("' detected.")),
            finding(pickled, f["lineno"],
                    F.lit("Pickle usage is insecure. Use JSON for untrusted data.")),
            finding(shell, f["lineno"],
                    F.lit("Subprocess '"), f["name"], F.lit("' called with shell=True.")),
        ))

    return F.concat(F.flatten(F.transform(col(facts), judge)), sql_injection_findings(code))


def undeclared_modules(facts, declared=None) -> Column:
    """Imports that are neither standard nor declared (column of package keys)."""
    def known(name):
        top = top_module(name)
        key = F.replace(F.lower(top), F.lit("_"), F.lit("-"))
        if declared is None:
            return top.isin(*K.STDLIB_MODULES) | top.isin(*K.COMMON_PACKAGES)
        common = (F.size(declared) == 0) & top.isin(*K.COMMON_PACKAGES)
        return top.isin(*K.STDLIB_MODULES) | F.array_contains(declared, key) | common

    return F.array_sort(F.filter(imported_modules(facts), lambda n: ~known(n)))


def security_score(facts, code) -> Column:
    lost = F.size(security_findings(facts, code)) * 40.0
    return F.when(broken(facts), 0.0).otherwise(F.greatest(F.lit(0.0), 100.0 - lost))


def dependency_score(facts, declared=None) -> Column:
    lost = F.size(undeclared_modules(facts, declared)) * 30.0
    return F.when(broken(facts), 0.0).otherwise(F.greatest(F.lit(0.0), 100.0 - lost))


def function_deduction(complexity, params) -> Column:
    over = F.when(complexity > 10, (complexity - 10) * 15.0).otherwise(0.0)
    return over + F.when(params > 6, 30.0).otherwise(0.0)


def metrics_score(facts) -> Column:
    lost = F.aggregate(of_kind(facts, "function"), F.lit(0.0),
                       lambda acc, f: acc + function_deduction(f["size"], f["params"]))
    return F.when(broken(facts), 0.0).otherwise(F.greatest(F.lit(0.0), 100.0 - lost))


def python_static_score(facts) -> Column:
    imports = of_kind(facts, "import")
    dotted = F.filter(imports, lambda f: (f["detail"] == "import") & f["name"].contains("."))
    relative = F.filter(imports, lambda f: f["size"] > 0)
    functions = F.filter(of_kind(facts, "function"), lambda f: f["detail"] == "function")
    lost = (F.size(dotted) * 5.0 + F.size(relative) * 10.0
            + F.when(F.size(functions) > 1, 10.0).otherwise(0.0))
    return F.when(broken(facts), 0.0).otherwise(F.greatest(F.lit(0.0), 100.0 - lost))


def deterministic_score(assert_count, calls_code, hollow, heavy) -> Column:
    """Test density, then unused code, then hollow bodies, then heavy imports."""
    asserts = col(assert_count)
    density = F.when(asserts == 0, 0.0).when(
        asserts < 3, 100.0 - (3 - asserts) * 20.0).otherwise(100.0)
    called = F.when((asserts > 0) & ~col(calls_code), density * 0.5).otherwise(density)
    lost = F.least(col(hollow) * 30.0, F.lit(80.0)) + F.least(col(heavy) * 5.0, F.lit(20.0))
    return F.greatest(F.lit(0.0), called - lost)
