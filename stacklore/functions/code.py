"""Column functions that read source code without a parser."""

from functools import reduce

from pyspark.sql import Column, functions as F

from stacklore import constants as K
from stacklore.functions.text import col

_PAIRS = {")": "(", "]": "[", "}": "{"}


def brackets_balanced(code) -> Column:
    """True when (), [] and {} nest properly; the fold carries the open ones."""
    marks = F.split(F.regexp_replace(col(code), r"[^()\[\]{}]", ""), "")

    def step(stack, mark):
        closes = reduce(
            lambda acc, p: acc.when((mark == p[0]) & stack.endswith(p[1]),
                                    F.left(stack, F.length(stack) - 1)),
            list(_PAIRS.items())[1:],
            F.when((mark == ")") & stack.endswith("("), F.left(stack, F.length(stack) - 1)),
        )
        # "!" marks a failure: nothing pops it, so the result cannot be empty.
        return closes.when(mark.isin("(", "[", "{"), F.concat(stack, mark)).when(
            mark == "", stack).otherwise(F.concat(stack, F.lit("!")))

    return F.aggregate(marks, F.lit(""), step) == ""


def structural_score(code) -> Column:
    return F.when(brackets_balanced(code), 100.0).otherwise(0.0)


def js_dependencies(code) -> Column:
    quoted = r"""['"]([^'"./][^'"]*)['"]"""
    found = F.concat(*[
        F.regexp_extract_all(col(code), F.lit(head + quoted + tail), F.lit(1))
        for head, tail in ((r"from\s+", ""), (r"require\s*\(\s*", r"\s*\)"), (r"import\s+", ""))
    ])

    def package(path):
        scoped = path.startswith("@")
        return F.when(scoped, F.substring_index(path, "/", 2)).otherwise(
            F.substring_index(path, "/", 1))

    return clean_dependencies(F.transform(found, package))


def python_dependencies(code) -> Column:
    """Line-start imports, for source that does not parse."""
    return clean_dependencies(F.regexp_extract_all(
        col(code), F.lit(r"(?md)^(?:import|from)\s+([a-zA-Z0-9_]+)"), F.lit(1)))


def clean_dependencies(names) -> Column:
    builtin = F.array(*[F.lit(x) for x in K.BUILTIN_DEPENDENCIES])
    return F.array_sort(F.array_except(F.array_distinct(names), builtin))


def package_key(name) -> Column:
    return F.replace(F.lower(col(name)), F.lit("_"), F.lit("-"))


def requirement_packages(text) -> Column:
    """Package names of a requirements file."""
    lines = F.transform(F.split(col(text), r"\r?\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("-"))
    names = F.transform(kept, lambda x: F.regexp_extract(x, r"^([a-zA-Z0-9_\-]+)", 1))
    return F.array_distinct(F.transform(F.filter(names, lambda x: x != ""), package_key))


def toml_packages(text) -> Column:
    """Package names in the ``dependencies = [...]`` lists of a project file."""
    blocks = F.regexp_extract_all(
        col(text), F.lit(r"dependencies\s*=\s*\[([\s\S]*?)\]"), F.lit(1))
    names = F.transform(blocks, lambda b: F.regexp_extract_all(
        b, F.lit(r"""["']([^">=<!\s\[]+)"""), F.lit(1)))
    return F.array_distinct(F.transform(F.flatten(names), package_key))


def assertion_count(test, language) -> Column:
    """Assertions of non-Python tests.

    Only the captured group is looked at when deciding whether an assertion is
    a constant one, so ``assertTrue`` never counts and ``expect(true)`` does.
    """
    language = F.lower(col(language))

    def count(pattern, group):
        hits = F.regexp_extract_all(col(test), F.lit(pattern), F.lit(group))
        constant = r"true|false|1==1|1 == 1"
        return F.size(F.filter(
            hits, lambda h: ~(F.lower(h).rlike(constant) & (F.length(h) < 20))))

    chain = None
    for name, (pattern, group) in K.ASSERTION_PATTERNS.items():
        value = count(pattern, group)
        hit = language == name
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return F.coalesce(chain.otherwise(count(*K.DEFAULT_ASSERTION_PATTERN)), F.lit(0))


def sql_injection_findings(code) -> Column:
    """array<struct<lineno, message>>: one entry per (line, pattern) that hits."""
    def messages(line, index):
        hits = [
            F.when(line.rlike(pattern), F.struct(
                (index + 1).cast("int").alias("lineno"),
                F.lit(f"Potential SQL injection detected: {what}").alias("message")))
            for pattern, what in K.SQL_INJECTION_PATTERNS
        ]
        return F.array_compact(F.array(*hits))

    return F.flatten(F.transform(F.split(col(code), "\n"), messages))


def secret_names(text) -> Column:
    """Names that a text assigns a quoted value of five or more characters."""
    return F.regexp_extract_all(col(text), F.lit(K.SECRET_TEXT_PATTERN), F.lit(1))
