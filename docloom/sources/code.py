"""Symbols, edges and reference texts of Python files, read by the language's own parser in Arrow batches."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.documents import each_text

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def parsed(text: str | None) -> ast.Module | None:
    """The tree of a module; None if it doesn't parse."""
    try:
        return ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def signature(f: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    a = f.args
    star = [f"*{a.vararg.arg}"] if a.vararg else []
    named = [f"**{a.kwarg.arg}"] if a.kwarg else []
    return f"{f.name}({', '.join([x.arg for x in (*a.posonlyargs, *a.args)] + star + [x.arg for x in a.kwonlyargs] + named)})"


def opening(node: ast.AST) -> str:
    """The first paragraph of a docstring."""
    return (ast.get_docstring(node) or "").strip().split("\n\n")[0].strip()


def _symbols(path: str, text: str | None) -> Iterator[tuple]:
    def walk(body: list[ast.stmt], owner: str | None, kind: str) -> Iterator[tuple]:
        for node in body:
            if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
                name = f"{owner}.{node.name}" if owner else node.name
                is_class = isinstance(node, ast.ClassDef)
                yield path, name, f"{node.name}" if is_class else f".{node.name}()" if kind == "method" else f"{node.name}()", "class" if is_class else kind, owner, node.lineno, node.end_lineno or node.lineno, node.name if is_class else signature(node), opening(node)
                yield from walk(node.body, name, "method" if is_class else "nested")

    tree = parsed(text)
    if tree is not None:
        yield from walk(tree.body, None, "function")


def symbols(files: DataFrame) -> DataFrame:
    """(path, name, label, kind, owner, first, last, signature, doc) of the classes, functions, methods and nested functions of
    Python files (path, text), dotted by what they stand in. Files that don't parse have none."""
    kind = "path string, name string, label string, kind string, owner string, first int, last int, signature string, doc string"
    return each_text(files.filter(F.col("path").endswith(".py")), ["path", "text"], kind, _symbols)


def _reference(path: str, text: str | None) -> Iterator[tuple]:
    tree = parsed(text)
    if tree is None:
        return
    module = path.removesuffix(".py").replace("/", ".").removesuffix(".__init__")
    parts = [f"# Module `{module}`", opening(tree)]
    public = [n for n in tree.body if isinstance(n, (*_FUNCTIONS, ast.ClassDef)) and not n.name.startswith("_")]
    for node in public:
        if isinstance(node, ast.ClassDef):
            bases = [f"`{b.id}`" for b in node.bases if isinstance(b, ast.Name)]
            parts += [f"## class `{module}.{node.name}`" + (f", a subclass of {', '.join(bases)}" if bases else ""), opening(node)]
            listed = [(m, opening(m).split("\n")[0]) for m in node.body if isinstance(m, _FUNCTIONS) and not m.name.startswith("_")]
            parts.append("\n".join(f"- `{node.name}.{signature(m)}`" + (f": {said}" if said else "") for m, said in listed))
        else:
            parts += [f"## `{module}.{signature(node)}`", opening(node)]
    if public:
        yield path, "\n\n".join(x for x in parts if x)


def api_reference(files: DataFrame) -> DataFrame:
    """(path, text): a reference in Markdown of each module's public names, with signatures and the first paragraph of what
    is said on them. Modules without any give none."""
    return each_text(files.filter(F.col("path").endswith(".py")), ["path", "text"], "path string, text string", _reference)


def slice_of(text: Column, first: Column, most: int = 60) -> Column:
    """Up to `most` lines of a text from the line `first` (from 1; null: the beginning)."""
    return F.array_join(F.slice(F.split(text, "\r\n|\r|\n"), F.greatest(F.coalesce(first, F.lit(1)), F.lit(1)), most), "\n")


def dotted(path: Column) -> Column:
    """The module of a Python file."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def imported(module: Column, is_package: Column, level: Column, name: Column) -> Column:
    """The module that an import with `level` leading dots names, seen from a module; null above the top."""
    parts = F.split(module, r"\.")
    up = F.size(parts) - level + F.when(is_package, 1).otherwise(0)
    base = F.when(up > 0, F.array_join(F.slice(parts, 1, F.greatest(up, F.lit(1))), "."))
    rest = F.coalesce(name, F.lit(""))
    return F.when(level == 0, name).when(rest == "", base).otherwise(F.concat(base, F.lit("."), rest))
