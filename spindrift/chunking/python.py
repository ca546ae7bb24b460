"""Chunks of Python files by the standard library's parser."""

from __future__ import annotations

import ast
import re

from .common import function, outline

HEAD = re.compile(r"(?:async\s+)?(def|class)\s+(\w+)")


def _calls(node: ast.AST) -> list[str]:
    found = []
    for n in ast.walk(node):
        if isinstance(n, ast.Call):
            if isinstance(n.func, ast.Name):
                found.append(n.func.id)
            elif isinstance(n.func, ast.Attribute):
                found.append(n.func.attr)
    return found


def parse(path: str, source: str, limit: int) -> list[dict]:
    """Functions and classes at the top of the module, without those that are decorated; decorated methods stay out too."""
    lines = source.split("\n")
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return _by_lines(path, lines, limit)
    imports = [ast.get_source_segment(source, n).strip() for n in tree.body if isinstance(n, ast.Import | ast.ImportFrom)]
    plain = lambda n: isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef) and not n.decorator_list

    def of(node, parent) -> list[dict]:
        parts = [(n.lineno, n.end_lineno) for n in node.body]
        return function(path, "python", node.name, node.lineno, node.end_lineno, lines, parent, _calls(node), imports, parts, limit)

    chunks = []
    for node in tree.body:
        if plain(node):
            chunks += of(node, None)
        elif isinstance(node, ast.ClassDef) and not node.decorator_list:
            methods = [n for n in node.body if plain(n)]
            signatures = [lines[n.lineno - 1].strip() for n in methods]
            chunks.append(outline(path, "python", node.name, node.lineno, node.end_lineno, signatures, imports))
            for n in methods:
                chunks += of(n, node.name)
    return chunks


def _by_lines(path: str, lines: list[str], limit: int) -> list[dict]:
    """For a file that doesn't parse: what starts at the margin with def or class, up to the next line at the margin."""
    chunks = []
    margin = [i for i, x in enumerate(lines) if x.strip() and not x[0].isspace() and not x.startswith(("#", ")", "]", "}"))] + [len(lines)]
    for at, end in zip(margin, margin[1:], strict=False):
        m = HEAD.match(lines[at])
        if not m:
            continue
        while end > at + 1 and not lines[end - 1].strip():
            end -= 1
        calls = re.findall(r"(\w+)\s*\(", "\n".join(lines[at + 1 : end]))
        if m[1] == "def":
            chunks += function(path, "python", m[2], at + 1, end, lines, None, calls, [], [], limit)
        else:
            inner = [x.strip() for x in lines[at + 1 : end] if HEAD.match(x.strip()) and x.strip().startswith(("def", "async"))]
            chunks.append(outline(path, "python", m[2], at + 1, end, inner, []))
    return chunks
