"""What all chunkers share: chunk rows, and splitting of long functions."""

from __future__ import annotations

MAX_LINES = 150


def row(path, language, kind, name, first, last, content, parent="", calls=(), outline=(), imports=()) -> dict:
    return {
        "file_path": path,
        "chunk_type": kind,
        "name": name,
        "line_start": first,
        "line_end": last,
        "content": content,
        "language": language,
        "parent_name": parent,
        "calls": sorted(set(calls)),
        "outline": list(outline),
        "imports": list(imports),
    }


def text_of(lines: list[str], first: int, last: int) -> str:
    return "\n".join(lines[first - 1 : last])


def outline(path, language, name, first, last, signatures, imports) -> dict:
    """A class as the list of its members' first lines."""
    content = "\n".join([f"class {name}:", *(f"  {s}" for s in signatures)]).strip()
    return row(path, language, "class", name, first, last, content, outline=signatures, imports=imports)


def function(path, language, name, first, last, lines, parent, calls, imports, parts, limit) -> list[dict]:
    """A function as one chunk, or as runs of its body's parts of about limit lines.

    parts: (first, last) line of each statement of the body.  A run ends before the part that would take it over
    the limit; a part longer than that is a run of its own.
    """
    kind = "method" if parent else "function"
    make = lambda n, a, b: row(path, language, kind, n, a, b, text_of(lines, a, b), parent or "", calls, (), imports)
    if last - first + 1 <= limit or not parts:
        return [make(name, first, last)]
    runs, size = [], limit + 1
    for a, b in parts:
        n = b - a + 1
        if not runs or size + n > limit:
            runs.append([a, b])
            size = n
        else:
            runs[-1][1] = b
            size += n
    return [make(f"{name}__part{i}", a, b) for i, (a, b) in enumerate(runs, 1)]
