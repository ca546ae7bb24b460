"""Chunks of TypeScript, JavaScript and Dart files by a scanner that knows strings, comments and brackets."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import PurePosixPath

from .common import function, outline, row, text_of

WORD = re.compile(r"[A-Za-z_$#][\w$]*")
SPACE = re.compile(r"\s+")
OPEN, CLOSE = "([{", ")]}"
#: After one of these a slash begins a regular expression and no division.
BEFORE_PATTERN = set("(,=:[!&|?{};+-*%<>~^") | {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new"}
NO_CALL = set("if for while switch catch function return typeof super import await yield assert throw in of delete void else do class new with".split())
MODIFIERS = set("public private protected static async readonly override get set declare accessor".split())


@dataclass
class Token:
    text: str
    start: int
    end: int
    line: int
    last: int
    mate: int = -1


def scan(source: str, dart: bool) -> list[Token]:
    """Words, signs and literals; brackets know their mates; comments and blanks are left out."""
    out: list[Token] = []
    stack: list[int] = []
    pos, line, n = 0, 1, len(source)

    def put(text: str, start: int, end: int) -> None:
        nonlocal line
        last = line + source.count("\n", start, end)
        out.append(Token(text, start, end, line, last))
        line = last

    while pos < n:
        c = source[pos]
        if m := SPACE.match(source, pos):
            line += m[0].count("\n")
            pos = m.end()
        elif source.startswith("//", pos):
            end = source.find("\n", pos)
            pos = n if end < 0 else end
        elif source.startswith("/*", pos):
            end = source.find("*/", pos + 2)
            end = n if end < 0 else end + 2
            line += source.count("\n", pos, end)
            pos = end
        elif m := WORD.match(source, pos):
            if dart and m[0] in ("r", "R") and source[m.end() : m.end() + 1] in ("'", '"'):
                end = _string(source, m.end(), True, raw=True)
                put('""', pos, end)
                pos = end
                continue
            put(m[0], pos, m.end())
            pos = m.end()
        elif c in "'\"`":
            end = _string(source, pos, dart)
            put('""', pos, end)
            pos = end
        elif c == "/" and not dart and (not out or out[-1].text in BEFORE_PATTERN):
            end = _pattern(source, pos)
            put('""', pos, end)
            pos = end
        else:
            two = source[pos : pos + 2]
            text = two if two in ("=>", "?.", "??") else c
            if c in OPEN:
                stack.append(len(out))
            elif c in CLOSE and stack:
                at = stack.pop()
                out[at].mate = len(out)
            put(text, pos, pos + len(text))
            pos += len(text)
    return out


def _string(source: str, pos: int, dart: bool, raw: bool = False) -> int:
    """End of the literal that starts at pos; ${...} inside is skipped as a whole."""
    quote = source[pos : pos + 3] if dart and source[pos : pos + 3] in ("'''", '"""') else source[pos]
    at = pos + len(quote)
    holes = quote == "`" or dart and not raw
    while at < len(source):
        if source[at] == "\\" and not raw:
            at += 2
        elif holes and source.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(source) and depth:
                if source[at] in "'\"`":
                    at = _string(source, at, dart)
                    continue
                depth += {"{": 1, "}": -1}.get(source[at], 0)
                at += 1
        elif source.startswith(quote, at):
            return at + len(quote)
        elif source[at] == "\n" and len(quote) == 1 and quote != "`":
            return at  # not closed on its line: it ends there
        else:
            at += 1
    return len(source)


def _pattern(source: str, pos: int) -> int:
    at, inside = pos + 1, False
    while at < len(source) and source[at] != "\n":
        if source[at] == "\\":
            at += 1
        elif source[at] == "[":
            inside = True
        elif source[at] == "]":
            inside = False
        elif source[at] == "/" and not inside:
            m = re.compile(r"[a-z]*").match(source, at + 1)
            return m.end()
        at += 1
    return pos + 1


def skip(t: list[Token], i: int) -> int:
    """The place after token i, or after its mate if it opens a bracket."""
    return t[i].mate + 1 if t[i].text in OPEN and t[i].mate >= 0 else i + 1


def find(t: list[Token], i: int, end: int, wanted: set[str]) -> int:
    """The next of the wanted tokens outside brackets, or end."""
    while i < end and t[i].text not in wanted:
        i = skip(t, i)
    return min(i, end)


def calls(t: list[Token], i: int, end: int, dart: bool) -> list[str]:
    """Names in front of an argument list between i and end."""
    found = []
    for k in range(i, end):
        name = t[k].text
        if k + 1 >= end or t[k + 1].text != "(" or not WORD.fullmatch(name) or name in NO_CALL:
            continue
        before = t[k - 1].text if k > i else ""
        if before in ("new", "function") or dart and name[0].isupper():
            continue
        after = t[k + 1].mate + 1
        if 0 < after < len(t) and t[after].text == "{" and before not in (".", "?.", "await", "=", "(", "return"):
            continue  # a method of an object or a local function, not a call
        found.append(name)
    return found


def statements(t: list[Token], i: int, end: int) -> list[tuple[int, int]]:
    """First and last line of the statements between i and end."""
    out = []
    while i < end:
        start, brace = i, False
        while i < end:
            brace = t[i].text == "{"
            close = i
            i = skip(t, i)
            if t[close].text == ";":
                break
            if brace and (i >= end or t[i].text not in ("else", "catch", "finally", "while", ".", ",", ")", ";", "?.", "=>")):
                break
        last = t[min(i, end) - 1]
        out.append((t[start].line, last.last))
    return out


def parse_script(path: str, source: str, language: str, limit: int) -> list[dict]:
    """Functions, classes and (TypeScript) interfaces at the top of a module, exported or not."""
    t, lines = scan(source, False), source.split("\n")
    imports = []
    i = 0
    while i < len(t):
        if t[i].text == "import" and t[min(i + 1, len(t) - 1)].text not in ("(", "."):
            j = i
            while j < len(t) and t[j].text != ";" and (j == i or t[j].line == t[j - 1].last or t[j - 1].text in ("from", "import", ",")):
                j = skip(t, j)
            imports.append(source[t[i].start : t[min(j, len(t)) - 1].end].strip() + (";" if j < len(t) and t[j].text == ";" else ""))
            i = max(j, i + 1)
        else:
            i = skip(t, i)
    chunks, i, stem = [], 0, PurePosixPath(path).stem
    while i < len(t):
        start, k = i, i
        while k < len(t) and t[k].text in ("export", "default", "async"):
            k += 1
        word = t[k].text if k < len(t) else ""
        exported = t[start].text == "export"
        first = t[k - 1].line if k > start and t[k - 1].text == "async" else t[k].line if k < len(t) else 0
        if word == "function":
            j = k + 1 + (k + 1 < len(t) and t[k + 1].text == "*")
            named = j < len(t) and WORD.fullmatch(t[j].text)
            name = t[j].text if named else stem if exported else "<anonymous>"
            body = find(t, j, len(t), {"{", ";"})
            if body < len(t) and t[body].text == "{" and t[body].mate >= 0:
                end = t[body].mate
                chunks += function(path, language, name, first, t[end].last, lines, None, calls(t, body + 1, end, False), imports, statements(t, body + 1, end), limit)
                i = end + 1
                continue
        elif word in ("class", "interface") and (word == "class" or language == "typescript") and k + 1 < len(t):
            body = find(t, k + 1, len(t), {"{", ";"})
            named = WORD.fullmatch(t[k + 1].text) and t[k + 1].text != "extends"
            if body < len(t) and t[body].text == "{" and t[body].mate >= 0:
                end = t[body].mate
                name = t[k + 1].text if named else "<anonymous>"
                if word == "class":
                    chunks += _script_class(path, language, t, lines, name, t[k].line, body, end, imports, limit)
                else:
                    members = [text_of(lines, a, b).strip() for a, b in _members(t, body + 1, end)]
                    chunks.append(row(path, language, "class", name, t[k].line, t[end].last, text_of(lines, t[k].line, t[end].last), outline=members, imports=imports))
                i = end + 1
                continue
        i = skip(t, max(i, k if k < len(t) else i))
        while i < len(t) and t[i - 1].text not in (";", "}") and t[i].line == t[i - 1].last:
            i = skip(t, i)
    return chunks


def _members(t: list[Token], i: int, end: int) -> list[tuple[int, int]]:
    """Lines of the members of an interface: they end at ; or , or with their line."""
    out, start = [], i
    while i < end:
        at = i
        i = skip(t, i)
        if t[at].text in (";", ",") or i >= end or t[i].line > t[i - 1].last and t[i].text not in ("|", "&", "."):
            out.append((t[start].line, t[i - 1].last))
            start = i
    return out


def _script_class(path, language, t, lines, name, first, body, end, imports, limit) -> list[dict]:
    methods, i = [], body + 1
    while i < end:
        if t[i].text == "@":
            i += 2
            while i < end and t[i].text == ".":
                i += 2
            i = skip(t, i) if i < end and t[i].text == "(" else i
            continue
        start = i
        while i < end and t[i].text in MODIFIERS | {"*"} and i + 1 < end and t[i + 1].text not in ("(", "=", ":", ";", "?", "<"):
            i += 1
        label = t[i].text if WORD.fullmatch(t[i].text) else "<anonymous>"
        k = skip(t, i)
        while k < end and t[k].text in ("?", "!"):
            k += 1
        if k < end and t[k].text == "<":
            depth = 0
            while k < end:
                depth += {"<": 1, ">": -1}.get(t[k].text, 0)
                k += 1
                if not depth:
                    break
        if k < end and t[k].text == "(" and t[k].mate >= 0:
            b = find(t, t[k].mate + 1, end, {"{", ";"})
            if b + 1 < end and t[t[k].mate + 1].text == ":" and t[b].text == "{" and t[b - 1].text == ":":
                b = find(t, skip(t, b), end, {"{", ";"})  # the type itself is in braces
            if b < end and t[b].text == "{" and (t[b].line == t[t[k].mate].line or t[t[k].mate + 1].text in ("{", ":")):
                methods.append((label, start, b, t[b].mate))
                i = t[b].mate + 1
                continue
        # a field, or a method without a body
        i = k
        while i < end and t[i].text != ";" and t[i].line == t[i - 1].last:
            i = skip(t, i)
        i += i < end and t[i].text == ";"
        i = max(i, start + 1)
    signatures = [lines[t[s].line - 1].strip() for _, s, _, _ in methods]
    out = [outline(path, language, name, first, t[end].last, signatures, imports)]
    for label, s, b, e in methods:
        out += function(path, language, label, t[s].line, t[e].last, lines, name, calls(t, b + 1, e, False), imports, statements(t, b + 1, e), limit)
    return out


DART_CONTAINERS = ("class", "mixin", "extension")
DART_BEFORE = {"abstract", "base", "final", "sealed", "interface", "mixin"}


def parse_dart(path: str, source: str, limit: int) -> list[dict]:
    """Classes, mixins and extensions with their members, and functions at the top, of a Dart file."""
    t, lines = scan(source, True), source.split("\n")
    imports, chunks, i = [], [], 0
    k = 0
    while k < len(t):
        if t[k].text in ("import", "export"):
            end = find(t, k, len(t), {";"})
            imports.append(source[t[k].start : t[min(end, len(t) - 1)].end].strip())
            k = end + 1
        else:
            k = find(t, k, len(t), {";", "{"})
            k = skip(t, k) if k < len(t) else k
    while i < len(t):
        start = i
        i = _annotations(t, i)
        k = i
        while k < len(t) and t[k].text in DART_BEFORE and k + 1 < len(t) and (t[k + 1].text in DART_CONTAINERS or t[k + 1].text in DART_BEFORE):
            k += 1
        if k + 1 < len(t) and t[k].text in DART_CONTAINERS and WORD.fullmatch(t[k + 1].text):
            name = t[k + 1].text if t[k + 1].text != "on" else "<anonymous>"
            body = find(t, k + 1, len(t), {"{", ";"})
            if body < len(t) and t[body].text == "{" and t[body].mate >= 0:
                chunks += _dart_class(path, t, lines, name, t[i].line, body, t[body].mate, imports, limit)
                i = t[body].mate + 1
                continue
        if t[i].text == "enum":  # makes no chunk, and is no part of what follows
            body = find(t, i, len(t), {"{", ";"})
            i = t[body].mate + 1 if body < len(t) and t[body].mate >= 0 else body + 1
            continue
        found = _dart_member(t, i, len(t), None)
        if found[0] and found[2] is not None:
            label, end, b, e = found
            chunks += function(path, "dart", label, t[i].line, t[end - 1].last, lines, None, calls(t, b, e, True), imports, statements(t, b, e), limit)
            i = end
            continue
        i = max(found[1], start + 1)
    return chunks


def _annotations(t: list[Token], i: int) -> int:
    while i + 1 < len(t) and t[i].text == "@":
        i += 2
        while i + 1 < len(t) and t[i].text == ".":
            i += 2
        if i < len(t) and t[i].text == "(" and t[i].start == t[i - 1].end:
            i = skip(t, i)
    return i


def _dart_member(t: list[Token], i: int, end: int, owner: str | None) -> tuple[str | None, int, int | None, int | None]:
    """(name or None, place after it, body from, body to) of the member at i; the body is None for a bare constructor."""
    k, name, params = i, None, False
    while k < end:
        x = t[k].text
        if x == "get" and k + 2 < end and WORD.fullmatch(t[k + 1].text) and t[k + 2].text in ("=>", "{", "async", ";"):
            name, params, k = t[k + 1].text, True, k + 2
            continue
        if x == "(" and k > i and not params:
            before = t[k - 1].text
            if before == ">":  # type parameters of the method
                depth, b = 0, k - 1
                while b > i:
                    depth += {">": 1, "<": -1}.get(t[b].text, 0)
                    if not depth:
                        break
                    b -= 1
                before = t[b - 1].text
            name = before if WORD.fullmatch(before) else "<anonymous>"
            params = True
            k = skip(t, k)
            continue
        if x == "=" and not params:  # a field with a value
            k = find(t, k, end, {";"})
            return None, k + 1, None, None
        if x == "=>" and params:
            stop = find(t, k, end, {";"})
            return name, stop + 1, k + 1, stop
        if x == "{" and params:
            close = t[k].mate if t[k].mate >= 0 else end - 1
            return name, close + 1, k + 1, close
        if x == ";":
            made = owner and params and (name == owner or any(t[j].text == owner and t[j + 1].text in (".", "(") for j in range(i, min(k, end - 1))))
            return (name if made else None), k + 1, None, None
        k = skip(t, k)
    return None, end, None, None


def _dart_class(path, t, lines, name, first, body, end, imports, limit) -> list[dict]:
    members, i = [], body + 1
    while i < end:
        start = i
        i = _annotations(t, i)
        if i >= end:
            break
        label, after, b, e = _dart_member(t, i, end, name)
        if label:
            members.append((label, start, i, after, b, e))
        i = max(after, i + 1)
    out = [outline(path, "dart", name, first, t[end].last, [lines[t[s].line - 1].strip() for _, _, s, _, _, _ in members], imports)]
    for label, start, _, after, b, e in members:
        inner = calls(t, b, e, True) if b is not None else []
        parts = statements(t, b, e) if b is not None else []
        out += function(path, "dart", label, t[start].line, t[min(after, end) - 1].last, lines, name, inner, imports, parts, limit)
    return out
