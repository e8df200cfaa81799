"""Other languages brought to markup and plain style sheets before they are read.

Foreign syntax is blanked out in place, so lines (and, but for component names and
expressions in their line, columns) stay. A dialect is named by a file's extension.

``markdown``: front matter, fenced and inline code. ``mdx``: those, imports, exports and
expressions. ``astro``: front matter and expressions. ``php`` and ``erb``: the code
blocks. ``svg``, ``xhtml``: nothing. ``jsx``: everything but JSX elements; ``className``
and ``htmlFor`` become the attributes they stand for, literal values stay, other
expressions become a value in braces, and components (names with a capital or a dot) get
the prefix ``x-`` so they are no native elements. ``scss`` and ``less``: line comments
go, variables are replaced, nested rules get their whole selector, and a mixin's declarations
stand in the line that includes it, with its arguments; mixins that take a block are left out.
"""

from __future__ import annotations

import re

#: Extension -> dialect of markup, and of style sheets.
MARKUP = {"html": "", "htm": "", "xhtml": "", "svg": "", "erb": "erb", "php": "php", "phtml": "php", "md": "markdown", "markdown": "markdown", "mkdn": "markdown", "mdx": "mdx", "astro": "astro", "jsx": "jsx", "tsx": "jsx"}
SHEETS = {"css": "", "scss": "scss", "less": "less"}


def blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def without(pattern: str, source: str, flags: int = 0) -> str:
    return re.sub(pattern, lambda m: blank(m[0]), source, flags=flags)


def braces(source: str, start: int) -> int:
    """Place behind the brace that closes the one at ``start``; strings and comments are stepped over."""
    depth, at = 0, start
    while at < len(source):
        c = source[at]
        if c in "\"'`":
            at = string_end(source, at)
            continue
        if source.startswith("/*", at):
            at = max(source.find("*/", at + 2), at) + 2
            continue
        depth += (c == "{") - (c == "}")
        at += 1
        if depth == 0:
            return at
    return len(source)


def string_end(source: str, start: int) -> int:
    quote, at = source[start], start + 1
    while at < len(source) and source[at] != quote:
        if source[at] == "\n" and quote != "`":
            return at
        at += 2 if source[at] == "\\" else 1
    return at + 1


def markdown(source: str) -> str:
    source = without(r"\A---\s*\n.*?\n---\s*(?=\n|\Z)", source, re.S)
    source = without(r"^([ \t]*)(```+|~~~+)[^\n]*\n.*?(^[ \t]*\2|\Z)", source, re.S | re.M)
    return without(r"(`+)[^`].*?\1", source)


def mdx(source: str) -> str:
    return jsx(without(r"^(import|export)\s[^\n]*$", markdown(source), re.M), 1)


def astro(source: str) -> str:
    return jsx(without(r"\A---\s*\n.*?\n---\s*(?=\n|\Z)", source, re.S), 1)


def php(source: str) -> str:
    return without(r"<\?(php|=)?.*?(\?>|\Z)", source, re.S)


def erb(source: str) -> str:
    return without(r"<%.*?(%>|\Z)", source, re.S)


_TAG = re.compile(r"<(/?)([A-Za-z][\w.:-]*)?")
_NAME = re.compile(r"[A-Za-z_][\w:-]*")
_BEFORE = re.compile(r"(^|[(,=?:&|{}>;\[]|\breturn|\bdefault|=>)\s*$")
_LITERAL = re.compile(r"\{\s*(?:\"([^\"\n]*)\"|'([^'\n]*)'|`([^`$\n]*)`|(-?\d+(?:\.\d+)?)|(true))\s*\}")


def jsx(source: str, least: int = 0) -> str:
    """The markup of a script, everything else blank; ``least`` 1: of a template, whose
    text outside elements stays too."""
    out: list[str] = []
    at, depth, kept = 0, least, 0  # depth: open elements
    while at < len(source):
        c = source[at]
        if depth == 0 and c in "\"'`":
            end = string_end(source, at)
            out.append(blank(source[at:end]))
            at = end
        elif depth == 0 and source.startswith("//", at):
            end = source.find("\n", at)
            end = len(source) if end < 0 else end
            out.append(blank(source[at:end]))
            at = end
        elif source.startswith("/*", at) and depth == 0:
            end = source.find("*/", at + 2)
            end = len(source) if end < 0 else end + 2
            out.append(blank(source[at:end]))
            at = end
        elif c == "{" and depth:
            end = braces(source, at)
            out.append(" " + jsx(source[at + 1 : end - 1]) + " ")
            at = end
        elif c == "<" and (depth or _BEFORE.search(source[max(kept, at - 40) : at])) and (m := _TAG.match(source, at)) and (m[2] or source.startswith((">", "/>"), at + 1)):
            text, end, closed = element(source, m)
            out.append(text)
            depth += -1 if m[1] else 0 if closed else 1
            at = kept = end
            depth = max(depth, least)
        else:
            out.append(c if depth or c == "\n" else " ")
            at += 1
    return "".join(out)


def element(source: str, m: re.Match) -> tuple[str, int, bool]:
    """One tag as markup, the place behind it, and whether it closes itself."""
    name, at = m[2], m.end()
    if name is None:  # a fragment
        end = source.index(">", at) + 1
        return blank(source[m.start() : end]), end, False
    out = [m[0] if not (name[0].isupper() or "." in name) else f"<{m[1]}x-{name.lower()}"]
    while at < len(source):
        c = source[at]
        if c == ">":
            return "".join([*out, ">"]), at + 1, False
        if source.startswith("/>", at):
            return "".join([*out, "/>"]), at + 2, True
        if c == "{":  # spread
            end = braces(source, at)
            out.append(blank(source[at:end]))
            at = end
        elif n := _NAME.match(source, at):
            word = {"className": "class    ", "htmlFor": "for    "}.get(n[0], n[0])
            out.append(word)
            at = n.end()
            space = re.compile(r"\s*=\s*").match(source, at)
            if not space:
                continue
            out.append(space[0])
            at = space.end()
            if at < len(source) and source[at] in "\"'":
                end = source.find(source[at], at + 1)
                end = len(source) if end < 0 else end + 1
                out.append(source[at:end])
                at = end
            elif at < len(source) and source[at] == "{":
                if literal := _LITERAL.match(source, at):
                    value = next(x for x in literal.groups() if x is not None)
                    out.append(f'"{value}"'.ljust(literal.end() - at) if '"' not in value else f"'{value}'")
                    at = literal.end()
                else:
                    end = braces(source, at)
                    out.append('"{' + re.sub(r"[\"<>]", " ", source[at + 1 : end - 1]) + '}"')
                    at = end
        else:
            out.append(c)
            at += 1
    return "".join(out), at, True


def markup(source: str, dialect: str) -> str:
    return {"": lambda s: s, "markdown": markdown, "mdx": mdx, "astro": astro, "php": php, "erb": erb, "jsx": jsx}[dialect](source)


_MIXINS = {
    "scss": (r"@mixin\s+([\w-]+)\s*(?:\(([^)]*)\))?\s*\{", r"@include\s+([\w-]+)\s*(?:\(((?:[^;{}()]|\([^()]*\))*)\))?\s*;"),
    "less": (r"(?<![\w-])[.#]([\w-]+)\s*\(([^){}]*)\)\s*\{", r"(?<![\w-])[.#]([\w-]+)\s*\(((?:[^;{}()]|\([^()]*\))*)\)\s*;"),
}


def _arguments(text: str | None) -> list[str]:
    return [x.strip() for x in re.split(r"[,;](?![^(]*\))", text or "") if x.strip()]


def included(source: str, dialect: str) -> str:
    """Calls of mixins replaced, in their line, by the declarations of the mixin. A mixin that
    includes others is followed eight deep, so one that includes itself ends."""
    definition, call = _MIXINS[dialect]
    known: dict[str, tuple[list[str], str]] = {}
    for m in re.finditer(definition, source):
        body = source[m.end() : braces(source, m.end() - 1) - 1]
        if "@content" not in body:
            known[m[1]] = (_arguments(m[2]), " ".join(body.split()))

    def filled(m: re.Match) -> str:
        if m[1] not in known:
            return m[0]
        names, body = known[m[1]]
        values, given = {}, _arguments(m[2])
        for i, name in enumerate(names):
            own, _, default = (x.strip() for x in name.partition(":"))
            named = next((g.partition(":")[2].strip() for g in given if re.match(re.escape(own) + r"\s*:", g)), None)
            values[own] = named or (given[i] if i < len(given) and not re.match(r"[$@][\w-]+\s*:", given[i]) else default)
        for own, value in sorted(values.items(), key=lambda x: -len(x[0])):
            body = re.sub(re.escape(own) + r"(?![\w-])", lambda _, v=value: v, body)
        return body.rstrip("; ") + "; "

    for _ in range(8):
        new = re.sub(call, filled, source)
        if new == source or len(new) > 4 * len(source) + 100_000:
            break
        source = new
    return source


_PART = re.compile(r"((?:[^{};\"']|\"[^\"\n]*\"|'[^'\n]*'|#\{[^}]*\})*)([{};]|\Z)", re.S)


def sheet(source: str, dialect: str) -> str:
    """A nested sheet as a plain one; every declaration stays in its line."""
    if not dialect:
        return source
    source = without(r"/\*.*?(\*/|\Z)", source, re.S)
    source = without(r"(?<![:\w])//[^\n]*", source)
    source = included(source, dialect)
    mark = "$" if dialect == "scss" else "@"
    known = {name: value.strip() for name, value in re.findall(rf"^\s*\{mark}([\w-]+)\s*:\s*([^;{{}}]+);", source, re.M) if not (mark == "@" and name in ("media", "import", "charset", "supports"))}

    def value_of(text: str, left: int = 8) -> str:
        new = re.sub(rf"\{mark}\{{?([\w-]+)\}}?|#\{{\${{0,1}}([\w-]+)\}}", lambda m: known.get(m[1] or m[2], m[0]), text)
        return new if new == text or not left else value_of(new, left - 1)

    out: list[str] = []
    stack: list[tuple[str, str]] = []  # (kind, selector or at-rule)
    opened, shut = None, ""  # the block that is being written, and what ends it
    blocks = 0
    numbers: list[int] = []
    for m in _PART.finditer(source):
        head, end = m[1], m[2]
        own = head.strip()
        if end == "{":
            out.append("\n" * head.count("\n"))
            outer = next((s for kind, s in reversed(stack) if kind == "rule"), "")
            if own.startswith(("@mixin", "@function")) or (dialect == "less" and re.match(r"[.#][\w-]+\(.*\)$", own, re.S)):
                stack.append(("mixin", own))
            elif own.startswith(("@include", "@if", "@else", "@each", "@for", "@while")):
                stack.append(("flat", own))
            elif own.startswith("@"):
                stack.append(("at", " ".join(value_of(own).split())))
            else:
                parts = [" ".join(value_of(p).split()) for p in own.split(",")]
                whole = [p.replace("&", o) if "&" in p else f"{o} {p}".strip() for o in (outer.split(", ") if outer else [""]) for p in parts]
                stack.append(("rule", ", ".join(whole)))
            blocks += 1
            numbers.append(blocks)
            continue
        before = head[: len(head) - len(head.lstrip())].count("\n")
        out.append("\n" * before)
        rule = next((s for kind, s in reversed(stack) if kind == "rule"), None)
        if own and rule is not None and ":" in own and not own.startswith(("@", "$")) and not any(kind == "mixin" for kind, _ in stack):
            if opened != numbers[-1]:
                around = [s for kind, s in stack if kind == "at"]
                out.append(shut + "".join(f"{a} {{ " for a in around) + f"{rule} {{ ")
                opened, shut = numbers[-1], "} " + "} " * len(around)
            out.append(value_of(" ".join(own.split())) + "; ")
        out.append("\n" * (head.count("\n") - before))
        if end == "}" and stack:
            stack.pop()
            numbers.pop()
    return "".join([*out, shut])
