"""Evidence and raw edges of TypeScript and TSX source, from a small scanner.

There is no grammar here: strings, templates, regular expressions and comments are blanked
(offsets stay), braces are matched, and declarations, imports, exports, call chains and JSX
tags are recognised in what is left. Code of unusual shape may yield less, never a guess.
"""

from __future__ import annotations

import re

from .records import Edge, Node

VERSION = "typescript@1"
SIGNATURE_CHARS, DOC_CHARS = 240, 160
#: The name under which a default import or export is recorded.
DEFAULT = "<default>"
_KEYWORDS = frozenset("if for while switch catch return function typeof new await super import else do try throw delete void in of yield case with instanceof constructor".split())
_NAME = r"[A-Za-z_$][\w$]*"
_REGEX_BEFORE = set("(,=:[!&|?{};+-*%~^<>\n")


def blank(text: str, keep_strings: bool = False) -> str:
    """Comments, regular expressions and the insides of strings as spaces; code in ``${}`` stays."""
    out = list(text)
    i, n, last = 0, len(text), "\n"
    stack: list[str] = []  # open template expressions

    def wipe(a: int, b: int) -> None:
        for k in range(a, b):
            if out[k] != "\n":
                out[k] = " "

    def template(at: int) -> int:
        """Blank template text from ``at``; stops after the closing quote or at an expression."""
        k = at
        while k < n:
            if text[k] == "\\":
                k += 2
            elif text[k] == "`":
                wipe(at, k)
                return k + 1
            elif text.startswith("${", k):
                wipe(at, k)
                stack.append("${")
                return k + 2
            else:
                k += 1
        wipe(at, n)
        return n

    while i < n:
        c = text[i]
        if text.startswith("//", i):
            j = text.find("\n", i)
            j = n if j < 0 else j
            wipe(i, j)
            i = j
        elif text.startswith("/*", i):
            j = text.find("*/", i + 2)
            j = n if j < 0 else j + 2
            wipe(i, j)
            i = j
        elif c in "'\"":
            j = i + 1
            while j < n and text[j] != c and text[j] != "\n":
                j += 2 if text[j] == "\\" else 1
            if not keep_strings:
                wipe(i + 1, min(j, n))
            i, last = j + 1, c
        elif c == "`":
            i, last = template(i + 1), c
        elif c == "/" and last in _REGEX_BEFORE:
            j, bracket = i + 1, False
            while j < n and text[j] != "\n" and (bracket or text[j] != "/"):
                bracket = text[j] == "[" or (bracket and text[j] != "]")
                j += 2 if text[j] == "\\" else 1
            if j < n and text[j] == "/":
                wipe(i + 1, j)
                i, last = j + 1, "/"
            else:
                i, last = i + 1, c
        elif c == "}" and stack and stack[-1] == "${":
            stack.pop()
            i = template(i + 1)
        else:
            if c == "{" and stack:
                stack.append("{")
            elif c == "}" and stack:
                stack.pop()
            if not c.isspace():
                last = c
            i += 1
    return "".join(out)


def _close(code: str, at: int, pairs: str) -> int:
    """The offset of the bracket that closes the one at ``at``; the end if none does."""
    depth = 0
    for i in range(at, len(code)):
        depth += (code[i] == pairs[0]) - (code[i] == pairs[1])
        if depth == 0:
            return i
    return len(code) - 1


_DECLARATIONS = (
    ("class", re.compile(rf"\bclass\s+({_NAME})[^{{;]*\{{")),
    ("function", re.compile(rf"\bfunction\s*\*?\s*({_NAME})\s*(?:<[^>]*>)?\s*\(")),
    ("function", re.compile(rf"\b(?:const|let|var)\s+({_NAME})\s*(?::[^=;]+)?=\s*(?:async\s+)?(?:<[^>]*>\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)(?:\s*:\s*[^=;{{]+?)?|{_NAME})\s*=>")),
    ("function", re.compile(rf"\b(?:const|let|var)\s+({_NAME})\s*(?::[^=;]+)?=\s*(?:async\s+)?function\b\s*\*?\s*(?:{_NAME})?\s*\(")),
)
_METHOD = re.compile(rf"(?:^|[;{{}}\n])[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*(?:\*\s*)?(#?{_NAME})\s*(?:<[^>()]*>)?\s*\(")
_ARROW_FIELD = re.compile(rf"(?:^|[;{{}}\n])[ \t]*(?:(?:public|private|protected|static|readonly)\s+)*({_NAME})\s*(?::[^=;\n]+)?=\s*(?:async\s+)?(?:\([^()]*\)|{_NAME})\s*(?::\s*[^=;{{]+?)?=>")
_IMPORT = re.compile(r"\bimport\b\s*(?:type\s+)?([^'\";]*?)\s*(?:\bfrom\b\s*)?['\"]([^'\"\n]+)['\"]")
_REEXPORT = re.compile(r"\bexport\s*(?:type\s+)?(\*(?:\s+as\s+\w+)?|\{[^}]*\})\s*from\s*['\"]([^'\"\n]+)['\"]")
_DEFAULT_EXPORT = re.compile(rf"\bexport\s+default\s+(?:(?:async\s+)?(?:function\s*\*?|class)\s+)?({_NAME})")
_CALL = re.compile(rf"(?<![\w$.#])((?:this|{_NAME})(?:\s*\??\.\s*#?{_NAME})*)\s*(?:<[\w\s,.\[\]|]*>)?\s*\(")
_JSX = re.compile(rf"<([A-Z][\w$]*(?:\.{_NAME})*)(?=[\s/>])")


class _Def:
    def __init__(self, kind: str, name: str, at: int, end: int) -> None:
        self.kind, self.name, self.at, self.end, self.qual = kind, name, at, end, name


def _body_end(code: str, at: int) -> int:
    """The end of a function whose parameters open at ``at``: its block, or its expression."""
    i = _close(code, at, "()") + 1 if code[at : at + 1] == "(" else at
    brace, stop = code.find("{", i), re.compile(r"[;\n]").search(code, i)
    arrow = re.compile(r"\s*(?::[^{;]*?)?=>\s*(\{)?").match(code, i)
    if arrow:
        return _close(code, arrow.start(1), "{}") if arrow[1] else (stop.start() if stop else len(code))
    if brace >= 0 and not re.search(r"[;]", code[i:brace]):
        return _close(code, brace, "{}")
    return stop.start() if stop else len(code) - 1


def _definitions(code: str) -> list[_Def]:
    found: dict[int, _Def] = {}
    for kind, pattern in _DECLARATIONS:
        for m in pattern.finditer(code):
            if kind == "class":
                end = _close(code, m.end() - 1, "{}")
            elif m[0].rstrip().endswith("=>"):
                brace = re.compile(r"\s*\{").match(code, m.end())
                stop = re.compile(r";|\n(?=\S)").search(code, m.end())
                end = _close(code, brace.end() - 1, "{}") if brace else (stop.start() if stop else len(code) - 1)
            else:
                end = _body_end(code, m.end() - 1)
            found.setdefault(m.start(1), _Def(kind, m[1], m.start(1), end))
    for cls in [d for d in found.values() if d.kind == "class"]:
        body = code.find("{", cls.at)
        for pattern in (_METHOD, _ARROW_FIELD):
            for m in pattern.finditer(code, body, cls.end):
                if m[1] in _KEYWORDS - {"constructor"} or _depth(code, body, m.start(1)) != 1:
                    continue
                if pattern is _METHOD:
                    after = re.compile(r"\s*(?::[^{;=]*)?\{").match(code, _close(code, m.end() - 1, "()") + 1)
                    if not after:
                        continue
                    end = _close(code, after.end() - 1, "{}")
                else:
                    brace = re.compile(r"\s*\{").match(code, m.end())
                    stop = code.find(";", m.end())
                    end = _close(code, brace.end() - 1, "{}") if brace else (stop if stop >= 0 else cls.end)
                found.setdefault(m.start(1), _Def("function", m[1], m.start(1), end))
    defs = sorted(found.values(), key=lambda d: (d.at, -d.end))
    for d in defs:
        holders = [o for o in defs if o is not d and o.at < d.at and d.end <= o.end]
        d.qual = ".".join([*(o.name for o in holders), d.name])
    return defs


def _depth(code: str, a: int, b: int) -> int:
    return code.count("{", a, b) - code.count("}", a, b)


def _named(clause: str) -> list[tuple[str, str]]:
    """(local, original) of an import or export clause in braces."""
    out = []
    for part in clause.strip("{} \n").split(","):
        words = re.sub(r"^\s*type\s+", "", part).split()
        if len(words) == 3 and words[1] == "as":
            out.append((words[2], words[0]))
        elif len(words) == 1:
            out.append((words[0], words[0]))
    return out


def extract(path: str, text: str) -> tuple[list[Node], list[Edge]]:
    """Nodes and raw edges of a file."""
    if not text.strip():
        return [], []
    code, half = blank(text), blank(text, keep_strings=True)
    line = lambda at: code.count("\n", 0, at) + 1
    module = Node(path, "module", None, path, 1, 2, 1.0, name=path.rsplit("/", 1)[-1], qualname="", end_line=text.count("\n") + 1)
    nodes, edges = [module], []
    imported: dict[str, tuple[str, str | None]] = {}
    for m in _IMPORT.finditer(half):
        clause, names = m[1].strip(), []
        brace = re.search(r"\{[^}]*\}", clause)
        for local, original in _named(brace[0]) if brace else []:
            imported[local] = (m[2], original)
            names.append(local)
        rest = clause.replace(brace[0], "") if brace else clause
        for part in filter(None, (p.strip() for p in rest.split(","))):
            star = re.fullmatch(rf"\*\s*as\s+({_NAME})", part)
            if star:
                imported[star[1]] = (m[2], None)
                names.append(star[1])
            elif re.fullmatch(_NAME, part):
                imported[part] = (m[2], DEFAULT)
                names.append(part)
        edges.append(Edge(path, m[2], path, line(m.start()), 2, 1.0, kind="import", module=m[2], names=names))
    defs = _definitions(code)
    for d in defs:
        start = text.rfind("\n", 0, d.at) + 1
        head = text[start : text.find("{", d.at) if 0 <= text.find("{", d.at) <= d.end else min(d.end, d.at + SIGNATURE_CHARS)]
        doc = re.search(r"/\*\*((?:[^*]|\*(?!/))*)\*/\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?\Z", text[:start])
        first = next((w for w in (x.strip(" *\t") for x in doc[1].split("\n")) if w), None) if doc else None
        nodes.append(
            Node(
                f"{path}:{d.qual}", d.kind, None, path, line(d.at), 2, 1.0, name=d.name, qualname=d.qual, end_line=line(d.end),
                signature=" ".join(head.split())[:SIGNATURE_CHARS], doc=first[:DOC_CHARS] if first else None,
            )
        )
    if m := _DEFAULT_EXPORT.search(code):
        module.extra["default_export"] = m[1]
    again = []
    for m in _REEXPORT.finditer(half):
        pairs = [] if m[1].startswith("*") else _named(m[1])
        again.append(m[2] + "=" + ("*" if m[1].startswith("*") else ",".join(f"{alias}:{original}" for alias, original in pairs)))
    if again:
        module.extra["reexports"] = ";".join(again)

    def owner(at: int) -> str:
        inside = [d for d in defs if d.at < at <= d.end]
        return f"{path}:{inside[-1].qual}" if inside else path

    def add(chain: list[str], at: int, via: str | None) -> None:
        hints: dict = {}
        if chain[0] in imported:
            target, name = imported[chain[0]]
            if len(chain) == 1 and name is not None:
                hints = {"alias": True, "module": target, "name": name}
            elif name is None and len(chain) == 2:
                hints = {"alias": True, "module": target, "name": chain[1]}
            else:
                hints = {"alias": True}
        edges.append(Edge(owner(at), ".".join(chain), path, line(at), 2, 1.0, chain=chain, via=via, **hints))

    starts = {d.at for d in defs}
    for m in _CALL.finditer(code):
        chain = [p.strip(" ?\n\t#") for p in m[1].split(".")]
        if chain[0] in _KEYWORDS or m.start(1) in starts or re.search(r"\b(?:function|class)\s*\*?\s*$", code[: m.start(1)]):
            continue
        if len(chain) > 1 and chain[-1] in ("bind", "call", "apply"):
            chain = chain[:-1]
        add(chain, m.start(1), None)
    if path.endswith(("x", "X")):
        for m in _JSX.finditer(code):
            if not re.search(r"[\w$)\]]\s*$", code[max(0, m.start() - 20) : m.start()]) or re.search(r"\breturn\s*$", code[: m.start()]):
                add(m[1].split("."), m.start(1), "jsx")
    return nodes, edges
