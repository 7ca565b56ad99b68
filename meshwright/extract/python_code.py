"""Evidence and raw edges of Python source, from the standard library's syntax tree.

What is emitted for a file: its module, functions and classes (nested names dotted), one
edge for each imported module, and edges for calls, references passed as arguments, base
classes, and methods of values that a module-level call built. Edges carry what resolution
needs: the attribute chain, what the first name was imported as, and the receiver's type
where the code states it.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

from .records import Edge, Node, TypeRef

#: Caps of what is shown of a signature, a docstring's first line and a decorator.
SIGNATURE_CHARS, DOC_CHARS, DECORATOR_CHARS = 240, 160, 160
#: Annotations that only wrap the one class they name.
WRAPPERS = {"Optional", "Union", "Annotated", "Final", "ClassVar"}
VERSION = "python@1"


@dataclass
class Scope:
    """Where the walk is: the owner of what it finds, names bound here, and their types."""

    identity: str
    qualname: str
    is_class: bool = False
    class_name: str | None = None
    bound: set[str] = field(default_factory=set)
    types: dict[str, TypeRef] = field(default_factory=dict)
    outer: Scope | None = None

    def binds(self, name: str) -> bool:
        """Whether a function scope here or outside binds the name (class bodies do not count)."""
        s: Scope | None = self
        while s is not None and s.outer is not None:
            if not s.is_class and name in s.bound:
                return True
            s = s.outer
        return False

    def type_of(self, name: str) -> TypeRef | None:
        s: Scope | None = self
        while s is not None:
            if not s.is_class and name in s.types:
                return s.types[name]
            if not s.is_class and name in s.bound:
                return None
            s = s.outer
        return None


def chain_of(node: ast.expr) -> list[str] | None:
    """``a.b.c`` as its names; None for anything else."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return [node.id, *reversed(names)]
    return None


def names_bound(target: ast.expr) -> list[str]:
    """Names that an assignment target binds; attributes and subscripts bind none."""
    if isinstance(target, ast.Name):
        return [target.id]
    if isinstance(target, ast.Starred):
        return names_bound(target.value)
    if isinstance(target, (ast.Tuple, ast.List)):
        return [n for e in target.elts for n in names_bound(e)]
    return []


def one_line(text: str, most: int) -> str:
    flat = " ".join(text.split())
    return flat if len(flat) <= most else flat[: most - 1] + "…"


class Extractor:
    """Walks one module in source order."""

    def __init__(self, path: str, text: str) -> None:
        self.path, self.text = path, text
        self.nodes: list[Node] = []
        self.edges: list[Edge] = []
        self.imported: dict[str, tuple[str, str | None]] = {}  # local name: (module, name in it or None for the module)
        self.builders: dict[str, list[str]] = {}  # module-level value: chain of the call that made it

    def run(self) -> tuple[list[Node], list[Edge]]:
        if not self.text.strip():
            return [], []
        self.nodes.append(
            Node(self.path, "module", None, self.path, 1, 2, 1.0, name=self.path.rsplit("/", 1)[-1], qualname="", end_line=self.text.count("\n") + 1)
        )
        tree = ast.parse(self.text)
        doc = ast.get_docstring(tree)
        if doc:
            self.nodes[0].doc = one_line(doc.strip().split("\n")[0], DOC_CHARS)
        for s in tree.body:
            if isinstance(s, (ast.Assign, ast.AnnAssign)) and isinstance(s.value, ast.Call):
                made = chain_of(s.value.func)
                targets = s.targets if isinstance(s, ast.Assign) else [s.target]
                if made:
                    for t in targets:
                        if isinstance(t, ast.Name):
                            self.builders[t.id] = made
        top = Scope(self.path, "")
        self.block(tree.body, top)
        return self.nodes, self.edges

    # statements

    def block(self, body: list[ast.stmt], scope: Scope) -> None:
        for s in body:
            self.statement(s, scope)

    def statement(self, s: ast.stmt, scope: Scope) -> None:
        if isinstance(s, ast.Import):
            for a in s.names:
                local = a.asname or a.name.split(".")[0]
                self.imported[local] = (a.name if a.asname else a.name.split(".")[0], None)
                self.import_edge(s, a.name, [a.asname or a.name])
        elif isinstance(s, ast.ImportFrom):
            self.import_from(s)
        elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            self.function(s, scope)
        elif isinstance(s, ast.ClassDef):
            self.class_(s, scope)
        elif isinstance(s, ast.Assign):
            self.visit(s.value, scope)
            kind = self.type_of_value(s.value, scope)
            for t in s.targets:
                self.visit_target(t, scope)
                self.bind(t, scope, kind if isinstance(t, ast.Name) else None)
                self.attribute_type(t, scope, kind)
        elif isinstance(s, ast.AnnAssign):
            if s.value is not None:
                self.visit(s.value, scope)
            kind = self.annotation(s.annotation, scope)
            self.bind(s.target, scope, kind)
            self.attribute_type(s.target, scope, kind)
        elif isinstance(s, (ast.For, ast.AsyncFor)):
            self.visit(s.iter, scope)
            self.bind(s.target, scope, None)
            self.block(s.body, scope)
            self.block(s.orelse, scope)
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            for item in s.items:
                self.visit(item.context_expr, scope)
                if item.optional_vars is not None:
                    self.bind(item.optional_vars, scope, None)
            self.block(s.body, scope)
        elif isinstance(s, (ast.Try, ast.TryStar)):
            self.block(s.body, scope)
            for h in s.handlers:
                if h.type is not None:
                    self.visit(h.type, scope)
                if h.name:
                    scope.bound.add(h.name)
                self.block(h.body, scope)
            self.block(s.orelse, scope)
            self.block(s.finalbody, scope)
        else:
            for child in ast.iter_child_nodes(s):
                if isinstance(child, ast.stmt):
                    self.statement(child, scope)
                elif isinstance(child, ast.expr):
                    self.visit(child, scope)
                elif isinstance(child, ast.match_case):
                    self.block(child.body, scope)

    def import_edge(self, s: ast.stmt, module: str, names: list[str]) -> None:
        self.edges.append(Edge(self.path, module, self.path, s.lineno, 2, 1.0, kind="import", module=module, names=names))

    def import_from(self, s: ast.ImportFrom) -> None:
        module = "." * s.level + (s.module or "")
        for a in s.names:
            if a.name == "*":
                continue
            if s.module is None:  # from . import x: x may be a module of the package
                self.imported[a.asname or a.name] = (module + a.name, None)
            else:
                self.imported[a.asname or a.name] = (module, a.name)
        if s.module is None:
            for a in s.names:
                self.import_edge(s, module + a.name, [a.name])
        else:
            self.import_edge(s, module, [a.name for a in s.names])

    def bind(self, target: ast.expr, scope: Scope, kind: TypeRef | None) -> None:
        for n in names_bound(target):
            scope.bound.add(n)
            if kind is not None and isinstance(target, ast.Name):
                scope.types[n] = kind
            else:
                scope.types.pop(n, None)

    def attribute_type(self, target: ast.expr, scope: Scope, kind: TypeRef | None) -> None:
        """``self.x = ...`` in a method states the type of the class's attribute."""
        if kind is None or scope.class_name is None or not isinstance(target, ast.Attribute):
            return
        if isinstance(target.value, ast.Name) and target.value.id == "self":
            for n in self.nodes:
                if n.identity == f"{self.path}:{scope.class_name}":
                    n.attr_types.setdefault(target.attr, kind)

    def define(self, s, kind: str, scope: Scope, signature: str) -> tuple[Node, str]:
        qual = f"{scope.qualname}.{s.name}" if scope.qualname else s.name
        doc = ast.get_docstring(s)
        node = Node(
            f"{self.path}:{qual}", kind, None, self.path, s.lineno, 2, 1.0, name=s.name, qualname=qual, end_line=s.end_lineno or s.lineno,
            signature=one_line(signature, SIGNATURE_CHARS), doc=one_line(doc.strip().split("\n")[0], DOC_CHARS) if doc else None,
            decorators=[one_line("@" + ast.unparse(d), DECORATOR_CHARS) for d in s.decorator_list],
        )
        self.nodes.append(node)
        return node, qual

    def function(self, s: ast.FunctionDef | ast.AsyncFunctionDef, scope: Scope) -> None:
        word = "async def" if isinstance(s, ast.AsyncFunctionDef) else "def"
        returns = f" -> {ast.unparse(s.returns)}" if s.returns is not None else ""
        node, qual = self.define(s, "function", scope, f"{word} {s.name}({ast.unparse(s.args)}){returns}")
        if s.returns is not None:
            node.returns = self.annotation(s.returns, scope)
        scope.bound.add(s.name)
        inner = Scope(node.identity, qual, class_name=scope.qualname if scope.is_class else scope.class_name, outer=scope)
        for d in s.decorator_list:  # what a decorator calls belongs to the definition
            self.visit(d, inner)
        a = s.args
        for p in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]:
            inner.bound.add(p.arg)
            kind = self.annotation(p.annotation, scope) if p.annotation is not None and p not in (a.vararg, a.kwarg) else None
            if kind is not None:
                inner.types[p.arg] = kind
        for d in [*a.defaults, *filter(None, a.kw_defaults)]:
            self.visit(d, inner, via="param_default")
        self.block(s.body, inner)

    def class_(self, s: ast.ClassDef, scope: Scope) -> None:
        node, qual = self.define(s, "class", scope, f"class {s.name}" + (f"({', '.join(map(ast.unparse, s.bases))})" if s.bases else ""))
        scope.bound.add(s.name)
        inner = Scope(node.identity, qual, is_class=True, class_name=qual, outer=scope)
        for d in s.decorator_list:
            self.visit(d, inner)
        for b in s.bases:
            chain = chain_of(b)
            if chain:
                ref = self.type_ref(chain, scope)
                node.bases.append(ref)
                self.edges.append(Edge(node.identity, ".".join(chain), self.path, s.lineno, 2, 1.0, relation="inherits", chain=chain, receiver=ref))
        for k in s.keywords:
            self.visit(k.value, inner)
        self.block(s.body, inner)

    # types

    def type_ref(self, chain: list[str], scope: Scope) -> TypeRef:
        """A class name as imported from elsewhere, or as a dotted name of this module."""
        if chain[0] in self.imported and not scope.binds(chain[0]):
            module, name = self.imported[chain[0]]
            return TypeRef("bound", ".".join([module, *([name] if name else []), *chain[1:]]))
        return TypeRef("local", ".".join(chain))

    def annotation(self, a: ast.expr | None, scope: Scope) -> TypeRef | None:
        """The one class that an annotation names; None for strings, several or none."""
        found = self.annotated(a, scope)
        return found[0] if found is not None and len(found) == 1 else None

    def annotated(self, a: ast.expr | None, scope: Scope) -> list[TypeRef] | None:
        if a is None or (isinstance(a, ast.Constant) and a.value is None):
            return []
        if isinstance(a, ast.BinOp) and isinstance(a.op, ast.BitOr):
            left, right = self.annotated(a.left, scope), self.annotated(a.right, scope)
            return None if left is None or right is None else left + right
        if isinstance(a, ast.Subscript):
            chain = chain_of(a.value)
            if chain and chain[-1] in WRAPPERS:
                inner = a.slice.elts if isinstance(a.slice, ast.Tuple) else [a.slice]
                if chain[-1] == "Annotated":
                    inner = inner[:1]
                parts = [self.annotated(x, scope) for x in inner]
                return None if any(p is None for p in parts) else [r for p in parts for r in p]
            return None
        chain = chain_of(a)
        return [self.type_ref(chain, scope)] if chain else None

    def type_of_value(self, value: ast.expr, scope: Scope) -> TypeRef | None:
        """The class that a constructor-like call makes, or what a method of self returns."""
        if not isinstance(value, ast.Call):
            return scope.type_of(value.id) if isinstance(value, ast.Name) else None
        chain = chain_of(value.func)
        if not chain:
            return None
        if chain[0] == "self" and len(chain) == 2 and scope.class_name:
            return TypeRef("self_call", chain[1], scope.class_name)
        if scope.binds(chain[0]) and chain[0] not in self.imported:
            return None
        return self.type_ref(chain, scope)

    # expressions

    def visit(self, e: ast.expr, scope: Scope, via: str | None = None) -> None:
        if isinstance(e, ast.Call):
            self.call(e, scope, via)
            return
        if isinstance(e, (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)):
            for g in e.generators:
                self.visit(g.iter, scope, via)
                self.bind(g.target, scope, None)
                for c in g.ifs:
                    self.visit(c, scope, via)
            for x in (e.key, e.value) if isinstance(e, ast.DictComp) else (e.elt,):
                self.visit(x, scope, via)
            return
        for child in ast.iter_child_nodes(e):
            if isinstance(child, ast.expr):
                self.visit(child, scope, via)
            elif isinstance(child, ast.keyword):
                self.visit(child.value, scope, via)

    def visit_target(self, t: ast.expr, scope: Scope) -> None:
        if isinstance(t, (ast.Attribute, ast.Subscript)):
            for child in ast.iter_child_nodes(t):
                if isinstance(child, ast.expr):
                    self.visit(child, scope)

    def call(self, e: ast.Call, scope: Scope, via: str | None) -> None:
        chain = chain_of(e.func)
        if chain:
            self.call_edge(e, chain, scope, via)
        else:
            self.visit(e.func, scope, via)
        for a in [*e.args, *(k.value for k in e.keywords)]:
            inner = a.value if isinstance(a, ast.Starred) else a
            if isinstance(inner, ast.Name):
                self.reference(inner, scope, via)
            else:
                self.visit(inner, scope, via)

    def hints(self, chain: list[str], scope: Scope) -> dict:
        """What the first name was imported as, unless it is bound locally."""
        if chain[0] not in self.imported or scope.binds(chain[0]):
            return {}
        module, name = self.imported[chain[0]]
        if name is None:
            return {"alias": True, "dotted": ".".join([module, *chain[1:]])}
        return {"alias": True, "module": module, "name": name} if len(chain) == 1 else {"alias": True, "dotted": ".".join([module, name, *chain[1:]])}

    def call_edge(self, e: ast.Call, chain: list[str], scope: Scope, via: str | None) -> None:
        edge = Edge(scope.identity, ".".join(chain), self.path, e.lineno, 2, 1.0, chain=chain, via=via, **self.hints(chain, scope))
        if len(chain) >= 2:
            receiver = scope.type_of(chain[0])
            if receiver is not None:
                edge.receiver, edge.rest = receiver, chain[1:]
            elif chain[0] == "self" and len(chain) == 3 and scope.class_name:
                edge.receiver, edge.rest = TypeRef("attribute", chain[1], scope.class_name), chain[2:]
        self.edges.append(edge)
        if len(chain) == 2 and chain[0] in self.builders and not scope.binds(chain[0]) and scope.outer is not None:
            made = self.builders[chain[0]]
            self.edges.append(
                Edge(scope.identity, ".".join(made), self.path, e.lineno, 2, 1.0, relation="built_by", chain=made, value_name=chain[0], **self.hints(made, scope))
            )

    def reference(self, n: ast.Name, scope: Scope, via: str | None) -> None:
        if scope.binds(n.id):
            return
        self.edges.append(Edge(scope.identity, n.id, self.path, n.lineno, 2, 1.0, relation="references", chain=[n.id], via=via, **self.hints([n.id], scope)))


def extract(path: str, text: str) -> tuple[list[Node], list[Edge]]:
    """Nodes and raw edges of a file. A syntax error leaves the module node alone and is raised after."""
    e = Extractor(path, text)
    return e.run()
