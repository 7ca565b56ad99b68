"""The two relations that extractors emit, as Python records and as Spark schemas.

The hot attributes are columns; what only one kind of file has goes to the map ``extra``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple


class TypeRef(NamedTuple):
    """A class: ``bound`` (imported, dotted), ``local`` (of the module), ``self_call`` (what a
    method of ``owner`` returns) or ``attribute`` (of ``owner``)."""

    kind: str
    name: str
    owner: str | None = None


@dataclass
class Node:
    """One observation of an entity."""

    identity: str
    kind: str
    subtype: str | None
    file: str
    line: int | None
    tier: int
    confidence: float
    name: str | None = None
    qualname: str | None = None
    end_line: int | None = None
    signature: str | None = None
    doc: str | None = None
    decorators: list[str] = field(default_factory=list)
    bases: list[TypeRef] = field(default_factory=list)
    attr_types: dict[str, TypeRef] = field(default_factory=dict)
    returns: TypeRef | None = None
    extra: dict[str, str] = field(default_factory=dict)


@dataclass
class Edge:
    """One observed edge; ``dst`` may be only a name until it is resolved."""

    src: str
    dst: str
    file: str
    line: int | None
    tier: int
    confidence: float
    relation: str | None = None
    kind: str | None = None
    module: str | None = None
    name: str | None = None
    dotted: str | None = None
    names: list[str] = field(default_factory=list)
    chain: list[str] = field(default_factory=list)
    alias: bool = False
    via: str | None = None
    value_name: str | None = None
    receiver: TypeRef | None = None
    rest: list[str] = field(default_factory=list)
    extra: dict[str, str] = field(default_factory=dict)


_REF = "struct<kind:string,name:string,owner:string>"
NODE_SCHEMA = (
    "identity string, kind string, subtype string, file string, line int, tier int, confidence double, name string, qualname string, "
    f"end_line int, signature string, doc string, decorators array<string>, bases array<{_REF}>, attr_types map<string,{_REF}>, returns {_REF}, extra map<string,string>"
)
EDGE_SCHEMA = (
    "src string, dst string, file string, line int, tier int, confidence double, relation string, kind string, module string, name string, dotted string, "
    f"names array<string>, chain array<string>, alias boolean, via string, value_name string, receiver {_REF}, rest array<string>, extra map<string,string>"
)
