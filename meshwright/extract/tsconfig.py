"""Path aliases of tsconfig.json files: (folder, prefix, target), for imports that are not relative."""

from __future__ import annotations

import json
import posixpath
import re

#: How many ``extends`` are followed.
EXTENDS = 3
ALIAS_SCHEMA = "folder string, prefix string, target string"


def strip_jsonc(text: str) -> str:
    """JSON with comments and trailing commas as plain JSON; strings are left alone."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(\s*[}\]])', lambda m: m[1] or m[2], bare)


def _load(path: str, texts: dict[str, str], hops: int = 0) -> tuple[str, dict]:
    """(base folder, paths) of a configuration, its parents' where it has none of its own."""
    try:
        data = json.loads(strip_jsonc(texts[path]))
    except (KeyError, ValueError):
        return posixpath.dirname(path), {}
    options = data.get("compilerOptions") or {}
    folder = posixpath.dirname(path)
    if options.get("paths"):
        return posixpath.normpath(posixpath.join(folder, options.get("baseUrl", "."))), options["paths"]
    parent = data.get("extends")
    if isinstance(parent, str) and parent.startswith(".") and hops < EXTENDS:
        target = posixpath.normpath(posixpath.join(folder, parent))
        return _load(target if target.endswith(".json") else target + ".json", texts, hops + 1)
    return folder, {}


def aliases(texts: dict[str, str]) -> list[tuple[str, str, str]]:
    """(folder of the tsconfig, prefix, target folder) of ``prefix/*`` to ``dir/*`` entries."""
    out = []
    for path in sorted(p for p in texts if posixpath.basename(p) == "tsconfig.json"):
        base, paths = _load(path, texts)
        for key, targets in paths.items():
            if key.endswith("/*") and targets and str(targets[0]).endswith("/*"):
                target = posixpath.normpath(posixpath.join(base, targets[0][:-2]))
                out.append((posixpath.dirname(path), key[:-1], "" if target == "." else target))
    return out
