"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def identifier_words(name: Column) -> Column:
    """The lower-case words of an identifier: camelCase, ACRONYMWord and snake_case are cut."""
    cut = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(cut), "[^a-z0-9]+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.floor((F.length(text) + 3) / 4).cast("bigint")


def relative_path(path: Column, root: str) -> Column:
    """``path`` below ``root`` with forward slashes; other paths keep theirs."""
    clean = F.translate(path, "\\", "/")
    prefix = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(clean.startswith(prefix), F.substring(clean, F.lit(len(prefix) + 1), F.length(clean))).otherwise(clean)


def slug(text: Column, most: int = 40) -> Column:
    """Lower-case letters and digits with single dashes between, ``most`` characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def first_match(text: Column, needles: list[tuple[str, str]], default: str) -> Column:
    """The label of the first needle that lower-case ``text`` contains; order decides."""
    out = F.lit(default)
    for needle, label in reversed(needles):
        out = F.when(F.contains(F.lower(text), F.lit(needle)), F.lit(label)).otherwise(out)
    return out


def word_usage(text: Column, name: str) -> Column:
    """Whether ``name`` stands in ``text`` as a whole identifier."""
    import re

    return text.rlike(f"(^|[^A-Za-z0-9_]){re.escape(name)}([^A-Za-z0-9_]|$)")


def all_words(text: Column, words: list[str]) -> Column:
    """Whether lower-case ``text`` contains every word of two characters or more."""
    out = F.lit(True)
    for w in words:
        if len(w) >= 2:
            out = out & F.contains(F.lower(text), F.lit(w.lower()))
    return out


def blank_comments(line: Column, marker: str = "#") -> Column:
    """A line whose comment is blanked by spaces, so that offsets stay."""
    at = F.instr(line, F.lit(marker))
    return F.when(at > 0, F.rpad(F.substring(line, F.lit(1), at - 1), F.length(line), " ")).otherwise(line)


def short_signature(signature: Column, owner: Column, width: int = 60) -> Column:
    """A signature without ``def`` and self/cls, its owner in front, cut to ``width``."""
    bare = F.regexp_replace(F.regexp_replace(signature, "^(async )?def ", ""), "\\((self|cls)(, )?", "(")
    full = F.when(owner.isNotNull(), F.concat(owner, F.lit("."), bare)).otherwise(bare)
    return F.when(F.length(full) > width, F.concat(F.substring(full, 1, width - 3), F.lit("..."))).otherwise(full)


def dotted_parent(qualname: Column) -> Column:
    """The qualified name without its last part; null at the top."""
    return F.when(F.contains(qualname, F.lit(".")), F.regexp_replace(qualname, "\\.[^.]*$", ""))


def path_contains(path: Column, folder: Column) -> Column:
    """Containment by path components, not by string prefix."""
    return (path == folder) | path.startswith(F.concat(folder, F.lit("/")))


def selector_matches(selector: Column, labels: Column) -> Column:
    """Whether a non-empty selector's every entry is among the labels."""
    return (F.size(selector) > 0) & F.forall(F.map_entries(selector), lambda e: F.try_element_at(labels, e["key"]).eqNullSafe(e["value"]))
