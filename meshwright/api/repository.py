"""A repository as tables, and the views over them: find, show, trace, map, context, diagram.

Queries run as Spark plans; what a view prints is a bounded number of rows, folded into text
on the driver under a token budget.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..extract.scan import Extractor, scan_files
from ..extract.tsconfig import ALIAS_SCHEMA, aliases
from ..functions.text import all_words, identifier_words, short_signature, slug, token_estimate, word_usage
from ..operators import code_graph as C
from ..operators import graph as G
from ..operators import search as S
from ..operators.cache import diff
from ..operators.components import connected_components
from ..operators.storage import materialize
from ..sources.files import files_from_texts, repository_files
from ..sources.lines import lines

#: Budgets of the views in tokens, and how many rows of a kind they show.
SHOW, MAP, FIND, TRACE, PACK = 2000, 1500, 400, 800, 6000
CALLERS, CALLEES, USAGES, PHRASES, CANDIDATES, TINY_LINES, SNIPPET_LINES = 12, 30, 15, 5, 10, 3, 80
#: Symbols of one comma-separated call of show.
MULTI = 4
#: A module of so many lines is shown whole; names of each kind in an outline; levels of overriding.
MODULE_LINES, OUTLINE_NAMES, OVERRIDE_LEVELS, OVERRIDES = 120, 8, 4, 10
#: Methods of built-in values: a call of one of these on something else says nothing about the repository.
BUILT_IN_METHODS = frozenset(m for t in (str, bytes, list, dict, set, int, float) for m in dir(t) if not m.startswith("_"))
#: A decorator that makes a route: its receiver, verb and path; a router with a prefix.
ROUTE = r"^@?([\w.]+)\.(get|post|put|patch|delete|head|options|route|api_route)\(\s*['\"]([^'\"]*)"
ROUTER = r"^(\w+)\s*=\s*[\w.]*(?:Router|Blueprint)\(.*?\b(?:url_)?prefix\s*=\s*['\"]([^'\"]*)"
LADDER = [(12, 25), (8, 20), (6, 15), (4, 12), (3, 10), (2, 8), (1, 6), (1, 3)]
#: Functions come before classes, those before modules.
_KIND_ORDER = "case kind when 'function' then 0 when 'class' then 1 else 2 end"


def tokens_of(text: str) -> int:
    return (len(text) + 3) // 4


def fit(parts: list[str], budget: int) -> str:
    """Lines in order while they fit the budget; a note counts those left out."""
    out, used = [], 0
    for i, p in enumerate(parts):
        cost = len(p) + 1
        if used + cost > (budget - 12) * 4:
            out.append(f"... {len(parts) - i} more lines")
            break
        out.append(p)
        used += cost
    return "\n".join(out)


class Repository:
    """Tables of one repository snapshot; each is computed when first asked for."""

    def __init__(self, spark: SparkSession, root: str | None = None, texts: dict[str, str] | None = None, extractors: list[Extractor] | None = None, cache: str | None = None) -> None:
        if (root is None) == (texts is None):
            raise ValueError("give a folder or texts")
        self.spark, self.root, self.texts, self.extractors, self.cache = spark, root, texts, extractors, cache

    @cached_property
    def files(self) -> DataFrame:
        found = repository_files(self.spark, self.root) if self.root is not None else files_from_texts(self.spark, self.texts)
        return materialize(found.drop("content"), "files")

    @cached_property
    def scanned(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return scan_files(self.files, self.extractors, self.cache)

    @cached_property
    def resolved(self) -> tuple[DataFrame, DataFrame]:
        # only configurations: a repository has a handful
        config = (F.col("ext") == "json") & ((F.col("name") == "tsconfig.json") | F.contains("text", F.lit('"compilerOptions"')))
        configs = {r.rel_path: r.text for r in self.files.where(config).select("rel_path", "text").collect()}
        paths = aliases(configs)
        nodes, edges = C.resolve(self.scanned[0], self.scanned[1], self.spark.createDataFrame(paths, ALIAS_SCHEMA) if paths else None)
        return nodes, materialize(edges, "resolved")

    @property
    def nodes(self) -> DataFrame:
        return self.resolved[0]

    @property
    def edges(self) -> DataFrame:
        return self.resolved[1]

    @cached_property
    def symbols(self) -> DataFrame:
        return materialize(C.symbols(self.nodes), "symbols")

    @cached_property
    def links(self) -> DataFrame:
        return materialize(C.links(self.edges, self.symbols), "code-links")

    @cached_property
    def graph(self) -> DataFrame:
        """(src, dst, relation, file, line) of all kept edges, containment included."""
        own = self.edges.where("target is not null").select("src", F.col("target").alias("dst"), F.col("relation_name").alias("relation"), "file", "line")
        return materialize(own.unionByName(C.containment(self.nodes)), "graph")

    @cached_property
    def components(self) -> DataFrame:
        """(node, component) of the graph, edges taken both ways."""
        return materialize(connected_components(self.graph), "components")

    @cached_property
    def lines(self) -> DataFrame:
        return lines(self.files, "rel_path", "text")

    @cached_property
    def routes(self) -> DataFrame:
        """(id, method, path) of route handlers, the router's prefix included; a route of any verb is ANY."""
        d = F.explode("decorators").alias("d")
        at = self.symbols.where("decorators is not null").select("id", "file", d).where(F.col("d").rlike(ROUTE))
        part = lambda i: F.regexp_extract("d", ROUTE, i)
        at = at.select("id", "file", part(1).alias("router"), part(2).alias("verb"), part(3).alias("own"))
        prefix = self.lines.where(F.col("line").rlike(ROUTER)).select(F.col("rel_path").alias("file"), F.regexp_extract("line", ROUTER, 1).alias("router"), F.regexp_extract("line", ROUTER, 2).alias("prefix"))
        method = F.when(F.col("verb").isin("route", "api_route"), "ANY").otherwise(F.upper("verb"))
        found = at.join(prefix, ["file", "router"], "left").groupBy("id").agg(F.min(F.struct(method.alias("method"), F.concat(F.coalesce("prefix", F.lit("")), "own").alias("path"))).alias("r"))
        return materialize(found.select("id", "r.*"), "routes")

    @cached_property
    def inheritance(self) -> DataFrame:
        """(node, ancestor, depth) of classes, a few levels deep."""
        return materialize(G.closure(self.links.where("relation = 'inherits'"), OVERRIDE_LEVELS), "inheritance")

    def overrides(self, symbol) -> tuple[list[str], list[str]]:
        """Members of the same name in a method's base classes, nearest first, and in its subclasses."""
        def named(own: str, other: str, most: int) -> list[str]:
            classes = self.inheritance.where(F.col(own) == symbol.parent).select(F.col(other).alias("parent"), "depth")
            got = self.symbols.where((F.col("name") == symbol.name) & (F.col("kind") == "function")).join(classes, "parent")
            return [r.id for r in got.orderBy("depth", "id").select("id").limit(most).collect()]

        return named("node", "ancestor", 1), named("ancestor", "node", OVERRIDES)

    def changed_since(self, old: Repository) -> DataFrame:
        """(rel_path, status) against an older snapshot."""
        return diff(old.files, self.files, "rel_path", "text").where("status <> 'same'")

    # summaries

    def scan(self) -> dict:
        """Counts of the build."""
        unresolved = self.edges.where("target is null and coalesce(relation, '') not in ('references', 'built_by')")
        return {
            "files": self.files.count(), "nodes": self.nodes.count(), "edges": self.graph.count(), "unresolved": unresolved.count(), "errors": self.scanned[2].count(),
        }

    # find

    def ranked(self, query: str) -> DataFrame:
        """(id, score, kind, degree) of symbols that match the words of a query, best first."""
        words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", query).lower()) if w]
        if not words:
            return self.symbols.limit(0).select("id", F.lit(0.0).alias("score"), "kind", F.lit(0).alias("degree"))
        fields = {
            "name": F.col("name"), "qual": F.col("qualname"), "file": F.regexp_replace(F.substring_index("file", "/", -1), "\\.[a-z]+$", ""),
            "doc": F.col("doc"), "dir": F.regexp_replace("file", "[^/]*$", ""), "route": F.array_join(F.coalesce("decorators", F.array()), " "),
        }
        score = S.fuzzy_score(fields, words) * F.when(F.col("kind") == "module", 0.8).otherwise(1.0)
        hits = self.symbols.withColumn("score", score).where("score > 0").join(G.degree(self.links), "id", "left").fillna(0, ["degree"])
        return hits.orderBy(F.desc("score"), F.expr(_KIND_ORDER), F.desc("degree"), F.length("id"), "id").select("id", "score", "kind", "degree", "file", "line", "signature")

    def find(self, query: str) -> str:
        out = [f"{r.id}  {r.kind}  {r.file}:{r.line}" + (f"  {r.signature}" if r.signature else "") for r in self.ranked(query).limit(CANDIDATES).collect()]
        if re.fullmatch(r"[A-Za-z_]\w*", query):
            hits = self.lines.where(word_usage(F.col("line"), query)).select("rel_path", "line_no", "line")
            shown = self.owned(hits.orderBy("rel_path", "line_no").limit(USAGES))
            total = hits.count()
            out += [f"used {total} times:"] * bool(total) + [f"  {r.rel_path}:{r.line_no} in {r.owner or r.rel_path}: {r.line.strip()[:120]}" for r in shown]
        else:
            hits = self.lines.where(all_words(F.col("line"), query.split())).orderBy("rel_path", "line_no").limit(PHRASES)
            out += [f"  {r.rel_path}:{r.line_no}: {r.line.strip()[:120]}" for r in hits.collect()]
        return fit(out or ["nothing found"], FIND)

    def owned(self, hits: DataFrame) -> list:
        """Lines with the innermost definition that holds each."""
        spans = self.symbols.where("kind <> 'module'").select(F.col("file").alias("rel_path"), F.col("line").alias("first"), F.col("end_line").alias("last"), F.col("id").alias("span"))
        at = S.enclosing(hits.select("rel_path", "line_no"), spans, "rel_path").withColumnRenamed("span", "owner")
        return hits.join(at, ["rel_path", "line_no"], "left").orderBy("rel_path", "line_no").collect()

    def lookup(self, name: str) -> tuple[str, list[str]]:
        """(status, ids): ok, ambiguous or no_match, by the first rule that finds anything."""
        low = name.lower()
        dotted = F.concat_ws(".", F.regexp_replace(F.substring_index("file", "/", -1), "\\.[a-z]+$", ""), F.col("qualname"))
        tiers = [F.col("id") == name, F.concat_ws(":", "file", "qualname") == name, F.col("file") == name, F.col("qualname") == name, F.col("name") == name, dotted == name, F.lower("qualname") == low]
        got = S.resolve_cascade(self.symbols.join(G.degree(self.links), "id", "left").fillna(0, ["degree"]), tiers, [F.desc("degree"), F.col("id")])
        ids = [r.id for r in got.select("id").limit(CANDIDATES).collect()]
        if not ids:
            ids = [r.id for r in self.ranked(name).limit(CANDIDATES).collect()]
        return ("no_match" if not ids else "ok" if len(ids) == 1 else "ambiguous"), ids

    # show

    def source(self, file: str, first: int, last: int) -> list[str]:
        rows = self.lines.where((F.col("rel_path") == file) & F.col("line_no").between(first, last)).orderBy("line_no").collect()
        return [f"{r.line_no:>5}  {r.line}" for r in rows]

    def show(self, names: str, detail: str = "full") -> str:
        """One symbol, or up to MULTI of a comma-separated list with a share of the budget each."""
        asked = [n.strip() for n in names.split(",") if n.strip()]
        if len(asked) <= 1:
            return self.show_one(names.strip(), detail, SHOW)
        return "\n\n".join(self.show_one(n, detail, max(700, 4000 // len(asked[:MULTI]))) for n in asked[:MULTI])

    def is_stub(self, body: list[str]) -> bool:
        """Whether a body is one line that returns a constant, passes or is not implemented."""
        code = [x for x in (b[5:].strip() for b in body[1:]) if x and not x.startswith(("#", "//", '"""', "'"))]
        return len(code) == 1 and bool(re.fullmatch(r"return(?: (?:None|True|False|null|\[\]|\{\}|\(\)|-?\d+|'[^']*'|\"[^\"]*\"))?;?|pass|\.\.\.|raise NotImplementedError.*", code[0]))

    def chain(self, start: str, levels: int = 3) -> str:
        """What a callee calls in turn, a few levels deep, through references and built values too."""
        at, out = [start], []
        for _ in range(levels):
            rows = self.links.where(F.col("src").isin(at) & (F.col("relation") != "inherits")).select("dst").distinct().orderBy("dst").limit(5).collect()
            at = [r.dst for r in rows if r.dst != start]
            if not at:
                break
            out.append(", ".join(at))
        return " which calls ".join(out)

    def show_one(self, name: str, detail: str, budget: int) -> str:
        status, ids = self.lookup(name)
        if status != "ok":
            return status + "".join(f"\n  {i}" for i in ids)
        s = self.symbols.where(F.col("id") == ids[0]).first()
        if s.kind == "module":
            return self.show_module(s, detail, budget)
        out = [f"{s.id}  {s.kind}  {s.file}:{s.line}-{s.end_line}", *(s.decorators or []), *filter(None, [s.signature, s.doc])]
        route = self.routes.where(F.col("id") == s.id).first() if s.decorators else None
        out += [f"route: {route.method} {route.path}"] if route else []
        if s.kind == "function" and s.parent and ":" in s.parent:
            above, under = self.overrides(s)
            out += [f"overrides {i}" for i in above] + ["overridden by " + ", ".join(under)] * bool(under)
        if detail == "signature":
            return fit(out, budget)
        pairs = [("calls", "src", "dst", CALLEES), ("called by", "dst", "src", CALLERS)]
        for title, own, other, most in pairs:
            rows = self.links.where(F.col(own) == s.id).orderBy(other, "relation")
            shown, total = rows.limit(most).collect(), rows.count()
            out += [f"{title} ({total}):"] * bool(total) + [f"  {r[other]}" + (f" [{r.relation}]" if r.relation != "call" else "") + f" line {r.line} x{r.n}" for r in shown]
            if not total and title == "called by" and s.kind == "function":
                out.append("called by nothing here: " + ("its route calls it" if route else "an entry point, or called from outside"))
            if total > most:
                out.append(f"  ... {total - most} more")
        if s.kind != "function":
            members = self.symbols.where(F.col("parent") == s.id).orderBy("line").select("name", short_signature(F.col("signature"), F.lit(None).cast("string")).alias("sig")).limit(60).collect()
            out += ["members:"] * bool(members) + [f"  {m.sig or m.name}" for m in members]
        inside, others = self.unresolved(s.id)
        out += ["not resolved, maybe of this repository: " + ", ".join(inside[:6])] * bool(inside) + [f"not resolved: {others} names from outside"] * bool(others)
        body = self.source(s.file, s.line, s.end_line)
        out += ["a stub: its body is one trivial line"] * (s.kind == "function" and self.is_stub(body))
        tiny = self.links.where((F.col("src") == s.id) & (F.col("relation") == "call")).join(self.symbols.select(F.col("id").alias("dst"), "kind", "file", F.col("line").alias("first"), F.col("end_line").alias("last")), "dst")
        for c in tiny.where((F.col("kind") == "function") & (F.col("last") - F.col("first") < TINY_LINES)).orderBy("dst").limit(6).collect():
            out += [f"{c.dst} is short:", *self.source(c.file, c.first, c.last)]
        for r in self.links.where((F.col("src") == s.id) & F.col("relation").isin("reference", "built_by")).select("dst").distinct().orderBy("dst").limit(3).collect():
            after = self.chain(r.dst)
            out += [f"{r.dst} calls {after}"] * bool(after)
        return fit(out + body if detail == "full" else out, budget)

    def unresolved(self, id_: str) -> tuple[list[str], int]:
        """Open calls of a symbol that name something of the repository, and the number of the others."""
        names = self.symbols.select(F.col("name").alias("last")).distinct().withColumn("here", F.lit(True))
        calls = self.edges.where((F.col("src") == id_) & F.col("target").isNull() & F.col("kind").isNull() & ~F.coalesce("relation", F.lit("")).isin("references", "built_by"))
        calls = calls.select("dst", F.substring_index("dst", ".", -1).alias("last")).distinct().join(names, "last", "left")
        bare = ~F.contains("dst", F.lit("."))
        rows = calls.select("dst", (F.coalesce("here", F.lit(False)) & (bare | ~F.col("last").isin(*sorted(BUILT_IN_METHODS)))).alias("inside")).orderBy("dst").collect()
        return [r.dst for r in rows if r.inside], sum(not r.inside for r in rows)

    def show_module(self, s, detail: str, budget: int) -> str:
        """A module: its source if short, else its definitions with their members, who uses it, what its top level calls."""
        out = [f"{s.id}  module  {s.file}:1-{s.end_line}", *filter(None, [s.doc])]
        if detail == "signature":
            return fit(out, budget)
        if detail == "full" and s.end_line <= MODULE_LINES:
            return fit(out + self.source(s.file, 1, s.end_line), budget)
        own = self.symbols.where((F.col("file") == s.file) & (F.col("kind") != "module") & (F.size(F.split("qualname", "[.]")) <= 2))
        for r in own.orderBy("line").select("qualname", "line", "kind", "signature").limit(4 * MODULE_LINES).collect():
            out.append(("    " if "." in r.qualname else "  ") + f"{r.line}: {r.signature or r.qualname}")
        ends = self.symbols.select(F.col("id").alias("src"), F.col("file").alias("src_file"))
        here = self.symbols.where(F.col("file") == s.file).select(F.col("id").alias("dst"))
        used = self.links.join(here, "dst", "left_semi").join(ends, "src").where(F.col("src_file") != s.file).select("src_file").distinct().orderBy("src_file").limit(OUTLINE_NAMES).collect()
        out += ["used by: " + ", ".join(r.src_file for r in used)] * bool(used)
        top = self.links.where(F.col("src") == s.id).select("dst").distinct().orderBy("dst").limit(OUTLINE_NAMES).collect()
        out += ["calls: " + ", ".join(r.dst for r in top)] * bool(top)
        return fit(out, budget)

    # trace

    def trace(self, start: str, goal: str | None = None, up: bool = False, depth: int = 3) -> str:
        status, ids = self.lookup(start)
        if status != "ok":
            return status
        links = self.links.where("relation <> 'inherits'")
        if goal is not None:
            status, ends = self.lookup(goal)
            if status != "ok":
                return status
            found = G.paths(links, self.spark.createDataFrame([(ids[0],)], "id string"), F.col("node") == ends[0], 8, 3)
            out = []
            for r in found.orderBy("hops", "path").collect():
                hops = r.path.split(">")
                out += [" -> ".join(hops), *(self.hop(a, b) for a, b in zip(hops, hops[1:], strict=False))]
            return fit(out or ["no path"], TRACE)
        if up:
            links = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        near = G.levels_down(links, self.spark.createDataFrame([(ids[0],)], "id string"), min(max(depth, 1), 6))
        inside = links.join(near.select(F.col("id").alias("src")), "src").select("src", "dst").distinct().limit(2000).collect()
        below: dict[str, list[str]] = {}
        for r in sorted(inside):
            below.setdefault(r.src, []).append(r.dst)
        out, seen = [], set()

        def walk(node: str, level: int) -> None:
            out.append("  " * level + node + (" (above)" if node in seen else ""))
            if node in seen or level == depth:
                return
            seen.add(node)
            for n in below.get(node, []):
                walk(n, level + 1)

        walk(ids[0], 0)
        return fit(out, TRACE)

    def hop(self, a: str, b: str) -> str:
        """How one symbol leads to the next: relation and line."""
        r = self.links.where((F.col("src") == a) & (F.col("dst") == b) & (F.col("relation") != "inherits")).orderBy(F.col("relation") != "call", "relation").first()
        return f"    {a} {'calls' if r.relation == 'call' else r.relation} {b} at line {r.line}"

    # map

    def map(self, prefix: str = "") -> str:
        """Files by the summed degree of their symbols, as wide as the budget allows."""
        deg = self.symbols.join(G.degree(self.links), "id", "left").fillna(0, ["degree"])
        if prefix:
            deg = deg.where((F.col("file") == prefix) | F.col("file").startswith(prefix.rstrip("/") + "/"))
        deg = deg.join(self.routes, "id", "left")
        route = F.col("method").isNotNull()
        score = F.col("degree") + F.when(route, 5).otherwise(0) + F.when(F.col("doc").isNotNull(), 2).otherwise(0)
        files = deg.groupBy("file").agg(F.sum("degree").alias("total"), F.count("*").alias("n")).orderBy(F.desc("total"), "file").limit(max(m for _, m in LADDER))
        best = max(p for p, _ in LADDER)
        from ..operators.analytics import top_of_group

        shown = top_of_group(deg.where("kind <> 'module' and size(split(qualname, '[.]')) <= 2").withColumn("score", score).join(files.select("file"), "file"), ["file"], [F.desc("score"), F.col("id")], best)
        by: dict[str, list] = {}
        for r in shown.orderBy("file", "rank").collect():
            by.setdefault(r.file, []).append(r)
        top = files.collect()
        for per_file, most in LADDER:
            text = "\n".join(f"{f.file} ({f.n})\n" + "\n".join(f"  {r.qualname}" + (f" [{r.method} {r.path}]" if r.method else "") for r in by.get(f.file, [])[:per_file]) for f in top[:most])
            if tokens_of(text) <= MAP:
                return text
        return "\n".join(sorted({f.file.rpartition("/")[0] or "." for f in top}))

    # slices

    def slice(self, query: str, most: int = 60) -> dict:
        """The part of the graph near what a query means: status, nodes (id, cost), edges, or candidates."""
        blob = F.concat_ws(" ", F.substring_index("file", "/", -1), "qualname", "kind", "subtype", "name", "signature", "doc", F.array_join(F.map_values("extra"), " "))
        docs = self.nodes.select(F.col("identity").alias("id"), F.array_join(identifier_words(blob), " ").alias("blob"))
        words = re.findall("[a-z0-9]+", query.lower())
        ranked = S.bm25(docs, "id", "blob", words).orderBy(F.desc("score"), "id").limit(10) if words else None
        top = ranked.collect() if ranked is not None else []
        if not top:
            return {"status": "no_match"}
        which = {r.node: r.component for r in self.components.where(F.col("node").isin([r.id for r in top])).collect()}
        groups: dict[str, list] = {}
        for r in top:
            groups.setdefault(which.get(r.id, r.id), []).append(r)
        order = sorted((max(g, key=lambda r: (r.score, r.id)) for g in groups.values()), key=lambda r: (-r.score, r.id))
        if len(order) > 1 and not (order[0].score > 0 and order[1].score < 0.5 * order[0].score):
            return {"status": "ambiguous", "candidates": [(r.id, round(r.score, 6)) for r in order]}
        winners = groups[which.get(order[0].id, order[0].id)]
        return self.around([r.id for r in winners], most)

    def around(self, ids: list[str], most: int = 60) -> dict:
        seeds = self.spark.createDataFrame([(i,) for i in ids], "id string")
        nodes = self.nodes.select(F.col("identity").alias("id"), F.col("tier").cast("bigint").alias("tier"))
        kept = G.cap(G.expand(nodes, self.graph, seeds), nodes, seeds, most)
        return {"status": "ok", "nodes": kept, "edges": G.induced(self.graph, kept)}

    def context(self, query: str, budget: int = PACK) -> str:
        """A context pack: snippets of the nearest definitions while they fit, then references."""
        got = self.slice(query)
        if got["status"] == "ambiguous":  # the three best meanings together
            got = self.around([i for i, _ in got["candidates"][:3]])
        if got["status"] != "ok":
            return got["status"]
        rows = got["nodes"].join(self.symbols, "id").where("kind <> 'module'").orderBy("rank").collect()
        out, used, rest = [f"# {query}"], tokens_of(query) + 8, []
        for r in rows:
            # a class ends before the first definition in it that has a snippet of its own
            nested = [x.line for x in rows if x.file == r.file and r.line < x.line <= r.end_line and x.id.startswith(r.id + ".")]
            last = min([r.end_line, r.line + SNIPPET_LINES - 1] + ([min(nested) - 1] if r.kind == "class" and nested else []))
            text = "\n".join([f"## {r.id} ({r.file}:{r.line})", *self.source(r.file, r.line, last)])
            if used + tokens_of(text) <= budget * 3 // 4:
                out.append(text)
                used += tokens_of(text)
            else:
                rest.append(f"- {r.id} ({r.file}:{r.line}) {r.signature or ''}")
        out += rest + [f"- {e.src} {e.relation} {e.dst}" for e in got["edges"].orderBy("src", "dst", "relation").limit(200).collect()]
        kept, used = [], 0
        for part in out:
            if used + tokens_of(part) + 1 > budget:
                break
            kept.append(part)
            used += tokens_of(part) + 1
        return "\n".join(kept)

    def baseline_tokens(self, query: str) -> int:
        """What the whole files that a pack touches would cost."""
        got = self.slice(query)
        if got["status"] != "ok":
            return 0
        touched = got["nodes"].join(self.symbols, "id").select(F.col("file").alias("rel_path")).distinct()
        return self.files.join(touched, "rel_path", "left_semi").agg(F.sum(token_estimate(F.col("text")))).first()[0] or 0

    def diagram(self, query: str, path: str, most: int = 60) -> str:
        """Write the slice of a query as a draw.io file; the status."""
        from .drawio import render

        if not path.endswith(".drawio"):
            raise ValueError("the file must end in .drawio")
        got = self.slice(query, most)
        if got["status"] != "ok":
            return got["status"]
        facts = got["nodes"].join(self.nodes.select(F.col("identity").alias("id"), "kind", "subtype", "file", "line", "name"), "id")
        with open(path, "w", encoding="utf-8", newline="\n") as f:
            f.write(render(facts, got["edges"]))
        return "ok"


def file_name(query: str) -> str:
    """What a diagram of a query is called by default."""
    spark = SparkSession.getActiveSession()
    return spark.range(1).select(slug(F.lit(query)).alias("s")).first().s + ".drawio"
