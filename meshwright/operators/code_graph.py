"""Resolving the dangling edges of a code graph, as joins.

Every rule is a join that must be unambiguous: a target that is not unique stays unresolved.
Passes run in order, each over what the passes before it left: the caller's own scopes,
imports across files, stated types, then members along base classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import resolve as R
from .graph import relation_name
from .storage import materialize

#: How far base classes, return types and re-exports are followed.
BASE_DEPTH, RETURN_DEPTH, REEXPORT_DEPTH = 5, 3, 4
PY_PROBES, TS_SUFFIXES = (".py", "/__init__.py"), (".ts", ".tsx", ".js", ".jsx")
_REF = "struct<kind:string,name:string,owner:string>"


def merge_nodes(evidence: DataFrame) -> DataFrame:
    """One row per identity; its columns come from the first evidence, ``n_evidence`` counts all."""
    w = Window.partitionBy("identity").orderBy("ord", "file", "seq", "line")
    first = evidence.withColumn("_r", F.row_number().over(w)).withColumn("n_evidence", F.count("*").over(Window.partitionBy("identity")))
    return first.where("_r = 1").drop("_r")


def numbered(raw: DataFrame) -> DataFrame:
    """Raw edges with ``eid``, a hash of where and what they are, and ``caller``, the dotted name of their source."""
    eid = F.xxhash64("src", "dst", "file", "line", "ord", "seq")
    prefix = F.concat(F.col("file"), F.lit(":"))
    caller = F.when(F.col("src").startswith(prefix), F.substring("src", F.length(prefix) + 1, F.length("src"))).otherwise("")
    return raw.withColumn("eid", eid).withColumn("caller", caller)


def _scopes(caller: Column) -> Column:
    """The dotted scopes of a caller, innermost first, "" (the module) last."""
    parts = F.filter(F.split(caller, "[.]"), lambda p: p != "")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.array_join(F.slice(parts, F.lit(1), n - i), "."))


def _dot(scope: Column, name: Column) -> Column:
    return F.when(scope == "", name).otherwise(F.concat(scope, F.lit("."), name))


def same_scope(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(eid, target) of bare names: the innermost scope that defines one; class bodies are not searched."""
    bare = edges.where((F.size("chain") == 1) & ~F.col("alias") & F.col("kind").isNull())
    tries = bare.select("eid", "file", F.col("chain")[0].alias("name"), F.posexplode(_scopes(F.col("caller"))).alias("rank", "scope"))
    classes = nodes.where("kind = 'class'").select("file", F.col("qualname").alias("scope"))
    tries = tries.join(classes, ["file", "scope"], "left_anti")
    tries = tries.withColumn("target", F.concat("file", F.lit(":"), _dot(F.col("scope"), F.col("name"))))
    hit = tries.join(nodes.select(F.col("identity").alias("target")), "target")
    return hit.groupBy("eid").agg(F.min_by("target", "rank").alias("target"))


def enclosing_class(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(eid, cls, member, rest) of chains that begin with self, this or cls."""
    own = edges.where((F.size("chain") == 2) & F.col("chain")[0].isin("self", "this", "cls"))
    tries = own.select("eid", "file", F.col("chain")[1].alias("member"), F.posexplode(_scopes(F.col("caller"))).alias("rank", "scope"))
    tries = tries.withColumn("cls", F.concat("file", F.lit(":"), F.col("scope")))
    hit = tries.join(nodes.where("kind = 'class'").select(F.col("identity").alias("cls")), "cls")
    return hit.groupBy("eid", "member").agg(F.min_by("cls", "rank").alias("cls"))


def python_modules(nodes: DataFrame) -> DataFrame:
    """(module, file): dotted names by which exactly one Python file can be meant."""
    files = nodes.where("kind = 'module' and file like '%.py'").select("file").distinct()
    bare = F.regexp_replace(F.regexp_replace("file", "/__init__\\.py$", ""), "\\.py$", "")
    keys = files.select("file", F.explode(R.suffixes(bare)).alias("path"))
    keys = keys.select("file", F.translate("path", "/", ".").alias("module"))
    return keys.groupBy("module").agg(F.min("file").alias("module_file"), F.count_distinct("file").alias("_n")).where("_n = 1").drop("_n")


def _absolute(file: Column, dotted: Column) -> Column:
    """A dotted path with leading dots as a path from the root; others unchanged."""
    dots = F.length(F.regexp_extract(dotted, "^\\.*", 0))
    parts = F.split(file, "/")
    base = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots, F.lit(0)))
    rest = F.filter(F.split(F.regexp_replace(dotted, "^\\.+", ""), "[.]"), lambda p: p != "")
    return F.when(dots > 0, F.array_join(F.concat(base, rest), "."))


def dotted_targets(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, target) of refs (key, file, dotted): every split into module and attribute path is tried.

    Resolved only where exactly one node is meant. A relative path names a file exactly; an
    absolute one may be any unique suffix of a file's path.
    """
    exact = nodes.where("kind = 'module' and file like '%.py'").select(
        F.col("file").alias("module_file"), F.translate(F.regexp_replace(F.regexp_replace("file", "/?__init__\\.py$", ""), "\\.py$", ""), "/", ".").alias("module")
    )
    relative = _absolute(F.col("file"), F.col("dotted"))
    parts = F.split(F.coalesce(relative, F.col("dotted")), "[.]")
    n = F.size(parts)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), ".").alias("module"), F.array_join(F.slice(parts, i + 1, n), ".").alias("attr")))
    tries = refs.select("key", relative.isNotNull().alias("is_relative"), F.explode(cut).alias("c")).select("key", "is_relative", "c.*").where("attr <> ''")
    found = tries.where("not is_relative").join(python_modules(nodes), "module").select("key", "module_file", "attr")
    found = found.unionByName(tries.where("is_relative").join(exact, "module").select("key", "module_file", "attr"))
    hit = found.withColumn("target", F.concat("module_file", F.lit(":"), F.col("attr"))).join(nodes.select(F.col("identity").alias("target")), "target")
    sole = hit.groupBy("key").agg(F.min("target").alias("target"), F.count_distinct("target").alias("_n"))
    return sole.where("_n = 1").drop("_n")


def normal_path(folder: Column, relative: Column) -> Column:
    """``folder/relative`` with "." and ".." folded."""
    parts = F.filter(F.split(F.concat_ws("/", folder, relative), "/"), lambda p: (p != "") & (p != "."))
    start = F.array().cast("array<string>")
    folded = F.aggregate(
        parts, start, lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    )
    return F.array_join(folded, "/")


def typescript_modules(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, module_file) of module paths relative to the file, or from the root (/): suffixes are tried in order, then index files."""
    folder = F.when(F.contains("file", F.lit("/")), F.regexp_replace("file", "/[^/]*$", "")).otherwise("")
    path = F.when(F.col("module").startswith("/"), normal_path(F.lit(""), F.col("module"))).otherwise(normal_path(folder, F.col("module")))
    probes = [F.concat(path, F.lit(s)) for s in TS_SUFFIXES] + [F.concat(path, F.lit("/index" + s)) for s in TS_SUFFIXES]
    tries = refs.where(F.col("module").rlike("^[./]")).select("key", F.posexplode(F.array(*probes)).alias("rank", "module_file"))
    files = nodes.where("kind = 'module'").select(F.col("file").alias("module_file")).distinct()
    return tries.join(files, "module_file").groupBy("key").agg(F.min_by("module_file", "rank").alias("module_file"))


def expand_aliases(refs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Refs (key, file, module, ...) whose module has an alias point from the root.

    The nearest folder above the file that has a fitting alias decides, then the longest
    prefix. Folders of a file are exploded, so the join is on a key.
    """
    bare = refs.where(~F.col("module").rlike("^[./]"))
    up = bare.select("key", "module", F.explode(F.concat(F.array(F.lit("")), R.ancestors(F.col("file")))).alias("folder"))
    fit = up.join(aliases, "folder").where(F.col("module").startswith(F.col("prefix")))
    path = F.concat(F.lit("/"), F.col("target"), F.lit("/"), F.expr("substring(module, length(prefix) + 1)"))
    best = fit.groupBy("key").agg(F.max_by(path, F.struct(F.length("folder"), F.length("prefix"))).alias("_path"))
    return refs.join(best, "key", "left").withColumn("module", F.coalesce("_path", "module")).drop("_path")


def typescript_targets(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, target) of refs (key, file, module, name), followed through re-exports."""
    modules = nodes.where("kind = 'module'").select("file", F.try_element_at("extra", F.lit("default_export")).alias("default"), F.try_element_at("extra", F.lit("reexports")).alias("again"))
    exports = modules.where("again is not null").select("file", F.posexplode(F.split("again", ";")).alias("pos", "x"))
    exports = exports.select("file", "pos", F.substring_index("x", "=", 1).alias("module"), F.substring_index("x", "=", -1).alias("names"))
    exports = exports.select("file", "pos", "module", F.explode(F.split("names", ",")).alias("pair"))
    edge = exports.select("file", "pos", "module", F.substring_index("pair", ":", 1).alias("alias"), F.substring_index("pair", ":", -1).alias("original"))
    edge = materialize(edge.withColumn("key", F.monotonically_increasing_id()), "exports")
    reach = typescript_modules(edge.select("key", "file", "module"), nodes)
    edge = edge.join(reach, "key").select(F.col("file").alias("module_file"), "pos", "alias", "original", F.col("module_file").alias("next_file"))
    ids = nodes.select(F.col("identity").alias("target"))
    front = refs.join(typescript_modules(refs, nodes), "key").select("key", "module_file", "name", F.array().cast("array<int>").alias("trail"))
    found = None
    for depth in range(REEXPORT_DEPTH + 1):
        named = front.join(modules.select(F.col("file").alias("module_file"), "default"), "module_file", "left")
        name = F.when(F.col("name") == "<default>", F.col("default")).otherwise(F.col("name"))
        hit = named.withColumn("target", F.concat("module_file", F.lit(":"), name)).join(ids, "target").select("key", "trail", "target")
        found = hit if found is None else found.unionByName(hit)
        if depth < REEXPORT_DEPTH:
            step = front.join(edge, "module_file").where((F.col("alias") == "*") | (F.col("alias") == F.col("name")))
            front = step.select(
                "key", F.col("next_file").alias("module_file"), F.when(F.col("alias") == "*", F.col("name")).otherwise(F.when(F.col("original") == "default", "<default>").otherwise(F.col("original"))).alias("name"), F.concat("trail", F.array("pos")).alias("trail")
            )
    return found.groupBy("key").agg(F.min_by("target", F.struct(F.size("trail"), "trail")).alias("target"))


def type_targets(refs: DataFrame, nodes: DataFrame, attributes: DataFrame) -> DataFrame:
    """(key, target) of type references (key, file, ref): the class that is meant.

    A function stands for the class it states to return, up to RETURN_DEPTH functions deep.
    """
    kinds = nodes.select(F.col("identity").alias("target"), F.col("kind").alias("target_kind"), F.col("file").alias("target_file"), "returns")
    front, found = refs, None
    for _ in range(RETURN_DEPTH + 1):
        local = front.where("ref.kind = 'local'").select("key", F.concat("file", F.lit(":"), F.col("ref.name")).alias("target"))
        bound = dotted_targets(front.where("ref.kind = 'bound'").select("key", "file", F.col("ref.name").alias("dotted")), nodes)
        method = front.where("ref.kind = 'self_call'").select("key", F.concat("file", F.lit(":"), F.col("ref.owner"), F.lit("."), F.col("ref.name")).alias("target"))
        held = front.where("ref.kind = 'attribute'").select("key", F.concat("file", F.lit(":"), F.col("ref.owner")).alias("cls"), F.col("ref.name").alias("attr"), "file")
        hit = local.unionByName(bound.select("key", "target")).unionByName(method).join(kinds, "target")
        done = hit.where("target_kind = 'class'").select("key", "target")
        found = done if found is None else found.unionByName(done)
        deeper = hit.where("target_kind = 'function' and returns is not null").select("key", F.col("target_file").alias("file"), F.col("returns").alias("ref"))
        front = deeper.unionByName(held.join(attributes, ["cls", "attr"]).select("key", F.col("attr_file").alias("file"), "ref"))
        front = materialize(front, "types")
        if front.isEmpty():
            break
    return found.groupBy("key").agg(F.min("target").alias("target"))


def resolve(evidence: DataFrame, raw: DataFrame, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): merged nodes and raw edges with ``target``, null where unresolved, and ``relation_name``.

    ``aliases`` are (folder, prefix, target) of TypeScript configurations.
    """
    nodes = materialize(merge_nodes(evidence), "nodes")
    edges = materialize(numbered(raw).dropDuplicates(["eid"]), "edges")
    exact = edges.join(nodes.select(F.col("identity").alias("dst")), "dst").where("tier = 0").select("eid", F.col("dst").alias("target"))
    code = edges.where("tier = 2 and kind is null")
    python = F.col("file").endswith(".py")
    near = same_scope(code.where(F.col("relation").isNull() | (F.col("relation") != "inherits")), nodes)
    # imports
    dotted = F.coalesce("dotted", F.when(F.col("module").endswith("."), F.concat("module", "name")).otherwise(F.concat_ws(".", "module", "name")))
    py = code.where(python & F.col("alias")).select(F.col("eid").alias("key"), "file", dotted.alias("dotted")).where("dotted is not null")
    far = dotted_targets(py, nodes).select(F.col("key").alias("eid"), "target")
    ts = code.where(~python & F.col("module").isNotNull() & F.col("name").isNotNull()).select(F.col("eid").alias("key"), "file", "module", "name")
    ts = ts if aliases is None else expand_aliases(ts, aliases)
    far = far.unionByName(typescript_targets(ts, nodes).select(F.col("key").alias("eid"), "target"))
    # base classes, then members along them
    held = nodes.where("kind = 'class'").select(F.col("identity").alias("cls"), F.col("file").alias("attr_file"), F.explode("attr_types").alias("attr", "ref"))
    inherits = code.where("relation = 'inherits'")
    up = type_targets(inherits.select(F.col("eid").alias("key"), "file", F.col("receiver").alias("ref")), nodes, held)
    bases = inherits.join(up, F.col("eid") == F.col("key")).select(F.col("src").alias("cls"), F.col("target").alias("base"), F.col("seq").alias("pos"), "eid", "target")
    bases = materialize(bases, "bases")
    typed = code.where(F.col("receiver").isNotNull() & (F.size("rest") == 1) & (F.coalesce("relation", F.lit("")) != "inherits"))
    classes = type_targets(typed.select(F.col("eid").alias("key"), "file", F.col("receiver").alias("ref")), nodes, held)
    asked = typed.join(classes, F.col("eid") == F.col("key")).select("eid", F.col("target").alias("cls"), F.col("rest")[0].alias("member"))
    asked = asked.unionByName(enclosing_class(code, nodes).select("eid", "cls", "member"))
    asked = materialize(asked, "asked")
    members = nodes.where("qualname like '%.%'").select(
        F.concat("file", F.lit(":"), F.regexp_replace("qualname", "\\.[^.]*$", "")).alias("cls"), "name"
    ).withColumnRenamed("name", "member")
    owned = R.member_lookup(asked.select("cls", "member").distinct(), bases.select("cls", "base", "pos"), members, BASE_DEPTH)
    through = asked.join(owned.select("cls", "member", "owner"), ["cls", "member"]).select("eid", F.concat("owner", F.lit("."), F.col("member")).alias("target"))
    every = (
        exact.withColumn("_p", F.lit(0)).unionByName(bases.select("eid", "target").withColumn("_p", F.lit(1))).unionByName(through.withColumn("_p", F.lit(2)))
        .unionByName(near.withColumn("_p", F.lit(3))).unionByName(far.withColumn("_p", F.lit(4)))
    )
    chosen = every.groupBy("eid").agg(F.min_by("target", "_p").alias("target"))
    named = edges.join(chosen, "eid", "left").withColumn("relation_name", relation_name(F.col("relation"), F.col("kind")))
    return nodes, named


def containment(nodes: DataFrame) -> DataFrame:
    """(src, dst, relation, file, line): a service's build context contains the code nodes below it.

    Folders of each file are exploded, so containment is an equi-join.
    """
    services = nodes.where(F.try_element_at("extra", F.lit("build_context")).isNotNull()).select(
        F.col("identity").alias("src"), F.col("file").alias("service_file"), "line",
        normal_path(F.when(F.contains("file", F.lit("/")), F.regexp_replace("file", "/[^/]*$", "")).otherwise(""), F.try_element_at("extra", F.lit("build_context"))).alias("folder"),
    )
    inside = nodes.where("tier in (1, 2)").select(F.col("identity").alias("dst"), F.explode(F.concat(F.array(F.lit("")), R.ancestors(F.col("file")))).alias("folder"))
    return services.join(inside, "folder").select("src", "dst", F.lit("build_context_contains").alias("relation"), F.col("service_file").alias("file"), "line")


def symbols(nodes: DataFrame) -> DataFrame:
    """Code entities by which views look things up: one row per tier-2 node, with its parent's id."""
    parent = F.when(F.contains("qualname", F.lit(".")), F.concat("file", F.lit(":"), F.regexp_replace("qualname", "\\.[^.]*$", ""))).when(F.col("qualname") != "", F.col("file"))
    return nodes.where("tier = 2").select(F.col("identity").alias("id"), "kind", "file", "line", "end_line", "name", "qualname", "signature", "doc", "decorators", parent.alias("parent"))


def links(edges: DataFrame, symbols_: DataFrame) -> DataFrame:
    """(src, dst, relation, n, line): resolved edges between symbols, no imports, no self-loops."""
    from .graph import collapse_links, index_relation

    kept = edges.where("target is not null and kind is null and src <> target")
    kept = kept.select("src", F.col("target").alias("dst"), index_relation(F.coalesce("relation", F.lit("")), F.coalesce("via", F.lit(""))).alias("relation"), F.col("line").cast("bigint").alias("line"))
    ids = symbols_.select("id")
    kept = kept.join(ids, kept.src == ids.id, "left_semi").join(ids, kept.dst == ids.id, "left_semi")
    return collapse_links(kept)
