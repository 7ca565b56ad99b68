"""Extraction, resolution and views over the embedded repository and small texts."""

import os
import subprocess

import pytest

from meshwright.api.repository import Repository
from meshwright.extract import infrastructure, python_code, rules, typescript_code
from meshwright.operators import code_graph as C
from meshwright.plans.sample_repository import FILES
from meshwright.sources.files import list_files


@pytest.fixture(scope="module")
def repo(spark):
    return Repository(spark, texts=FILES)


@pytest.fixture(scope="module")
def resolved(repo):
    return {(r.src, r.dst, r.relation) for r in repo.graph.collect()}


def test_python_calls_resolve(resolved):
    for edge in [
        ("app/service.py:make_car", "app/models.py:Car", "calls"),
        ("app/service.py:make_car", "app/models.py:Engine", "calls"),
        ("app/service.py:run", "app/service.py:make_car", "calls"),
        ("app/service.py:run", "app/models.py:Car.drive", "calls"),  # by the stated return type
        ("app/service.py:run", "app/models.py:Engine", "calls"),  # by a dotted path
        ("app/service.py:run", "app/base.py:helper", "calls"),  # by an alias
        ("app/service.py:run", "app/service.py:make_car", "references"),
        ("app/service.py:run", "app/service.py:make_queue", "built_by"),
        ("app/models.py:Car", "app/base.py:Base", "inherits"),
        ("app/models.py:Car.drive", "app/base.py:Base.check", "calls"),  # by a base class
        ("app/models.py:Car.drive", "app/models.py:Engine.start", "calls"),  # by an attribute's type
        ("app/base.py:helper", "app/base.py:helper.inner", "calls"),
        ("app/base.py:helper.inner", "app/base.py:helper", "calls"),
        ("app/base.py:Base.check", "app/base.py:helper", "calls"),
    ]:
        assert edge in resolved, edge


def test_nothing_is_guessed(resolved):
    assert not any(dst.endswith("unknown_thing") or "schedule" in dst for _, dst, _ in resolved)
    assert ("app/models.py:Car.drive", "app/base.py:helper", "calls") not in resolved


def test_typescript_resolves(resolved):
    for edge in [
        ("web/card.tsx:Card.render", "web/util.ts:helper", "calls"),
        ("web/card.tsx:Card.render", "web/card.tsx:Card.label", "calls"),
        ("web/card.tsx:Card.label", "web/util.ts:helper", "calls"),  # in a template
        ("web/card.tsx:Page", "web/card.tsx:Card", "calls"),  # JSX
        ("web/main.ts:main", "web/util.ts:helper", "calls"),  # through a re-export, and as default
    ]:
        assert edge in resolved, edge


def test_infrastructure_resolves(resolved):
    for edge in [
        ("compose:api", "compose:db", "depends_on"),
        ("aws_lambda_function.norm", "aws_s3_bucket.raw", "calls"),
        ("docker:deploy/Dockerfile#test", "docker:deploy/Dockerfile#build", "extends"),
        ("docker:deploy/Dockerfile#stage2", "docker:deploy/Dockerfile#build", "copies_from"),
        ("Service/default/web-svc", "Deployment/default/web", "routes_to"),
        ("Deployment/default/web", "Secret/default/keys", "mounts_or_reads"),
        ("compose:api", "app/models.py:Car", "build_context_contains"),
    ]:
        assert edge in resolved, edge
    assert not any(src == "compose:api" and dst.startswith("web/") for src, dst, _ in resolved)


def test_a_broken_file_keeps_its_module(repo):
    assert [(r.rel_path, r.extractor) for r in repo.scanned[2].collect()] == [("app/broken.py", python_code.VERSION)]
    assert repo.nodes.where("identity = 'app/broken.py'").count() == 1


def test_rules():
    text = FILES["app/cloud.py"]
    found = rules.scan("app/cloud.py", text, rules.load_rules())
    assert [(n.identity, n.line, n.confidence) for n in found] == [("aws-s3-client:app/cloud.py:6", 6, 0.75), ("aws-s3-bucket-name:raw-data", 7, 0.9)]
    assert rules.scan("x.js", "/* new S3Client( */ new S3Client({})", rules.load_rules())[0].line == 1
    with pytest.raises(ValueError):
        rules.load_rules("- {id: x, kind: y}")
    with pytest.raises(ValueError):
        rules.load_rules("- {id: x, kind: y, confidence: 1, capture_arg: v, patterns: [{lang: go, match: a}]}")


def test_python_nodes():
    nodes, edges = python_code.extract("m.py", '@deco(1)\nclass A:\n    """Doc.\n\n    More."""\n\n    async def f(self, x: int = g()) -> None:\n        pass\n')
    by = {n.identity: n for n in nodes}
    assert by["m.py:A"].doc == "Doc." and by["m.py:A"].decorators == ["@deco(1)"] and by["m.py:A"].line == 2
    assert by["m.py:A.f"].signature == "async def f(self, x: int=g()) -> None"
    assert {(e.src, e.dst, e.via) for e in edges} == {("m.py:A", "deco", None), ("m.py:A.f", "g", "param_default")}
    assert python_code.extract("e.py", " \n") == ([], [])


def test_local_names_hide_module_names():
    _, edges = python_code.extract("m.py", "from a import b\n\ndef f(b):\n    b()\n    for c in []:\n        g(c)\n    h(b)\n")
    assert not any(e.alias for e in edges if e.relation is None and e.kind is None)
    assert not any(e.relation == "references" for e in edges)


def test_typescript_ignores_strings_and_comments():
    _, edges = typescript_code.extract("a.ts", "// f()\nconst s = 'g()';\nconst r = /h()/;\nfunction k() { m(`${n()} o()`); }\n")
    assert sorted(e.dst for e in edges) == ["m", "n"]


def test_infrastructure_lines_and_kinds():
    nodes, edges = infrastructure.terraform("m.tf", FILES["deploy/main.tf"])
    assert [(n.identity, n.kind, n.line) for n in nodes] == [("aws_s3_bucket.raw", "datastore", 1), ("aws_lambda_function.norm", "service", 5)]
    assert [(e.src, e.dst) for e in edges] == [("aws_lambda_function.norm", "aws_s3_bucket.raw")]
    nodes, _ = infrastructure.compose("c.yml", FILES["deploy/docker-compose.yml"])
    assert [(n.identity, n.kind, n.subtype, n.line) for n in nodes] == [("compose:api", "service", None, 2), ("compose:db", "datastore", "postgres", 5)]
    nodes, _ = infrastructure.dockerfile("Dockerfile", FILES["deploy/Dockerfile"])
    assert nodes[-1].extra == {"base_image": "python:3.13", "exposed_ports": "80,443"}
    nodes, _ = infrastructure.kubernetes("k.yaml", "kind: [\n---\nkind: Job\nmetadata: {name: j}\n---\njust text\n")
    assert [n.identity for n in nodes] == ["Job/default/j"]


def test_views(repo, tmp_path):
    assert "app/models.py:Car" in repo.find("car")
    assert repo.lookup("Car.drive") == ("ok", ["app/models.py:Car.drive"])
    shown = repo.show("make_car")
    assert "app/models.py:Car" in shown and "called by (2)" in shown and "return Car(Engine())" in shown
    assert "app/service.py:run -> app/models.py:Car.drive -> app/models.py:Engine.start" in repo.trace("run", "start")
    assert "app/service.py:run" in repo.trace("drive", up=True)
    assert "app/service.py" in repo.map("app") and "web/util.ts" not in repo.map("app")
    assert repo.scan()["errors"] == 1
    assert repo.slice("qqqq")["status"] == "no_match"
    pack = repo.context("car engine", 800)
    assert 0 < (len(pack) + 3) // 4 <= 800
    path = str(tmp_path / "x.drawio")
    if repo.diagram("lambda norm", path) == "ok":
        with open(path) as f:
            assert "aws_s3_bucket.raw" in f.read()
    with pytest.raises(ValueError):
        repo.diagram("x", "x.png")


def test_path_aliases(spark):
    files = {
        "web/tsconfig.json": '{ // base\n "extends": "./base", }',
        "web/base.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "@/deep/*": ["other/*"],}}}',
        "web/src/a.ts": "export function f() {}\n",
        "web/other/a.ts": "export function g() {}\n",
        "web/src/b.ts": "import { f } from '@/a';\nimport { g } from '@/deep/a';\nfunction h() { f(); g(); }\n",
    }
    found = {(r.src, r.dst) for r in Repository(spark, texts=files).graph.where("relation = 'calls'").collect()}
    assert found == {("web/src/b.ts:h", "web/src/a.ts:f"), ("web/src/b.ts:h", "web/other/a.ts:g")}


def test_show_tells_more(repo):
    assert "a stub" in repo.show("honk")
    both = repo.show("make_queue, Engine.start")
    assert "app/service.py:make_queue" in both and "app/models.py:Engine.start" in both
    assert "app/service.py:make_car calls app/models.py:Car" in repo.show("run")


def test_snapshots_differ(spark, repo):
    new = Repository(spark, texts={**{k: v for k, v in FILES.items() if k != "web/util.ts"}, "app/base.py": "x = 1\n", "new.py": "y = 2\n"})
    assert {(r.rel_path, r.status) for r in new.changed_since(repo).collect()} == {("web/util.ts", "removed"), ("app/base.py", "changed"), ("new.py", "added")}


def test_listing_sees_hidden_and_skips_vendored(tmp_path):
    for p in ("a/__init__.py", ".env.py", "node_modules/x.js", "a/tests/t.py", "tests_not/u.py"):
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text("x")
    assert list_files(str(tmp_path)) == [".env.py", "a/__init__.py", "tests_not/u.py"]
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / ".gitignore").write_text("tests_not/\n")
    assert list_files(str(tmp_path)) == [".env.py", ".gitignore", "a/__init__.py"]


def test_merge_takes_the_first_evidence(spark):
    rows = [("n", "config", 1, "b", 0, 3), ("n", "service", 0, "a", 5, 1)]
    e = spark.createDataFrame(rows, "identity string, kind string, ord int, file string, seq int, line int")
    got = C.merge_nodes(e).first()
    assert (got.kind, got.n_evidence) == ("service", 2)


def test_modules_overrides_hops_and_routes(spark):
    files = {
        "api.py": "from x import APIRouter\nrouter = APIRouter(prefix='/v1')\n\n\n@router.get('/items')\ndef items():\n    return load()\n\n\ndef load():\n    return missing_one() + outside.call()\n",
        "shapes.py": "class Shape:\n    def area(self):\n        return 0\n\n\nclass Square(Shape):\n    def area(self):\n        return 4\n",
        "user.py": "from shapes import Square\n\n\ndef use():\n    return Square().area()\n\n\ndef missing_one_not():\n    pass\n",
        ".terraform/x.tf": 'resource "aws_s3_bucket" "hidden" {}\n', "charts/x.yaml": "kind: Secret\nmetadata:\n  name: hidden\n",
    }
    repo = Repository(spark, texts=files)
    assert "route: GET /v1/items" in repo.show("items") and "its route calls it" in repo.show("items")
    assert "[GET /v1/items]" in repo.map()
    assert "overrides shapes.py:Shape.area" in repo.show("Square.area") and "overridden by shapes.py:Square.area" in repo.show("Shape.area")
    assert "class Shape" in repo.show("shapes.py", "outline") and "used by: user.py" in repo.show("shapes.py", "outline")
    assert "    api.py:items calls api.py:load at line 7" in repo.trace("items", "load")
    assert "hidden" not in str(repo.nodes.select("identity").collect())
    assert repo.unresolved("api.py:load") == ([], 2)


def test_cache_only_scans_what_changed(spark, tmp_path):
    from meshwright.extract.scan import default_extractors
    from meshwright.operators.cache import cached_rows

    place = f"file://{tmp_path}/cache"
    texts = {"a.py": "def f():\n    return g()\n\n\ndef g():\n    pass\n", "b.py": "x = 1\n"}
    first = Repository(spark, texts=texts, cache=place)
    want = sorted(map(tuple, first.links.collect()))

    def refuse(path, text):
        raise AssertionError(path)

    # the same names and versions, so the same keys: only new contents reach the extractors
    poisoned = [(name, applies, refuse) for name, applies, _ in default_extractors()]
    again = Repository(spark, texts=texts | {"c.py": "y = 2\n"}, extractors=poisoned, cache=place)
    assert sorted(map(tuple, again.links.collect())) == want
    assert {r.rel_path for r in again.scanned[2].collect()} == {"c.py"}
    assert {r.rel_path for r in cached_rows(spark, place).collect()} == {"a.py", "b.py", "c.py"}


def test_server(spark, tmp_path):
    import io
    import json

    from meshwright.api.server import TOOLS, Server

    (tmp_path / "m.py").write_text("def start():\n    return helper()\n\n\ndef helper():\n    return 1\n")
    calls = [("initialize", {}), ("tools/list", {}), ("tools/call", {"name": "show", "arguments": {"symbol": "start"}}), ("tools/call", {"name": "slice", "arguments": {"repo_path": str(tmp_path), "query": "helper"}}), ("tools/call", {"name": "show", "arguments": {}}), ("nothing", {})]
    lines = [json.dumps({"jsonrpc": "2.0", "id": i, "method": m, "params": p}) for i, (m, p) in enumerate(calls)] + [json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), "{"]
    out = io.StringIO()
    Server(spark, str(tmp_path)).serve(io.StringIO("\n".join(lines)), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(got) == 7 and [t["name"] for t in got[1]["result"]["tools"]] == list(TOOLS)
    assert "m.py:helper" in got[2]["result"]["content"][0]["text"]
    sliced = json.loads(got[3]["result"]["content"][0]["text"])
    assert sliced["status"] == "ok" and {"m.py:start", "m.py:helper"} <= {n["id"] for n in sliced["nodes"]} and sliced["edges"]
    assert got[4]["result"]["isError"] and got[5]["error"]["code"] == -32601 and got[6]["error"]["code"] == -32700
