"""Evidence from infrastructure files: Terraform, Compose, Dockerfiles, Kubernetes manifests."""

from __future__ import annotations

import re

import yaml

from .records import Edge, Node

#: Resource type, then kind and subtype.
TERRAFORM_KINDS = {
    "aws_s3_bucket": ("datastore", "s3"),
    "aws_lambda_function": ("service", "lambda"),
    "aws_dynamodb_table": ("datastore", "dynamodb"),
    "aws_sqs_queue": ("queue", "sqs"),
    "aws_sns_topic": ("queue", "sns"),
    "aws_rds_cluster": ("datastore", "rds"),
    "aws_rds_instance": ("datastore", "rds"),
    "aws_db_instance": ("datastore", "rds"),
    "aws_kinesis_stream": ("queue", "kinesis"),
    "aws_api_gateway_rest_api": ("service", "apigateway"),
    "aws_apigatewayv2_api": ("service", "apigateway"),
    "aws_ecs_service": ("service", "ecs"),
    "aws_ecs_task_definition": ("service", "ecs"),
    "aws_sfn_state_machine": ("service", "stepfunctions"),
    "aws_elasticache_cluster": ("datastore", "elasticache"),
    "aws_msk_cluster": ("queue", "msk"),
}
#: What an image name contains, then kind and subtype; the first match decides.
IMAGE_KINDS = (
    ("postgres", "datastore", "postgres"),
    ("mysql", "datastore", "mysql"),
    ("mariadb", "datastore", "mariadb"),
    ("mongo", "datastore", "mongodb"),
    ("redis", "datastore", "redis"),
    ("dynamodb", "datastore", "dynamodb"),
    ("cassandra", "datastore", "cassandra"),
    ("elasticsearch", "datastore", "elasticsearch"),
    ("opensearch", "datastore", "opensearch"),
    ("rabbitmq", "queue", "rabbitmq"),
    ("kafka", "queue", "kafka"),
    ("sqs", "queue", "sqs"),
    ("nats", "queue", "nats"),
    ("nginx", "gateway", "nginx"),
    ("traefik", "gateway", "traefik"),
    ("envoy", "gateway", "envoy"),
)
#: First parts of a Terraform reference that name no resource.
NOT_RESOURCES = {"var", "local", "data", "module", "each", "count", "path", "terraform", "self"}
#: Kinds of Kubernetes objects by the kind of node they make.
KUBERNETES_KINDS = {
    "Deployment": "service", "StatefulSet": "service", "DaemonSet": "service", "ReplicaSet": "service",
    "CronJob": "job", "Job": "job", "Service": "route", "PersistentVolumeClaim": "datastore", "ConfigMap": "config", "Secret": "config",
}
WORKLOADS = ("Deployment", "StatefulSet", "DaemonSet", "ReplicaSet")


def image_kind(image: str | None) -> tuple[str, str | None]:
    for needle, kind, subtype in IMAGE_KINDS:
        if image and needle in image.lower():
            return kind, subtype
    return "service", None


def _line_at(text: str, offset: int) -> int:
    return text.count("\n", 0, offset) + 1


# Terraform

_RESOURCE = re.compile(r'^[ \t]*resource\s+"([^"\n]+)"\s+"([^"\n]+)"\s*\{', re.M)
_COMMENT = re.compile(r'"(?:\\.|[^"\\\n])*"|#[^\n]*|//[^\n]*|/\*.*?\*/', re.S)


def _block_end(text: str, at: int) -> int:
    """The offset after the brace that closes the block opened just before ``at``; strings are skipped."""
    depth, i = 1, at
    while i < len(text) and depth:
        c = text[i]
        if c == '"':
            i += 1
            while i < len(text) and text[i] != '"' and text[i] != "\n":
                i += 2 if text[i] == "\\" else 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
        i += 1
    if depth:
        raise ValueError("a block is not closed")
    return i


def _references(body: str) -> list[tuple[str, str]]:
    """(type, name) of expressions that begin with a reference: bare, listed, or at the start of ``${``."""
    out: list[tuple[str, str]] = []
    for m in re.finditer(r'"((?:\\.|[^"\\\n])*)"', body):
        out += re.findall(r"\$\{([A-Za-z_][\w-]*)\.([A-Za-z_][\w-]*)", m[1])
    bare = re.sub(r'"(?:\\.|[^"\\\n])*"', '""', body)
    out += re.findall(r"(?:=|\[|,)[ \t\n]*([A-Za-z_][\w-]*)\.([A-Za-z_][\w-]*)", _without_calls(bare))
    return out


def _without_calls(text: str) -> str:
    """The text with the arguments of function calls blanked: what is in them is not a leading reference."""
    out, depth = [], 0
    for c in text:
        depth -= c == ")" and depth > 0
        out.append(" " if depth else c)
        depth += c == "("
    return "".join(out)


def terraform(path: str, text: str) -> tuple[list[Node], list[Edge]]:
    """Resources and the resources that their expressions begin with."""
    clean = _COMMENT.sub(lambda m: m[0] if m[0][0] == '"' else re.sub(r"[^\n]", " ", m[0]), text)
    nodes, edges = [], []
    for m in _RESOURCE.finditer(clean):
        identity, line = f"{m[1]}.{m[2]}", _line_at(clean, m.start() + len(m[0]) - len(m[0].lstrip()))
        kind, subtype = TERRAFORM_KINDS.get(m[1], ("unknown", m[1]))
        nodes.append(Node(identity, kind, subtype, path, line, 0, 1.0, name=m[2], extra={"resource_type": m[1]}))
        seen = set()
        for t, n in _references(clean[m.end() : _block_end(clean, m.end())]):
            if t not in NOT_RESOURCES and (t, n) not in seen:
                seen.add((t, n))
                edges.append(Edge(identity, f"{t}.{n}", path, line, 0, 1.0))
    return nodes, edges


# Compose


def compose(path: str, text: str) -> tuple[list[Node], list[Edge]]:
    """Services, their build contexts and what they depend on."""
    data = yaml.safe_load(text)
    services = data.get("services") if isinstance(data, dict) else None
    nodes, edges = [], []
    for name, spec in (services or {}).items() if isinstance(services, dict) else ():
        spec = spec if isinstance(spec, dict) else {}
        found = re.search(rf"^[ \t]+[\"']?{re.escape(str(name))}[\"']?:[ \t]*(?:#.*)?$", text, re.M)
        line = _line_at(text, found.start()) if found else None
        image, build = spec.get("image"), spec.get("build")
        context = build.get("context") if isinstance(build, dict) else build
        kind, subtype = image_kind(image if isinstance(image, str) else None)
        extra = {k: str(v) for k, v in (("image", image), ("build_context", context)) if v is not None}
        nodes.append(Node(f"compose:{name}", kind, subtype, path, line, 0, 1.0, name=str(name), extra=extra))
        needs = spec.get("depends_on") or []
        for d in needs if isinstance(needs, (list, dict)) else []:
            edges.append(Edge(f"compose:{name}", f"compose:{d}", path, line, 0, 1.0, relation="depends_on"))
    return nodes, edges


# Dockerfiles

_FROM = re.compile(r"^FROM\s+(?:--\S+\s+)*(\S+)(?:\s+AS\s+(\S+))?", re.I)
_COPY_FROM = re.compile(r"^(?:COPY|ADD)\s+(?:--\S+\s+)*?--from=(\S+)", re.I)


def _instructions(text: str) -> list[tuple[int, str]]:
    """(first line, instruction): continued lines joined; comment lines and blanks dropped."""
    out: list[tuple[int, str]] = []
    held, first = "", 0
    for n, raw in enumerate(text.split("\n"), 1):
        line = raw.strip()
        if line.startswith("#") or (not line and not held):
            continue
        if not held:
            first = n
        if line.endswith("\\"):
            held += line[:-1] + " "
            continue
        out.append((first, (held + line).strip()))
        held = ""
    if held.strip():
        out.append((first, held.strip()))
    return out


def dockerfile(path: str, text: str) -> tuple[list[Node], list[Edge]]:
    """Build stages, the stages they extend and copy from, and exposed ports."""
    nodes: list[Node] = []
    edges: list[Edge] = []
    by_name: dict[str, str] = {}

    def stage_of(ref: str) -> str | None:
        if ref.isdigit():
            return nodes[int(ref)].identity if int(ref) < len(nodes) else None
        return by_name.get(ref.lower())

    for line, text_ in _instructions(text):
        if m := _FROM.match(text_):
            name = m[2] or f"stage{len(nodes)}"
            identity, base = f"docker:{path}#{name}", by_name.get(m[1].lower())
            nodes.append(Node(identity, "service", "docker", path, line, 0, 1.0, name=name, extra={"base_image": m[1], "exposed_ports": ""}))
            if base:
                edges.append(Edge(identity, base, path, line, 0, 1.0, relation="extends"))
            by_name[name.lower()] = identity
        elif nodes and (m := _COPY_FROM.match(text_)):
            source = stage_of(m[1])
            if source and source != nodes[-1].identity:
                edges.append(Edge(nodes[-1].identity, source, path, line, 0, 1.0, relation="copies_from"))
        elif nodes and text_.upper().startswith("EXPOSE"):
            ports = [*filter(None, nodes[-1].extra["exposed_ports"].split(",")), *text_.split()[1:]]
            nodes[-1].extra["exposed_ports"] = ",".join(ports)
    return nodes, edges


# Kubernetes

_SEPARATOR = re.compile(r"^---[ \t]*\n", re.M)


def _documents(text: str) -> list[tuple[int, str]]:
    """(offset, text) of each document of a manifest."""
    starts = [0, *(m.end() for m in _SEPARATOR.finditer(text))]
    ends = [*(m.start() for m in _SEPARATOR.finditer(text)), len(text)]
    return [(a, text[a:b]) for a, b in zip(starts, ends, strict=True)]


def _pod_spec(doc: dict) -> dict:
    spec = doc.get("spec")
    pod = ((spec or {}).get("template") or {}).get("spec") if isinstance(spec, dict) and isinstance(spec.get("template"), (dict, type(None))) else None
    return pod if isinstance(pod, dict) else {}


def _pod_labels(doc: dict) -> dict:
    try:
        return dict(doc["spec"]["template"]["metadata"]["labels"])
    except (KeyError, TypeError, ValueError):
        return {}


def _mounted(pod: dict) -> list[tuple[str, str]]:
    """(kind, name) of the configuration and storage that a pod reads."""
    out = []
    for c in pod.get("containers") or []:
        for e in (c.get("envFrom") or []) if isinstance(c, dict) else []:
            for field, kind in (("configMapRef", "ConfigMap"), ("secretRef", "Secret")):
                if isinstance(e, dict) and isinstance(e.get(field), dict) and e[field].get("name"):
                    out.append((kind, e[field]["name"]))
    for v in pod.get("volumes") or []:
        for field, kind, key in (("configMap", "ConfigMap", "name"), ("secret", "Secret", "secretName"), ("persistentVolumeClaim", "PersistentVolumeClaim", "claimName")):
            if isinstance(v, dict) and isinstance(v.get(field), dict) and v[field].get(key):
                out.append((kind, v[field][key]))
    return out


def kubernetes(path: str, text: str) -> tuple[list[Node], list[Edge]]:
    """Named objects, what pods mount or read, and services routed to workloads by selector.

    A document that cannot be parsed is left out alone.
    """
    nodes: list[Node] = []
    edges: list[Edge] = []
    workloads: list[tuple[str, str, dict]] = []
    routes: list[tuple[str, str, dict, int | None]] = []
    for offset, part in _documents(text):
        try:
            doc = yaml.safe_load(part)
        except yaml.YAMLError:
            continue
        meta = doc.get("metadata") if isinstance(doc, dict) else None
        if not isinstance(meta, dict) or not meta.get("name") or not doc.get("kind"):
            continue
        kind, name, space = str(doc["kind"]), str(meta["name"]), str(meta.get("namespace") or "default")
        identity = f"{kind}/{space}/{name}"
        found = re.search(rf"^\s*name:[ \t]*[\"']?{re.escape(name)}[\"']?[ \t]*(?:#.*)?$", part, re.M)
        line = _line_at(text, offset + found.start() + len(found[0]) - len(found[0].lstrip())) if found else None
        nodes.append(Node(identity, KUBERNETES_KINDS.get(kind, "unknown"), kind, path, line, 0, 1.0, name=name, extra={"k8s_kind": kind, "namespace": space}))
        for what, target in _mounted(_pod_spec(doc)):
            edges.append(Edge(identity, f"{what}/{space}/{target}", path, line, 0, 1.0, relation="mounts_or_reads"))
        if kind in WORKLOADS:
            workloads.append((identity, space, _pod_labels(doc)))
        selector = doc["spec"].get("selector") if kind == "Service" and isinstance(doc.get("spec"), dict) else None
        if isinstance(selector, dict) and selector:
            routes.append((identity, space, selector, line))
    for service, space, selector, line in routes:
        for workload, where, labels in workloads:
            if where == space and all(k in labels and labels[k] == v for k, v in selector.items()):
                edges.append(Edge(service, workload, path, line, 0, 1.0, relation="routes_to"))
    return nodes, edges
