"""Regular-expression rules over comment-blanked source text."""

from __future__ import annotations

import re
from dataclasses import dataclass

import yaml

from .records import Node

#: Language of a file by its suffix.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "javascript", ".tsx": "javascript", ".go": "go", ".java": "java"}
#: The built-in catalogue (a folder of YAML files in the same form may replace it).
CATALOGUE = r"""
- {id: aws-s3-client, kind: datastore, subtype: s3, confidence: 0.75, patterns: [
    {lang: python, match: 'boto3\.(?:client|resource)\(\s*["'']s3["'']'},
    {lang: javascript, match: 'new\s+(?:S3Client|AWS\.S3)\('},
    {lang: go, match: 's3\.(?:New|NewFromConfig)\('}]}
- {id: aws-s3-bucket-name, kind: datastore, subtype: s3, confidence: 0.9, capture_arg: bucket_name, patterns: [
    {lang: python, match: '\.Bucket\(\s*["''](?P<value>[\w.-]+)["'']\)'}]}
- {id: aws-dynamodb-client, kind: datastore, subtype: dynamodb, confidence: 0.75, patterns: [
    {lang: python, match: 'boto3\.(?:client|resource)\(\s*["'']dynamodb["'']'},
    {lang: javascript, match: 'new\s+DynamoDBClient\('},
    {lang: go, match: 'dynamodb\.(?:New|NewFromConfig)\('}]}
- {id: aws-sqs-client, kind: queue, subtype: sqs, confidence: 0.75, patterns: [
    {lang: python, match: 'boto3\.client\(\s*["'']sqs["'']'},
    {lang: javascript, match: 'new\s+SQSClient\('},
    {lang: go, match: 'sqs\.(?:New|NewFromConfig)\('}]}
- {id: postgres-client, kind: datastore, subtype: postgres, confidence: 0.75, patterns: [
    {lang: python, match: 'psycopg2\.connect\('},
    {lang: javascript, match: 'require\(\s*["'']pg["'']\)'},
    {lang: go, match: 'sql\.Open\(\s*["'']postgres["'']'}]}
- {id: redis-client, kind: datastore, subtype: redis, confidence: 0.75, patterns: [
    {lang: python, match: 'redis\.(?:Redis|StrictRedis)\('},
    {lang: javascript, match: 'new\s+Redis\('},
    {lang: go, match: 'redis\.NewClient\('}]}
"""


@dataclass(frozen=True)
class Rule:
    """One pattern of a rule, for one language."""

    id: str
    kind: str
    subtype: str | None
    confidence: float
    capture: str | None
    lang: str
    pattern: re.Pattern


def load_rules(text: str = CATALOGUE) -> list[Rule]:
    """Rules from YAML; a missing field, a bad pattern or a capture without its group is an error."""
    out = []
    for r in yaml.safe_load(text) or []:
        lacking = [k for k in ("id", "kind", "confidence", "patterns") if k not in r]
        if lacking:
            raise ValueError(f"rule {r.get('id', '?')}: no {', '.join(lacking)}")
        for p in r["patterns"]:
            if "lang" not in p or "match" not in p:
                raise ValueError(f"rule {r['id']}: a pattern needs lang and match")
            pattern = re.compile(p["match"])
            if r.get("capture_arg") and "value" not in pattern.groupindex:
                raise ValueError(f"rule {r['id']}: capture_arg needs a group named value")
            out.append(Rule(r["id"], r["kind"], r.get("subtype"), float(r["confidence"]), r.get("capture_arg"), p["lang"], pattern))
    return out


def blank_comments(text: str, lang: str) -> str:
    """The text with comments turned into spaces; offsets and line ends stay."""
    pattern = r"#[^\n]*" if lang == "python" else r"//[^\n]*|/\*.*?(?:\*/|\Z)"
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def scan(path: str, text: str, rules: list[Rule]) -> list[Node]:
    """A node for each match; one that captures a value is the same node wherever the value stands."""
    lang = LANGUAGES.get("." + path.rsplit(".", 1)[-1])
    if lang is None:
        return []
    code, nodes = blank_comments(text, lang), []
    for r in rules:
        for m in r.pattern.finditer(code) if r.lang == lang else ():
            line = code.count("\n", 0, m.start()) + 1
            value = m["value"] if r.capture else None
            identity = f"{r.id}:{value}" if r.capture else f"{r.id}:{path}:{line}"
            extra = {"rule_id": r.id} | ({r.capture: value} if r.capture else {})
            nodes.append(Node(identity, r.kind, r.subtype, path, line, 1, r.confidence, name=value or r.id, extra=extra))
    return nodes
