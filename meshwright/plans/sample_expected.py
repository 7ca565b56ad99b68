"""What the embedded repository must give: rows as lines, ``-`` for null, each checked by hand against its texts.

The SQL of the code queries is made of these rows; what follows from others (containment,
degrees, unresolved names) is derived in SQL.
"""

from __future__ import annotations

#: identity, kind, subtype, file, line, tier, confidence, qualname, signature
EVIDENCE = """
Deployment/default/web | service | Deployment | deploy/k8s.yaml | 3 | 0 | 1.0 | - | -
Secret/default/keys | config | Secret | deploy/k8s.yaml | 21 | 0 | 1.0 | - | -
Service/default/web-svc | route | Service | deploy/k8s.yaml | 15 | 0 | 1.0 | - | -
app/__init__.py | module | - | app/__init__.py | 1 | 2 | 1.0 |  | -
app/base.py | module | - | app/base.py | 1 | 2 | 1.0 |  | -
app/base.py:Base | class | - | app/base.py | 1 | 2 | 1.0 | Base | class Base
app/base.py:Base.check | function | - | app/base.py | 4 | 2 | 1.0 | Base.check | def check(self)
app/base.py:helper | function | - | app/base.py | 8 | 2 | 1.0 | helper | def helper()
app/base.py:helper.inner | function | - | app/base.py | 9 | 2 | 1.0 | helper.inner | def inner()
app/broken.py | module | - | app/broken.py | 1 | 2 | 1.0 |  | -
app/cloud.py | module | - | app/cloud.py | 1 | 2 | 1.0 |  | -
app/cloud.py:up | function | - | app/cloud.py | 4 | 2 | 1.0 | up | def up()
app/models.py | module | - | app/models.py | 1 | 2 | 1.0 |  | -
app/models.py:Car | class | - | app/models.py | 9 | 2 | 1.0 | Car | class Car(Base)
app/models.py:Car.__init__ | function | - | app/models.py | 10 | 2 | 1.0 | Car.__init__ | def __init__(self, engine: Engine)
app/models.py:Car.drive | function | - | app/models.py | 13 | 2 | 1.0 | Car.drive | def drive(self)
app/models.py:Car.honk | function | - | app/models.py | 17 | 2 | 1.0 | Car.honk | def honk(self)
app/models.py:Engine | class | - | app/models.py | 4 | 2 | 1.0 | Engine | class Engine
app/models.py:Engine.start | function | - | app/models.py | 5 | 2 | 1.0 | Engine.start | def start(self) -> bool
app/service.py | module | - | app/service.py | 1 | 2 | 1.0 |  | -
app/service.py:make_car | function | - | app/service.py | 9 | 2 | 1.0 | make_car | def make_car() -> Car
app/service.py:make_queue | function | - | app/service.py | 13 | 2 | 1.0 | make_queue | def make_queue(n)
app/service.py:run | function | - | app/service.py | 18 | 2 | 1.0 | run | def run(callback=aid)
aws-s3-bucket-name:raw-data | datastore | s3 | app/cloud.py | 7 | 1 | 0.9 | - | -
aws-s3-client:app/cloud.py:6 | datastore | s3 | app/cloud.py | 6 | 1 | 0.75 | - | -
aws_lambda_function.norm | service | lambda | deploy/main.tf | 5 | 0 | 1.0 | - | -
aws_s3_bucket.raw | datastore | s3 | deploy/main.tf | 1 | 0 | 1.0 | - | -
compose:api | service | - | deploy/docker-compose.yml | 2 | 0 | 1.0 | - | -
compose:db | datastore | postgres | deploy/docker-compose.yml | 5 | 0 | 1.0 | - | -
docker:deploy/Dockerfile#build | service | docker | deploy/Dockerfile | 1 | 0 | 1.0 | - | -
docker:deploy/Dockerfile#stage2 | service | docker | deploy/Dockerfile | 5 | 0 | 1.0 | - | -
docker:deploy/Dockerfile#test | service | docker | deploy/Dockerfile | 4 | 0 | 1.0 | - | -
web/card.tsx | module | - | web/card.tsx | 1 | 2 | 1.0 |  | -
web/card.tsx:Card | class | - | web/card.tsx | 3 | 2 | 1.0 | Card | export class Card
web/card.tsx:Card.label | function | - | web/card.tsx | 8 | 2 | 1.0 | Card.label | label()
web/card.tsx:Card.render | function | - | web/card.tsx | 5 | 2 | 1.0 | Card.render | render(): string
web/card.tsx:Page | function | - | web/card.tsx | 13 | 2 | 1.0 | Page | export const Page = (p: Props) =>
web/index.ts | module | - | web/index.ts | 1 | 2 | 1.0 |  | -
web/main.ts | module | - | web/main.ts | 1 | 2 | 1.0 |  | -
web/main.ts:main | function | - | web/main.ts | 4 | 2 | 1.0 | main | function main()
web/util.ts | module | - | web/util.ts | 1 | 2 | 1.0 |  | -
web/util.ts:helper | function | - | web/util.ts | 2 | 2 | 1.0 | helper | export function helper(x: string): string
"""

#: src, dst, relation, kind, file, line, chain
RAW_EDGES = """
Deployment/default/web | Secret/default/keys | mounts_or_reads | - | deploy/k8s.yaml | 3 | 
Service/default/web-svc | Deployment/default/web | routes_to | - | deploy/k8s.yaml | 15 | 
app/base.py:Base.check | helper | - | - | app/base.py | 5 | helper
app/base.py:helper | inner | - | - | app/base.py | 12 | inner
app/base.py:helper.inner | helper | - | - | app/base.py | 10 | helper
app/cloud.py | boto3 | - | import | app/cloud.py | 1 | 
app/cloud.py:up | boto3.client | - | - | app/cloud.py | 6 | boto3.client
app/cloud.py:up | s3.Bucket | - | - | app/cloud.py | 7 | s3.Bucket
app/models.py | .base | - | import | app/models.py | 1 | 
app/models.py:Car | Base | inherits | - | app/models.py | 9 | Base
app/models.py:Car.drive | self.check | - | - | app/models.py | 14 | self.check
app/models.py:Car.drive | self.engine.start | - | - | app/models.py | 15 | self.engine.start
app/service.py | LIMIT | references | - | app/service.py | 6 | LIMIT
app/service.py | app.base | - | import | app/service.py | 3 | 
app/service.py | app.models | - | import | app/service.py | 1 | 
app/service.py | app.models | - | import | app/service.py | 2 | 
app/service.py | make_queue | - | - | app/service.py | 6 | make_queue
app/service.py:make_car | Car | - | - | app/service.py | 10 | Car
app/service.py:make_car | Engine | - | - | app/service.py | 10 | Engine
app/service.py:run | aid | - | - | app/service.py | 24 | aid
app/service.py:run | app.models.Engine | - | - | app/service.py | 21 | app.models.Engine
app/service.py:run | car.drive | - | - | app/service.py | 20 | car.drive
app/service.py:run | make_car | references | - | app/service.py | 22 | make_car
app/service.py:run | make_car | - | - | app/service.py | 19 | make_car
app/service.py:run | make_queue | built_by | - | app/service.py | 23 | make_queue
app/service.py:run | queue.append | - | - | app/service.py | 23 | queue.append
app/service.py:run | schedule | - | - | app/service.py | 22 | schedule
app/service.py:run | unknown_thing | - | - | app/service.py | 25 | unknown_thing
aws_lambda_function.norm | aws_s3_bucket.raw | - | - | deploy/main.tf | 5 | 
compose:api | compose:db | depends_on | - | deploy/docker-compose.yml | 2 | 
docker:deploy/Dockerfile#stage2 | docker:deploy/Dockerfile#build | copies_from | - | deploy/Dockerfile | 6 | 
docker:deploy/Dockerfile#test | docker:deploy/Dockerfile#build | extends | - | deploy/Dockerfile | 4 | 
web/card.tsx | ./util | - | import | web/card.tsx | 1 | 
web/card.tsx:Card.label | helper | - | - | web/card.tsx | 9 | helper
web/card.tsx:Card.render | helper | - | - | web/card.tsx | 6 | helper
web/card.tsx:Card.render | this.label | - | - | web/card.tsx | 6 | this.label
web/card.tsx:Page | Card | - | - | web/card.tsx | 14 | Card
web/card.tsx:Page | Frame | - | - | web/card.tsx | 14 | Frame
web/main.ts | . | - | import | web/main.ts | 1 | 
web/main.ts | ./util | - | import | web/main.ts | 2 | 
web/main.ts:main | Card | - | - | web/main.ts | 7 | Card
web/main.ts:main | aid | - | - | web/main.ts | 5 | aid
web/main.ts:main | help | - | - | web/main.ts | 6 | help
"""

#: src, dst, relation, file, line; without containment
RESOLVED = """
Deployment/default/web | Secret/default/keys | mounts_or_reads | deploy/k8s.yaml | 3
Service/default/web-svc | Deployment/default/web | routes_to | deploy/k8s.yaml | 15
app/base.py:Base.check | app/base.py:helper | calls | app/base.py | 5
app/base.py:helper | app/base.py:helper.inner | calls | app/base.py | 12
app/base.py:helper.inner | app/base.py:helper | calls | app/base.py | 10
app/models.py:Car | app/base.py:Base | inherits | app/models.py | 9
app/models.py:Car.drive | app/base.py:Base.check | calls | app/models.py | 14
app/models.py:Car.drive | app/models.py:Engine.start | calls | app/models.py | 15
app/service.py | app/service.py:make_queue | calls | app/service.py | 6
app/service.py:make_car | app/models.py:Car | calls | app/service.py | 10
app/service.py:make_car | app/models.py:Engine | calls | app/service.py | 10
app/service.py:run | app/base.py:helper | calls | app/service.py | 24
app/service.py:run | app/models.py:Car.drive | calls | app/service.py | 20
app/service.py:run | app/models.py:Engine | calls | app/service.py | 21
app/service.py:run | app/service.py:make_car | calls | app/service.py | 19
app/service.py:run | app/service.py:make_car | references | app/service.py | 22
app/service.py:run | app/service.py:make_queue | built_by | app/service.py | 23
aws_lambda_function.norm | aws_s3_bucket.raw | calls | deploy/main.tf | 5
compose:api | compose:db | depends_on | deploy/docker-compose.yml | 2
docker:deploy/Dockerfile#stage2 | docker:deploy/Dockerfile#build | copies_from | deploy/Dockerfile | 6
docker:deploy/Dockerfile#test | docker:deploy/Dockerfile#build | extends | deploy/Dockerfile | 4
web/card.tsx:Card.label | web/util.ts:helper | calls | web/card.tsx | 9
web/card.tsx:Card.render | web/card.tsx:Card.label | calls | web/card.tsx | 6
web/card.tsx:Card.render | web/util.ts:helper | calls | web/card.tsx | 6
web/card.tsx:Page | web/card.tsx:Card | calls | web/card.tsx | 14
web/main.ts:main | web/card.tsx:Card | calls | web/main.ts | 7
web/main.ts:main | web/util.ts:helper | calls | web/main.ts | 5
web/main.ts:main | web/util.ts:helper | calls | web/main.ts | 6
"""

#: src, dst, relation, n, line
LINKS = """
app/base.py:Base.check | app/base.py:helper | call | 1 | 5
app/base.py:helper | app/base.py:helper.inner | call | 1 | 12
app/base.py:helper.inner | app/base.py:helper | call | 1 | 10
app/models.py:Car | app/base.py:Base | inherits | 1 | 9
app/models.py:Car.drive | app/base.py:Base.check | call | 1 | 14
app/models.py:Car.drive | app/models.py:Engine.start | call | 1 | 15
app/service.py | app/service.py:make_queue | call | 1 | 6
app/service.py:make_car | app/models.py:Car | call | 1 | 10
app/service.py:make_car | app/models.py:Engine | call | 1 | 10
app/service.py:run | app/base.py:helper | call | 1 | 24
app/service.py:run | app/models.py:Car.drive | call | 1 | 20
app/service.py:run | app/models.py:Engine | call | 1 | 21
app/service.py:run | app/service.py:make_car | call | 1 | 19
app/service.py:run | app/service.py:make_car | reference | 1 | 22
app/service.py:run | app/service.py:make_queue | built_by | 1 | 23
web/card.tsx:Card.label | web/util.ts:helper | call | 1 | 9
web/card.tsx:Card.render | web/card.tsx:Card.label | call | 1 | 6
web/card.tsx:Card.render | web/util.ts:helper | call | 1 | 6
web/card.tsx:Page | web/card.tsx:Card | jsx | 1 | 14
web/main.ts:main | web/card.tsx:Card | call | 1 | 7
web/main.ts:main | web/util.ts:helper | call | 2 | 5
"""


def values(rows: str, columns: str) -> str:
    """``SELECT`` of a block of rows; ``columns`` is DDL, and the types are those of DuckDB."""
    names = [c.split() for c in columns.split(", ")]

    def cell(v: str) -> str:
        return "NULL" if v == "-" else "'" + v.replace("'", "''") + "'"

    lines = ["(" + ", ".join(map(cell, line.split(" | "))) + ")" for line in rows.strip("\n").split("\n")]
    return f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in names)} FROM (VALUES {', '.join(lines)}) AS t({', '.join(n for n, _ in names)})"


EVIDENCE_SQL = values(EVIDENCE, "identity VARCHAR, kind VARCHAR, subtype VARCHAR, file VARCHAR, line INTEGER, tier INTEGER, confidence DOUBLE, qualname VARCHAR, signature VARCHAR")
RAW_SQL = values(RAW_EDGES, "src VARCHAR, dst VARCHAR, relation VARCHAR, kind VARCHAR, file VARCHAR, line INTEGER, chain VARCHAR")
LINKS_SQL = values(LINKS, "src VARCHAR, dst VARCHAR, relation VARCHAR, n BIGINT, line BIGINT")
_RESOLVED = values(RESOLVED, "src VARCHAR, dst VARCHAR, relation VARCHAR, file VARCHAR, line INTEGER")
#: The service built from app/ contains every module, definition and rule hit below it.
RESOLVED_SQL = f"""
{_RESOLVED} UNION ALL
SELECT 'compose:api', identity, 'build_context_contains', 'deploy/docker-compose.yml', CAST(2 AS INTEGER) FROM ({EVIDENCE_SQL}) WHERE tier > 0 AND starts_with(file, 'app/')"""
#: Calls and values at a line of a caller that no resolved edge of the same line and name has.
UNRESOLVED_SQL = f"""
WITH raw AS ({RAW_SQL}), done AS ({_RESOLVED}), calls AS (SELECT src, dst, file, line, row_number() OVER () AS id FROM raw WHERE kind IS NULL AND relation IS NULL AND dst NOT IN (SELECT identity FROM ({EVIDENCE_SQL}))),
met AS (SELECT c.id FROM calls c JOIN done d ON d.src = c.src AND d.line = c.line WHERE d.relation = 'calls' AND (c.dst IN ('aid', 'help') OR string_split(c.dst, '.')[-1] = regexp_extract(d.dst, '[A-Za-z_]+$')))
SELECT src, CAST(count(*) AS BIGINT) AS n, string_agg(DISTINCT dst, ', ' ORDER BY dst) AS names FROM calls WHERE id NOT IN (SELECT id FROM met) GROUP BY src"""
DEGREE_SQL = f"""
WITH l AS ({LINKS_SQL}) SELECT id, CAST(count(*) AS BIGINT) AS degree FROM (SELECT DISTINCT src AS id, 'out' AS side, dst AS other, relation FROM l UNION ALL SELECT DISTINCT dst, 'in', src, relation FROM l) GROUP BY id"""
ERRORS_SQL = "SELECT 'app/broken.py' AS rel_path, 'python@1' AS extractor, 'SyntaxError: invalid syntax (<unknown>, line 1)' AS problem"
