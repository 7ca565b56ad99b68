"""A small repository in memory, with one case of each thing that the extractors know."""

FILES = {
    "app/__init__.py": '"""The app."""\n',
    "app/models.py": (
        "from .base import Base\n\n\nclass Engine:\n    def start(self) -> bool:\n        return True\n\n\n"
        "class Car(Base):\n    def __init__(self, engine: Engine):\n        self.engine = engine\n\n"
        "    def drive(self):\n        self.check()\n        return self.engine.start()\n\n    def honk(self):\n        return []\n"
    ),
    "app/base.py": 'class Base:\n    """Common things."""\n\n    def check(self):\n        return helper()\n\n\ndef helper():\n    def inner():\n        return helper()\n\n    return inner()\n',
    "app/service.py": (
        "import app.models\nfrom app.models import Car, Engine\nfrom app.base import helper as aid\n\nLIMIT = 10\nqueue = make_queue(LIMIT)\n\n\n"
        "def make_car() -> Car:\n    return Car(Engine())\n\n\ndef make_queue(n):\n    return [n]\n\n\n"
        "@aid\ndef run(callback=aid):\n    car = make_car()\n    car.drive()\n    app.models.Engine()\n    schedule(make_car)\n    queue.append(1)\n    aid()\n    unknown_thing()\n"
    ),
    "app/broken.py": "def f(:\n",
    "web/index.ts": "export * from './card';\nexport { helper as aid } from './util';\n",
    "web/card.tsx": "import { helper } from './util';\n\nexport class Card {\n  title = 'x';\n  render(): string {\n    return helper(this.label());\n  }\n  label() {\n    return `a ${helper('b')} c`;\n  }\n}\n\nexport const Page = (p: Props) => {\n  return <Frame><Card title=\"t\" /></Frame>;\n};\n",
    "web/util.ts": "/** Helps. */\nexport function helper(x: string): string {\n  return x; // helper('no')\n}\nexport default helper;\n",
    "web/main.ts": "import { aid, Card } from '.';\nimport help from './util';\n\nfunction main() {\n  aid('x');\n  help('y');\n  new Card();\n}\n",
    "deploy/docker-compose.yml": "services:\n  api:\n    build: ../app\n    depends_on: [db]\n  db:\n    image: postgres:16\n",
    "deploy/Dockerfile": "FROM python:3.13 AS build\nRUN true \\\n  && true\nFROM build AS test\nFROM python:3.13\nCOPY --from=build /x /y\nEXPOSE 80 443\n",
    "deploy/main.tf": 'resource "aws_s3_bucket" "raw" {\n  bucket = "raw"\n}\n\nresource "aws_lambda_function" "norm" {\n  bucket = aws_s3_bucket.raw.id\n  name   = var.name\n  j      = jsonencode(aws_s3_bucket.raw.arn)\n}\n',
    "deploy/k8s.yaml": (
        "kind: Deployment\nmetadata:\n  name: web\nspec:\n  template:\n    metadata:\n      labels: {app: web}\n    spec:\n      containers:\n        - envFrom:\n            - secretRef: {name: keys}\n"
        "---\nkind: Service\nmetadata:\n  name: web-svc\nspec:\n  selector: {app: web}\n---\nkind: Secret\nmetadata:\n  name: keys\n"
    ),
    "app/cloud.py": "import boto3\n\n\ndef up():\n    # boto3.client('sqs')\n    s3 = boto3.client('s3')\n    return s3.Bucket('raw-data')\n",
}
