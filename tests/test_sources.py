"""Readers of trees and manifests on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as fn
from gristmill.sources import manifests, trees
from tests.conftest import same_rows

DEPLOY = """
apiVersion: apps/v1
kind: Deployment
metadata: {name: orders}
spec:
  template:
    spec:
      containers:
        - name: app
          image: registry.example:5000/team/orders:1.2
          envFrom: [{configMapRef: {name: shared}}]
          env: [{name: X, valueFrom: {configMapKeyRef: {name: extra, key: x}}}, {name: Y, value: "on"}]
      volumes:
        - secret: {secretName: keys, items: [{key: public.pem}]}
---
kind: ConfigMap
metadata: {name: shared}
data: {LEDGER_API_ADDR: "ledger:8080", DB_URL: "jdbc:postgresql://user:pw@ledger-db:5432/x", PLAIN: hello}
---
kind: Service
metadata: {name: none}
"""
API = """
openapi: 3.0.0
info: {title: Orders}
paths:
  /orders/{id}: {get: {}, parameters: [], POST: {}}
components: {securitySchemes: {bearerAuth: {type: http, scheme: bearer}}}
"""
CFN = """
Resources:
  Root: {Type: AWS::ApiGateway::Resource, Properties: {PathPart: tiers, ParentId: !GetAtt Api.RootResourceId}}
  Leaf: {Type: AWS::ApiGateway::Resource, Properties: {PathPart: "{id}", ParentId: !Ref Root}}
  Get: {Type: AWS::ApiGateway::Method, Properties: {HttpMethod: GET, ResourceId: !Ref Leaf, Integration: {Uri: !Sub "arn:x/${Fn.Arn}/invocations"}}}
  Pre: {Type: AWS::ApiGateway::Method, Properties: {HttpMethod: OPTIONS, ResourceId: !Ref Leaf, Integration: {Uri: !Sub "arn:x/${Fn.Arn}/y"}}}
"""
CFN2 = "Resources:\n  Fn: {Type: AWS::Lambda::Function, Properties: {Handler: com.x.GetTiers::handle}}\n"
SPRING = "spring:\n  datasource: {url: 'jdbc:mysql://a/b'}\n  flags: [a, 2]\nserver: {ssl: true, port: 8080}\n---\nserver: {port: 9090}\n---\nspring: {config: {activate: {on-profile: prod}}, datasource: {url: x}}\n"


@pytest.fixture(scope="module")
def files(spark):
    rows = [("r", "k8s/a.yaml", DEPLOY), ("r", "openapi.yaml", API), ("r", "cfn/a.yml", CFN), ("r", "cfn/b.yml", CFN2), ("r", "src/application.yml", SPRING), ("r", "src/application-dev.properties", "# c\nspring.redis.host = cache\nbad line\n"), ("r", "bad.yaml", "a: [1"), ("r", "null.yaml", None),
            ("r", "bom.json", json.dumps({"bomFormat": "CycloneDX", "components": [{"name": "pymongo", "version": "1", "purl": "pkg:x"}]}))]
    return spark.createDataFrame(rows, "root string, file string, text string")


needs_yaml = pytest.mark.skipif(manifests.yaml is None, reason="no YAML reader here")


@needs_yaml
def test_manifests(files):
    d = manifests.k8s_deployments(files).collect()
    assert [(r.name, r.namespace, r.image, r.container_name, r.config_map_names) for r in d] == [("orders", "default", "registry.example:5000/team/orders:1.2", "app", ["shared", "extra"])]
    assert [tuple(m) for m in d[0].secret_mounts] == [("keys", ["public.pem"])]
    same_rows(manifests.k8s_config_keys(files).select("config_map", "key", "host").collect(), [("shared", "LEDGER_API_ADDR", "ledger"), ("shared", "DB_URL", "ledger-db"), ("shared", "PLAIN", None)])
    same_rows(manifests.openapi_operations(files).select("title", "path", "method").collect(), [("Orders", "/orders/{id}", "GET"), ("Orders", "/orders/{id}", "POST")])
    same_rows(manifests.openapi_schemes(files).select("name", "type", "scheme").collect(), [("bearerAuth", "http", "bearer")])
    same_rows(manifests.cfn_routes(files).collect(), [("/tiers/{id}", "GET", "com.x.GetTiers::handle")])
    p = {(r.profile, r.doc_profile, r.key): r.value for r in manifests.spring_properties(files).collect()}
    assert p[(None, None, "server.port")] == "9090" and p[(None, None, "server.ssl")] == "true" and p[(None, None, "spring.flags")] == "a,2"
    assert p[(None, "prod", "spring.datasource.url")] == "x" and p[("dev", None, "spring.redis.host")] == "cache" and len(p) == 7
    same_rows(manifests.sbom_components(files).collect(), [("r", "pymongo", "1", "pkg:x")])
    assert [r.file for r in manifests.documents(files).where("error is not null").collect()] == ["bad.yaml"]


@needs_yaml
def test_repo_contracts_refuse_what_names_nothing(spark):
    good = spark.createDataFrame([("r", "a.yaml", "repo: x\npublishes: [{nodeId: n, name: N, apiSpec: {title: T}}]")], "root string, file string, text string")
    assert [tuple(r)[:5] for r in manifests.repo_contracts(good).collect()] == [("x", 0, "n", "N", "T")]
    bad = spark.createDataFrame([("r", "a.yaml", "repo: x\npublishes: [{nodeId: n, name: N}]")], "root string, file string, text string")
    with pytest.raises(Exception, match="without identity"):
        manifests.repo_contracts(bad).collect()


JAVA = """﻿package com.x;
import com.y.Store;
@Service
public class Orders extends Base<Store, Item>
    implements Port {
  private final Store store;
  @GetMapping("/orders")
  public Item one(long id) {
    return store.load(id, 3);
  }
}
"""


def test_tree_facts(spark, tmp_path):
    (tmp_path / "repo" / "src").mkdir(parents=True)
    (tmp_path / "repo" / "node_modules").mkdir()
    (tmp_path / "repo" / "src" / "Orders.java").write_text(JAVA)
    (tmp_path / "repo" / "node_modules" / "x.java").write_text("class X {}")
    (tmp_path / "repo" / "Dockerfile").write_text("FROM scratch")
    files = trees.resolve_roots(trees.read_files(spark, str(tmp_path)), [str(tmp_path / "repo")])
    same_rows(trees.source_files(files).select("root", "file", "language").collect(), [("repo", "src/Orders.java", "java"), ("repo", "Dockerfile", None)])
    same_rows(trees.deployable_roots(files).collect(), [("repo", "Dockerfile")])
    lines = trees.source_lines(files.where("file like '%.java'")).cache()
    assert lines.count() == 12
    same_rows(trees.decorator_facts(lines).select("line", "reference_name", "argument").collect(), [(3, "Service", None), (7, "GetMapping", "/orders")])
    same_rows(trees.call_facts(lines).select("line", "reference_name", "argument").collect(), [(9, "load", "id, 3")])
    same_rows(trees.class_headers(lines).select("line", "name").collect(), [(4, "Orders")])
    assert "implements Port" in trees.class_headers(lines).first().header
    same_rows(trees.extends_facts(lines).select("reference_name").collect(), [("Base",)])
    types = spark.createDataFrame([("Store",), ("Orders",)], "label string")
    same_rows(trees.generic_argument_edges(lines, types).select("source", "target").collect(), [("Orders", "Store")])
    same_rows(trees.package_of(lines).select("package").collect(), [("com.x",)])
    assert trees.has_field_of(lines, "Store").count() == 1 and trees.has_field_of(lines, "Other").count() == 0
    assert trees.common_ancestor(["/a/b/c", "/a/b/d"]) == "/a/b" and trees.excluded(["/a/b"], ["/a", "/a/b/c", "/a/x"]) == ["/a/x"]


def exploded(spark, n=3):
    """Lines of which the planner cannot know how many there are, though they may be very many."""
    rows = "explode(array(struct(1 as line, '@Configuration' as text), struct(2 as line, concat('public class P', id, ' extends Base<P', id + 1, '> {') as text))) as l"
    return spark.range(n).selectExpr("'r' as root", "concat('f', id) as file", rows).select("root", "file", "l.*")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_headers_take_no_join(spark):
    got = trees.class_headers(exploded(spark))
    assert "Join" not in plan(got) and "Broadcast" not in plan(got)
    same_rows(got.collect(), [("r", f"f{i}", 2, f"P{i}", f"public class P{i} extends Base<P{i + 1}> ") for i in range(3)])


def test_headers_over_the_ends_of_blocks(spark):
    b = trees.BLOCK
    at = (1, b - 9, b - 1, b, 2 * b - 1, 5 * b - 1)
    rows = [("r", "f", i + k, f"class C{i} a" if k == 0 else None if k == 3 else f"t{k}") for i in at for k in range(12) if i + k not in at or k == 0]
    rows += [("r", "f", 9 * b, "class X"), ("r", "f", 9 * b, "class X"), ("r", "f", 9 * b, "class X {"), ("r", None, 1, "class N"), ("r", "f", None, "class N"), ("r", "f", -1, "class M {")]
    got = trees.class_headers(spark.createDataFrame(rows, "root string, file string, line int, text string")).collect()
    lines = sorted({r for r in rows if None not in r[:3]}, key=lambda r: (r[2], r[3] is not None, r[3] or ""))
    want = {("r", "f", r[2], r[3].split()[1], " ".join(x[3] for x in lines if r[2] <= x[2] < r[2] + 10 and x[3] is not None).split("{")[0]) for r in lines if r[3] and r[3].startswith("class ")}
    same_rows(got, want)


def test_generic_arguments_broadcast_no_types(spark):
    lines = exploded(spark)
    got = trees.generic_argument_edges(lines, trees.class_headers(lines).select(F.col("name").alias("label")))
    assert "Broadcast" not in plan(got)
    same_rows(got.collect(), [("r", f"f{i}", f"P{i}", f"P{i + 1}", "references") for i in range(2)])


def test_annotated_classes_take_no_join(spark):
    got = trees.annotated_classes(exploded(spark), "Configuration")
    assert "Join" not in plan(got) and "Broadcast" not in plan(got)
    same_rows(got.collect(), [("r", f"f{i}", 2, f"P{i}") for i in range(3)])


def test_annotations_over_the_ends_of_blocks(spark):
    b = trees.BLOCK
    rows = []
    for i, (gap, stop) in enumerate([(1, False), (10, False), (11, False), (10, True), (3, False)]):
        at = (i + 1) * b + 4
        rows += [("r", "f", at - gap, "  @Wired(1)"), ("r", "f", at, f"class C{i} {{"), *([("r", "f", at - 5, "int x;")] if stop else [("r", "f", at - 2, "// x"), ("r", "f", at - 1, None)] if gap > 2 else [])]
    rows += [("r", "f", 9 * b - 1, "@Wired"), ("r", "f", 9 * b, "class D"), ("r", "f", 9 * b, " class D "), ("r", None, 2, "class N"), ("r", None, 1, "@Wired"), ("r", "g", 0, "@Wired"), ("r", "g", 1, "class G"), ("r", "g", -2, "@Wired"), ("r", "g", -1, "class H")]
    got = trees.annotated_classes(spark.createDataFrame(rows, "root string, file string, line int, text string"), "Wired").collect()
    same_rows(got, [("r", "f", b + 4, "C0"), ("r", "f", 2 * b + 4, "C1"), ("r", "f", 5 * b + 4, "C4"), ("r", "f", 9 * b, "D"), ("r", "g", 1, "G")])


def test_text_functions(spark):
    def one(f, *values):
        return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x"))).collect()]

    assert one(fn.is_test_path, "src/test/A.java", "src/ATest.java", "test_a.py", "a.spec.ts", "src/contest/a.py", None) == [True, True, True, True, False, False]
    assert one(fn.jdbc_scheme, "jdbc:PostgreSQL://x", "${A:jdbc:mysql://x}", "${A:${B:jdbc:mysql://x}}", "${A}", "redis://x", None) == ["postgresql", "mysql", None, None, None, None]
    assert one(fn.image_engine, "docker.io/library/postgres:14", "localhost:5000/mongo", "mcr.example/mssql/server:2022", "org/orders:1", None) == ["postgresql", "mongodb", "sqlserver", None, None]
    assert one(fn.env_service, "LEDGER_API_ADDR", "LEDGER_ADDR", "x_url", "_URL", "PLAIN") == ["LEDGER", "LEDGER", "x", None, None]
    assert one(fn.value_host, "ledger:80", "http://u:p@h.x:1/y", "plain", None) == ["ledger", "h.x", None, None]
    assert one(fn.route_key, "get /a/{id}/:x") == ["GET /A/{PARAM}/{PARAM}"] and one(fn.interface_key, "GET //a/<id>/") == ["GET /a/{id}"]
    assert one(fn.redact_assignment, "token: 'abc', x", "nothing") == ["token: '[REDACTED]', x", "nothing"]
    assert one(fn.import_target, "@a/b.c-d") == ["ref_a_b_c_d"] and one(fn.stem, "a/b.test.ts", "x") == ["b.test", "x"]
