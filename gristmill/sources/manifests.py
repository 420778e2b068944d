"""Manifests as tables: one step turns YAML and JSON into JSON rows, DataFrames do the rest."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import value_host

try:
    import yaml
except ImportError:  # the reader of YAML is optional; without it each such file comes out with an error
    yaml = None

# File names of interface documents, and the verbs of their operations.
OPENAPI_FILES = ["openapi.yaml", "openapi.yml", "openapi.json", "swagger.yaml", "swagger.yml", "swagger.json"]
VERBS = ["get", "post", "put", "patch", "delete", "head", "options", "trace"]
PATH_DEPTH = 10


def _loader():
    """YAML 1.2 as far as manifests need it: only true and false are booleans, unknown tags give their bare value, dates stay text."""

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers = {}  # noqa: RUF012

    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", __import__("re").compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    Loader.add_implicit_resolver("tag:yaml.org,2002:null", __import__("re").compile(r"^(?:~|null|Null|NULL|)$"), ["~", "n", "N", ""])
    Loader.add_implicit_resolver("tag:yaml.org,2002:int", __import__("re").compile(r"^[-+]?\d+$"), list("-+0123456789"))
    Loader.add_implicit_resolver("tag:yaml.org,2002:float", __import__("re").compile(r"^[-+]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?$"), list("-+.0123456789"))

    def bare(loader: Loader, _: str, node: yaml.Node):
        if isinstance(node, yaml.ScalarNode):
            return loader.construct_scalar(node)
        return loader.construct_sequence(node, deep=True) if isinstance(node, yaml.SequenceNode) else loader.construct_mapping(node, deep=True)

    Loader.add_multi_constructor("!", bare)
    Loader.add_constructor("tag:yaml.org,2002:int", lambda ld, n: int(ld.construct_scalar(n)))
    return Loader


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    loader = _loader() if yaml else None
    for b in batches:
        out = []
        for root, file, text in zip(*(b.column(c).to_pylist() for c in ("root", "file", "text")), strict=True):
            try:
                if yaml is None and not (file or "").endswith(".json"):
                    raise RuntimeError("PyYAML is not installed, so this file was not read")
                docs = [json.loads(text)] if (file or "").endswith(".json") else list(yaml.load_all(text, Loader=loader))
                out += [(root, file, i, json.dumps(d, ensure_ascii=False), None) for i, d in enumerate(docs) if d is not None]
            except Exception as e:  # one bad file must not end the run; it comes out with its error
                out.append((root, file, 0, None, str(e)[:300]))
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=t) for i, t in enumerate(kinds)], names=["root", "file", "doc_ord", "doc", "error"])


def documents(files: DataFrame) -> DataFrame:
    """(root, file, doc_ord, doc, error): every document of YAML and JSON ``files`` (root, file, text) as JSON text; a file that does not parse gives one row with its error."""
    some = files.where(F.col("text").isNotNull() & F.col("file").rlike(r"\.(?:ya?ml|json)$")).select("root", "file", "text")
    return some.mapInArrow(_parse, "root string, file string, doc_ord int, doc string, error string")


def openapi_operations(files: DataFrame) -> DataFrame:
    """S-13: (root, file, title, path, method)."""
    d = documents(files.where(F.regexp_extract("file", r"([^/]*)$", 1).isin(*OPENAPI_FILES))).where("doc is not null")
    p = d.select("root", "file", F.get_json_object("doc", "$.info.title").alias("title"), F.explode(F.from_json(F.get_json_object("doc", "$.paths"), "map<string,string>")).alias("path", "verbs"))
    v = p.select("root", "file", "title", "path", F.explode(F.map_keys(F.from_json("verbs", "map<string,string>"))).alias("verb"))
    return v.where(F.lower("verb").isin(*VERBS)).select("root", "file", "title", "path", F.upper("verb").alias("method"))


def openapi_schemes(files: DataFrame) -> DataFrame:
    """S-13: (root, file, name, type, scheme) of security schemes, of the third version or the second."""
    d = documents(files.where(F.regexp_extract("file", r"([^/]*)$", 1).isin(*OPENAPI_FILES))).where("doc is not null")
    raw = F.coalesce(F.get_json_object("doc", "$.components.securitySchemes"), F.get_json_object("doc", "$.securityDefinitions"))
    return d.select("root", "file", F.explode(F.from_json(raw, "map<string,struct<type:string,scheme:string>>")).alias("name", "s")).select("root", "file", "name", "s.type", "s.scheme")


_CONTAINER = "struct<image:string,name:string,envFrom:array<struct<configMapRef:struct<name:string>>>,env:array<struct<valueFrom:struct<configMapKeyRef:struct<name:string>>>>>"
_WORKLOAD = f"struct<kind:string,metadata:struct<name:string,namespace:string>,spec:struct<template:struct<spec:struct<containers:array<{_CONTAINER}>,volumes:array<struct<secret:struct<secretName:string,items:array<struct<key:string>>>>>>>>>"


def k8s_deployments(files: DataFrame) -> DataFrame:
    """S-14: (name, namespace, image, container_name, config_map_names, secret_mounts, source_file) of deployments and stateful sets."""
    d = documents(files).where("doc is not null").select("file", F.from_json("doc", _WORKLOAD).alias("d")).where("d.kind in ('Deployment', 'StatefulSet') and d.metadata.name is not null")
    pod = F.col("d.spec.template.spec")
    some = lambda a, t: F.coalesce(a, F.from_json(F.lit("[]"), f"array<{t}>"))
    containers = some(pod["containers"], _CONTAINER)
    refs = F.flatten(F.transform(containers, lambda c: F.concat(F.transform(some(c["envFrom"], "struct<configMapRef:struct<name:string>>"), lambda e: e["configMapRef"]["name"]), F.transform(some(c["env"], "struct<valueFrom:struct<configMapKeyRef:struct<name:string>>>"), lambda e: e["valueFrom"]["configMapKeyRef"]["name"]))))
    volumes = F.filter(some(pod["volumes"], "struct<secret:struct<secretName:string,items:array<struct<key:string>>>>"), lambda v: v["secret"]["secretName"].isNotNull())
    mounts = F.transform(volumes, lambda v: F.struct(v["secret"]["secretName"].alias("secret_name"), F.filter(F.transform(some(v["secret"]["items"], "struct<key:string>"), lambda i: i["key"]), lambda k: k.isNotNull()).alias("item_keys")))
    return d.select(F.col("d.metadata.name").alias("name"), F.coalesce("d.metadata.namespace", F.lit("default")).alias("namespace"), F.get(containers, F.lit(0))["image"].alias("image"), F.get(containers, F.lit(0))["name"].alias("container_name"), F.array_distinct(F.filter(refs, lambda x: x.isNotNull())).alias("config_map_names"), mounts.alias("secret_mounts"), F.col("file").alias("source_file"))


def k8s_config_keys(files: DataFrame) -> DataFrame:
    """S-15: (config_map, key, host, source_file); the host in a value, never the value."""
    d = documents(files).where("doc is not null").select("file", F.from_json("doc", "struct<kind:string,metadata:struct<name:string>,data:map<string,string>>").alias("d")).where("d.kind = 'ConfigMap' and d.metadata.name is not null")
    return d.select(F.col("d.metadata.name").alias("config_map"), F.explode("d.data").alias("key", "value"), "file").select("config_map", "key", value_host(F.col("value")).alias("host"), F.col("file").alias("source_file"))


def cfn_routes(files: DataFrame) -> DataFrame:
    """S-16: (path, method, handler): methods bound to functions over all templates; paths from at most ten parents, preflights left out."""
    d = documents(files).where("doc is not null")
    r = d.select("file", "doc_ord", F.explode(F.from_json(F.get_json_object("doc", "$.Resources"), "map<string,string>")).alias("id", "body"))
    g = lambda p: F.get_json_object("body", f"$.Properties.{p}")
    r = r.select("id", "file", "doc_ord", F.get_json_object("body", "$.Type").alias("type"), g("HttpMethod").alias("method"), g("ResourceId").alias("resource"), g("Integration.Uri").alias("uri"), g("Handler").alias("handler"), g("PathPart").alias("part"), g("ParentId").alias("parent")).where("type is not null")
    pool = r.groupBy("id").agg(F.max_by(F.struct("type", "method", "resource", "uri", "handler", "part", "parent"), F.struct("file", "doc_ord")).alias("x")).select("id", "x.*")
    local = lambda c: F.substring_index(F.col(c), ".", 1)
    tree = pool.where("type = 'AWS::ApiGateway::Resource'").select("id", "part", local("parent").alias("up"))
    m = pool.where("type = 'AWS::ApiGateway::Method' and method is not null and method <> 'OPTIONS'").select("id", "method", F.regexp_extract("uri", r"\$\{([A-Za-z0-9_]+)(?:\.[A-Za-z0-9_]+)?\}", 1).alias("fn"), local("resource").alias("at"), F.lit("").alias("path"))
    for _ in range(PATH_DEPTH):
        m = m.join(tree.select(F.col("id").alias("at"), "part", "up"), "at", "left").select("id", "method", "fn", F.col("up").alias("at"), F.when(F.col("part").isNotNull() & (F.col("part") != ""), F.concat(F.lit("/"), "part", "path")).otherwise(F.col("path")).alias("path"))
    lambdas = pool.where("type = 'AWS::Lambda::Function' and handler is not null").select(F.col("id").alias("fn"), "handler")
    return m.where("path <> ''").join(lambdas, "fn").select("path", "method", "handler")


def _flat_yaml(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def walk(o, prefix, out):
        if isinstance(o, dict):
            for k, v in o.items():
                walk(v, f"{prefix}.{k}" if prefix else str(k), out)
        elif o is not None and prefix:
            out[prefix] = ",".join(map(str, o)) if isinstance(o, list) else str(o).lower() if isinstance(o, bool) else str(o)

    for b in batches:
        rows = []
        for root, file, n, doc in zip(*(b.column(c).to_pylist() for c in ("root", "file", "doc_ord", "doc")), strict=True):
            flat: dict[str, str] = {}
            walk(json.loads(doc), "", flat)
            rows += [(root, file, n, flat.get("spring.config.activate.on-profile"), k, v) for k, v in flat.items()]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], names=["root", "file", "doc_ord", "doc_profile", "key", "value"])


def spring_properties(files: DataFrame) -> DataFrame:
    """S-17: (root, file, profile, doc_profile, key, value). Documents of a file without a profile of their own merge, the last wins; those with one stay apart."""
    name = F.regexp_extract("file", r"([^/]*)$", 1)
    some = files.where(name.rlike(r"^application(?:-[^.]+)?\.(?:ya?ml|properties)$"))
    long = documents(some.where(~F.col("file").endswith(".properties"))).where("doc is not null").select("root", "file", "doc_ord", "doc").mapInArrow(_flat_yaml, "root string, file string, doc_ord int, doc_profile string, key string, value string")
    lines = some.where(F.col("file").endswith(".properties")).select("root", "file", F.posexplode(F.split("text", r"\r?\n")).alias("doc_ord", "l")).where(~F.trim("l").rlike("^[#!]") & F.col("l").rlike("[:=]"))
    props = lines.select("root", "file", "doc_ord", F.lit(None).cast("string").alias("doc_profile"), F.trim(F.regexp_extract("l", r"^\s*([^:=]*)[:=]", 1)).alias("key"), F.trim(F.regexp_extract("l", r"^[^:=]*[:=](.*)$", 1)).alias("value")).where("key <> ''")
    last = long.unionByName(props).groupBy("root", "file", "doc_profile", "key").agg(F.max_by("value", "doc_ord").alias("value"))
    profile = F.regexp_extract("file", r"application-([^./]+)\.[^/]*$", 1)
    return last.select("root", "file", F.when(profile != "", profile).alias("profile"), "doc_profile", "key", "value")


def sbom_components(files: DataFrame) -> DataFrame:
    """S-18: (root, name, version, purl) of CycloneDX documents; whatever is none gives nothing."""
    d = documents(files.where(F.col("file").endswith(".json"))).where(F.get_json_object("doc", "$.bomFormat") == "CycloneDX")
    return d.select("root", F.explode(F.from_json(F.get_json_object("doc", "$.components"), "array<struct<name:string,version:string,purl:string>>")).alias("c")).select("root", "c.*").where("name is not null").distinct()


def repo_contracts(files: DataFrame) -> DataFrame:
    """S-19: (repo, ord, node_id, name, api_title, artifact, svc_name, svc_dns). An entry without repo, id, name or any identity is an error: people wrote it, and a silent loss would mislead them."""
    d = documents(files)
    e = d.select("file", F.coalesce(F.get_json_object("doc", "$.repo"), F.raise_error(F.concat(F.lit("malformed repo manifest "), "file")).cast("string")).alias("repo"), F.posexplode(F.from_json(F.get_json_object("doc", "$.publishes"), "array<struct<nodeId:string,name:string,apiSpec:struct<title:string>,artifact:struct<coordinates:string>,serviceCatalogue:struct<name:string,dns:string>>>")).alias("ord", "p"))
    flat = e.select("repo", "ord", F.col("p.nodeId").alias("node_id"), F.col("p.name").alias("name"), F.col("p.apiSpec.title").alias("api_title"), F.col("p.artifact.coordinates").alias("artifact"), F.col("p.serviceCatalogue.name").alias("svc_name"), F.col("p.serviceCatalogue.dns").alias("svc_dns"))
    bad = F.col("node_id").isNull() | F.col("name").isNull() | F.coalesce("api_title", "artifact", "svc_name", "svc_dns").isNull()
    return flat.withColumn("node_id", F.when(bad, F.raise_error(F.concat(F.lit("repo manifest entry without identity in "), "repo")).cast("string")).otherwise(F.col("node_id")))
