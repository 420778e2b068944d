"""Flattened documents against plain recursion."""

import json

import duckdb

from gristmill.operators.flatten import flatten_architectures, level_tables
from tests.conftest import same_rows

S = "arch_id string, calm string, level string"


def as_list(x):
    return [] if x is None else x if isinstance(x, list) else [x]


def plain(docs):
    out = set()
    for arch, text in docs:
        try:
            doc = json.loads(text)
        except (TypeError, ValueError):
            continue
        for i, n in enumerate(as_list(doc.get("nodes"))):
            nid = n.get("unique-id") or f"#{i}"
            out.add((arch, arch, "node", nid))
            for j, f in enumerate(as_list(n.get("interfaces"))):
                out.add((arch, nid, "interface", f.get("unique-id") or f"#{j}"))
            for k, c in (n.get("controls") or {}).items():
                out.add((arch, nid, "control", k))
                for j, r in enumerate(as_list((c or {}).get("requirements"))):
                    out.add((arch, f"{nid}/{k}", "requirement", str(j)))
                    ev = ((r.get("config") or {}).get("evidence") or {}).get("evidence-paths")
                    for p in as_list(ev):
                        out.add((arch, f"{nid}/{k}/{j}", "evidence-path", p))
    return out


def flat(spark, docs):
    df = spark.createDataFrame([(a, t, "clash") for a, t in docs], S)
    return [tuple(r) for r in flatten_architectures(df).select("arch_id", "parent_path", "child_kind", "child_id").distinct().collect()]


def test_singles_nulls_absent_and_broken(spark):
    doc = {
        "nodes": [
            {"unique-id": "a", "interfaces": {"path": "/x"}, "controls": {"c.1": {"requirements": {"config": {"evidence": {"evidence-paths": "p:1"}}}}, "c2": {"requirements": []}, "c3": None}},
            {"interfaces": None, "controls": None}, {"unique-id": None, "interfaces": [{"unique-id": "i"}, {}], "controls": {"k": {"requirements": [{}, {"config": None}, {"config": {"evidence": {"evidence-paths": ["q", "r"]}}}]}}},
        ]
    }
    docs = [("A", json.dumps(doc)), ("A", json.dumps(doc, indent=2)), ("B", json.dumps(doc)[:-9]), ("C", None), ("D", ""), ("E", json.dumps({"nodes": doc["nodes"][0]})), ("F", "{}"), ("G", json.dumps({"nodes": None}))]
    same_rows(flat(spark, docs), plain(docs))


def test_small_tables_whole(spark, sf):
    docs = duckdb.sql(f"select distinct arch_id, calm from '{sf}/calm_documents.parquet'").fetchall()
    same_rows(flat(spark, docs), plain(docs))


def test_empty_and_levels(spark):
    empty = flatten_architectures(spark.createDataFrame([], S))
    assert {k: v.count() for k, v in level_tables(empty).items()} == dict.fromkeys(("node", "interface", "control", "requirement", "evidence-path"), 0)
