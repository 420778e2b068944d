"""Queries of the general data problems, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import drift, flatten, orphans, patches, snapdiff
from gristmill.session import table


def _orphans(spark: SparkSession, d: str) -> tuple[list[orphans.Reference], DataFrame]:
    t = lambda n: table(spark, d, n)
    overrides = t("overrides").select("override_id", "override_type", "decision_record_ref", "target_ref", "loaded_at")
    decisions = t("decisions").select("decision_id", "supersedes", "loaded_at", "deleted_at")
    return orphans.review_references(overrides, decisions), orphans.review_lifetimes(decisions, t("calm_elements"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Direct orphans, told from the inherited ones by the whole cascade: those that it leaves at depth 0."""
    return orphans.orphan_cascade(*_orphans(spark, d)).where("orphan_kind = 'direct'").select("ref_table", "ref_field", "period", "ref_key")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans by table, field, period and whether direct or inherited."""
    return orphans.orphan_cascade(*_orphans(spark, d)).groupBy("ref_table", "ref_field", "period", "orphan_kind").agg(F.count("*").alias("n_rows"), F.max("depth").cast("bigint").alias("max_depth"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Nodes alive after the feed."""
    return patches.rebuild_nodes(table(spark, d, "overrides"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Nodes added, removed or changed between runs."""
    return snapdiff.snapshot_changes(table(spark, d, "calm_snapshots"), table(spark, d, "review_runs"), snapdiff.node_digest())


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Field changes between files."""
    return drift.field_changes(drift.schema_scripts(table(spark, d, "evidence_files")))


def p4_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Full edit scripts, nested fields included."""
    return drift.schema_scripts(table(spark, d, "evidence_files"))


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    """All records in one table under canonical names."""
    return drift.unified_table(table(spark, d, "evidence_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Parent-child links of all levels."""
    return flatten.flatten_rows(table(spark, d, "calm_documents")).select("arch_id", "parent_path", "child_kind", "child_id").distinct()


def p5_levels(spark: SparkSession, d: str) -> DataFrame:
    """The flat rows of all levels with their attributes."""
    return flatten.flatten_architectures(table(spark, d, "calm_documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p3_found, p4_found, p4_scripts, p4_unified, p5_found, p5_levels)}

_TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160)"


def _norm(c: str) -> str:
    return f"nullif(lower(trim({c}, {_TRIM})), '')"


_P1_REFS = f"""
WITH RECURSIVE target AS (
  SELECT DISTINCT 'decision' AS space, {_norm('decision_id')} AS id, loaded_at AS born, deleted_at AS died FROM decisions
  UNION ALL SELECT DISTINCT 'element', {_norm('element_id')}, loaded_at, deleted_at FROM calm_elements
), refs AS (
  SELECT DISTINCT 'overrides' AS ref_table, 'decision_record_ref' AS ref_field, override_id AS ref_key, 'decision' AS space, {_norm('decision_record_ref')} AS id, loaded_at AS t, CAST(NULL AS VARCHAR) AS own FROM overrides
  UNION ALL SELECT DISTINCT 'decisions', 'supersedes', decision_id, 'decision', {_norm('supersedes')}, loaded_at, {_norm('decision_id')} FROM decisions
  UNION ALL SELECT DISTINCT 'overrides', 'target_ref', override_id, 'element', {_norm('target_ref')}, loaded_at, NULL FROM overrides
    WHERE coalesce(lower(trim(override_type)), '') NOT IN ('node_add', 'relationship_add')
), judged AS (
  SELECT *, EXISTS (SELECT 1 FROM target x WHERE x.space = r.space AND x.id = r.id AND x.born <= r.t AND (x.died IS NULL OR x.died > r.t)) AS live
  FROM refs r WHERE id IS NOT NULL
)"""

_P3 = f"""
WITH runs AS (SELECT run_id, min(root) AS root, min(generated_at) AS g FROM review_runs GROUP BY run_id),
pairs AS (SELECT run_id, prev FROM (SELECT run_id, lag(run_id) OVER (PARTITION BY root ORDER BY g, run_id) AS prev FROM runs) WHERE prev IS NOT NULL),
s AS (
  SELECT run_id, unique_id, max(sig) AS sig FROM (
    SELECT run_id, unique_id, concat_ws(chr(1), coalesce(trim(node_type, {_TRIM}), ''), coalesce(trim(node_name, {_TRIM}), ''), coalesce(trim(description, {_TRIM}), ''),
      coalesce((SELECT string_agg(DISTINCT i, chr(2) ORDER BY i) FROM unnest(interfaces) AS u(i) WHERE i <> ''), ''), coalesce(CAST(confidence AS VARCHAR), '')) AS sig
    FROM calm_snapshots WHERE run_id IS NOT NULL AND unique_id IS NOT NULL) GROUP BY run_id, unique_id),
a AS (SELECT p.run_id, s.unique_id, s.sig FROM pairs p JOIN s ON s.run_id = p.run_id),
b AS (SELECT p.run_id, s.unique_id, s.sig FROM pairs p JOIN s ON s.run_id = p.prev)
SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.unique_id, b.unique_id) AS unique_id,
  CASE WHEN b.run_id IS NULL THEN 'added' WHEN a.run_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.run_id = b.run_id AND a.unique_id = b.unique_id
WHERE a.run_id IS NULL OR b.run_id IS NULL OR a.sig <> b.sig"""

_P2 = f"""
WITH d AS (
  SELECT *, {_norm('override_id')} AS oid, {_norm('target_ref')} AS k FROM overrides
  QUALIFY row_number() OVER (PARTITION BY {_norm('override_id')} ORDER BY loaded_at DESC) = 1
), e AS (
  SELECT k, oid, override_type AS op, new_value AS j,
    row_number() OVER (PARTITION BY k ORDER BY CAST(created_at AS TIMESTAMPTZ), oid) AS n
  FROM d WHERE status = 'active' AND k IS NOT NULL AND oid IS NOT NULL
), gone AS (SELECT k, max(n) AS n FROM e WHERE op = 'node_remove' GROUP BY k
), born AS (SELECT e.k, min(e.n) AS n FROM e LEFT JOIN gone g ON g.k = e.k WHERE op = 'node_add' AND e.n > coalesce(g.n, 0) GROUP BY e.k)
SELECT b.k AS target_ref,
  coalesce(max_by(json_extract_string(e.j, '$'), e.n) FILTER (op = 'type_change' AND json_type(e.j) = 'VARCHAR'), max(json_extract_string(e.j, '$."node-type"')) FILTER (e.n = b.n), '') AS node_type,
  coalesce(max_by(json_extract_string(e.j, '$'), e.n) FILTER (op = 'node_rename' AND json_type(e.j) = 'VARCHAR'), max(json_extract_string(e.j, '$.name')) FILTER (e.n = b.n), '') AS node_name,
  coalesce(max_by(coalesce(json_extract_string(e.j, '$.container'), ''), e.n) FILTER (op = 'boundary_change'), '') AS container
FROM born b JOIN e ON e.k = b.k AND e.n >= b.n GROUP BY b.k"""

_P5 = """
WITH docs AS (SELECT DISTINCT arch_id, CAST(calm AS JSON) AS j FROM calm_documents WHERE json_valid(calm)),
lst AS (SELECT arch_id, CASE WHEN json_type(j, '$.nodes') = 'ARRAY' THEN CAST(json_extract(j, '$.nodes') AS JSON[]) WHEN json_type(j, '$.nodes') IS NULL OR json_type(j, '$.nodes') = 'NULL' THEN [] ELSE [json_extract(j, '$.nodes')] END AS l FROM docs),
node AS (SELECT arch_id, coalesce(json_extract_string(v, '$."unique-id"'), '#' || CAST(p - 1 AS VARCHAR)) AS id, v FROM (SELECT arch_id, unnest(l) AS v, generate_subscripts(l, 1) AS p FROM lst)),
ilst AS (SELECT arch_id, id, CASE json_type(v, '$.interfaces') WHEN 'ARRAY' THEN CAST(json_extract(v, '$.interfaces') AS JSON[]) WHEN 'OBJECT' THEN [json_extract(v, '$.interfaces')] ELSE [] END AS l FROM node),
iface AS (SELECT arch_id, id, coalesce(json_extract_string(v, '$."unique-id"'), '#' || CAST(p - 1 AS VARCHAR)) AS child FROM (SELECT arch_id, id, unnest(l) AS v, generate_subscripts(l, 1) AS p FROM ilst)),
ckey AS (SELECT arch_id, id, v, unnest(json_keys(v, '$.controls')) AS k FROM node WHERE json_type(v, '$.controls') = 'OBJECT'),
ctl AS (SELECT arch_id, id, k, json_extract(v, '$.controls."' || k || '"') AS c FROM ckey),
rlst AS (SELECT arch_id, id, k, CASE json_type(c, '$.requirements') WHEN 'ARRAY' THEN CAST(json_extract(c, '$.requirements') AS JSON[]) WHEN 'OBJECT' THEN [json_extract(c, '$.requirements')] ELSE [] END AS l FROM ctl),
req AS (SELECT arch_id, id || '/' || k AS parent, unnest(l) AS v, CAST(generate_subscripts(l, 1) - 1 AS VARCHAR) AS pos FROM rlst),
epath AS (SELECT arch_id, parent || '/' || pos AS parent, unnest(CASE json_type(v, '$.config.evidence."evidence-paths"') WHEN 'ARRAY' THEN CAST(json_extract(v, '$.config.evidence."evidence-paths"') AS VARCHAR[]) WHEN 'VARCHAR' THEN [json_extract_string(v, '$.config.evidence."evidence-paths"')] ELSE [] END) AS path FROM req)
SELECT DISTINCT * FROM (
  SELECT arch_id, arch_id AS parent_path, 'node' AS child_kind, id AS child_id FROM node
  UNION ALL SELECT arch_id, id, 'interface', child FROM iface
  UNION ALL SELECT arch_id, id, 'control', k FROM ctl
  UNION ALL SELECT arch_id, parent, 'requirement', pos FROM req
  UNION ALL SELECT arch_id, parent, 'evidence-path', path FROM epath)"""

_P4 = """
WITH f AS (SELECT root, file_name, min(generated_at) AS since FROM evidence_files GROUP BY ALL),
p AS (SELECT * FROM (SELECT root, file_name, lag(file_name) OVER (PARTITION BY root ORDER BY since, file_name) AS prev FROM f) WHERE prev IS NOT NULL),
r AS (SELECT DISTINCT root, file_name, CAST(payload AS JSON) AS j FROM evidence_files WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
ids AS (SELECT DISTINCT root, file_name, json_extract_string(j, '$.evidenceId') AS rid FROM r WHERE json_extract_string(j, '$.evidenceId') IS NOT NULL),
x AS (SELECT root, file_name, json_extract_string(j, '$.evidenceId') AS rid, k AS field, json_extract(j, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(j)) AS k FROM r) WHERE k <> 'evidenceId'),
t AS (SELECT *, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS ty,
  CASE WHEN json_type(v) = 'NULL' THEN NULL WHEN json_type(v) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'n' || CAST(CAST(v AS DOUBLE) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS cv FROM x),
s AS (SELECT root, file_name, field, string_agg(DISTINCT ty, '|' ORDER BY ty) AS tys FROM t GROUP BY ALL),
later AS (SELECT p.root, p.file_name, p.prev, s.field, s.tys FROM p JOIN s ON s.root = p.root AND s.file_name = p.file_name),
earlier AS (SELECT p.root, p.file_name, p.prev, s.field, s.tys FROM p JOIN s ON s.root = p.root AND s.file_name = p.prev),
come AS (SELECT * FROM later n WHERE NOT EXISTS (SELECT 1 FROM earlier b WHERE b.root = n.root AND b.file_name = n.file_name AND b.field = n.field)),
gone AS (SELECT * FROM earlier b WHERE NOT EXISTS (SELECT 1 FROM later n WHERE b.root = n.root AND b.file_name = n.file_name AND b.field = n.field)),
m AS (SELECT g.root, g.file_name, g.prev, g.field AS a, c.field AS b FROM gone g JOIN come c ON c.root = g.root AND c.file_name = g.file_name),
bad AS (SELECT DISTINCT m.* FROM m JOIN ids i ON i.root = m.root AND i.file_name = m.prev JOIN ids k ON k.root = m.root AND k.file_name = m.file_name AND k.rid = i.rid
  LEFT JOIN t va ON va.root = m.root AND va.file_name = m.prev AND va.rid = i.rid AND va.field = m.a LEFT JOIN t vb ON vb.root = m.root AND vb.file_name = m.file_name AND vb.rid = i.rid AND vb.field = m.b
  WHERE va.cv IS DISTINCT FROM vb.cv),
ren AS (SELECT * FROM m EXCEPT SELECT * FROM bad)
SELECT file_name, b AS field, 'renamed' AS change FROM ren
UNION SELECT file_name, field, 'removed' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.root = g.root AND ren.file_name = g.file_name AND ren.a = g.field)
UNION SELECT file_name, field, 'added' FROM come c WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.root = c.root AND ren.file_name = c.file_name AND ren.b = c.field)
UNION SELECT n.file_name, n.field, 'retyped' FROM later n JOIN earlier b ON b.root = n.root AND b.file_name = n.file_name AND b.field = n.field WHERE n.tys <> b.tys"""

ORACLE = {
    "p4_found": _P4,
    "p1_found": _P1_REFS + " SELECT DISTINCT ref_table, ref_field, strftime(t, '%Y-%m') AS period, ref_key FROM judged WHERE NOT live",
    "p1_report": _P1_REFS + """, tainted AS (
  SELECT own AS id, 0 AS depth FROM judged WHERE NOT live AND own IS NOT NULL
  UNION SELECT j.own, t.depth + 1 FROM judged j JOIN tainted t ON j.id = t.id WHERE j.live AND j.space = 'decision' AND j.own IS NOT NULL AND t.depth < 60
), least AS (SELECT id, min(depth) AS depth FROM tainted GROUP BY id
), found AS (
  SELECT ref_table, ref_field, t, ref_key, 0 AS depth FROM judged WHERE NOT live
  UNION ALL SELECT j.ref_table, j.ref_field, j.t, j.ref_key, l.depth + 1 FROM judged j JOIN least l ON l.id = j.id WHERE j.live AND j.space = 'decision'
), one AS (SELECT ref_table, ref_field, strftime(t, '%Y-%m') AS period, ref_key, min(depth) AS depth FROM found GROUP BY ALL)
SELECT ref_table, ref_field, period, CASE WHEN depth = 0 THEN 'direct' ELSE 'inherited' END AS orphan_kind, count(*) AS n_rows, CAST(max(depth) AS BIGINT) AS max_depth FROM one GROUP BY ALL""",
    "p2_found": _P2,
    "p3_found": _P3,
    "p5_found": _P5,
}
