"""Source trees as tables: files, lines, and facts read from lines."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import import_target

# Languages by ending, folders that are never read, files that say that a root can be deployed.
LANGUAGES = {"py": "python", "ts": "typescript", "java": "java", "yaml": "yaml", "yml": "yaml", "json": "json", "properties": "properties", "sh": "shell", "env": "dotenv", "xml": "xml"}
SKIPPED = ["node_modules", "dist", "build", "target"]
DEPLOYABLE = ["Dockerfile", "docker-compose.yml", "docker-compose.yaml", "serverless.yml", "template.yaml"]


def common_ancestor(paths: list[str]) -> str:
    """S-09: the longest path whose segments all ``paths`` share."""
    return os.path.commonpath(paths) if paths else ""


def excluded(root_paths: list[str], siblings: list[str]) -> list[str]:
    """S-10: the ``siblings`` that are neither above nor below any root."""
    inside = lambda a, b: (a.rstrip("/") + "/").startswith(b.rstrip("/") + "/")
    return [s for s in siblings if not any(inside(s, r) or inside(r, s) for r in root_paths)]


def read_files(spark: SparkSession, path: str, endings: list[str] | None = None) -> DataFrame:
    """S-01: (path, text) of all files under ``path``, whole, read by the executors."""
    glob = "*.{" + ",".join(endings) + "}" if endings else None
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("path"), F.col("value").alias("text"))
    return files.where(~F.col("path").rlike("/(?:" + "|".join(SKIPPED) + r"|\.[^/]+)/"))


def resolve_roots(files: DataFrame, roots: list[str]) -> DataFrame:
    """S-11: (root, file, text): each file under the first root that holds it; a file in none is left out. ``roots`` are the settings of a run."""
    first = F.lit(None).cast("string")
    for r in reversed(roots):
        first = F.when(F.startswith(F.col("path"), F.lit(r.rstrip("/") + "/")), F.lit(r.rstrip("/"))).otherwise(first)
    placed = files.withColumn("_r", first).where("_r is not null")
    return placed.select(F.regexp_extract("_r", r"([^/]*)$", 1).alias("root"), F.expr("substring(path, length(_r) + 2)").alias("file"), "text")


def source_files(files: DataFrame) -> DataFrame:
    """(root, file, ext, language) of files."""
    ext = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1))
    return files.select("root", "file", ext.alias("ext"), F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext].alias("language"))


def source_lines(files: DataFrame) -> DataFrame:
    """(root, file, line, text): lines from 1 on, without line ends and byte-order mark."""
    clean = F.regexp_replace("text", "^﻿", "")
    return files.select("root", "file", F.posexplode(F.split(clean, r"\r\n|\r|\n", -1)).alias("p", "text")).select("root", "file", (F.col("p") + 1).alias("line"), "text")


def deployable_roots(files: DataFrame) -> DataFrame:
    """S-12: (root, file) of the manifests at the top of a root that say it can be deployed."""
    return files.where(F.col("file").isin(*DEPLOYABLE)).select("root", "file").distinct()


def decorator_facts(lines: DataFrame) -> DataFrame:
    """S-03: (root, file, line, match_source, reference_name, argument): decorators with the literal on their line."""
    name = F.regexp_extract("text", r"^\s*@([A-Za-z_][\w.]*)", 1)
    arg = F.regexp_extract("text", r"""@[\w.]+\s*\([^"'`]*["'`]([^"'`]*)["'`]""", 1)
    return lines.select("root", "file", "line", F.lit("decorator").alias("match_source"), name.alias("reference_name"), F.when(arg != "", arg).alias("argument")).where("reference_name <> ''")


def call_facts(lines: DataFrame) -> DataFrame:
    """S-04: calls, less those that are decorators of the same name on the line; the argument reaches to the last closing bracket."""
    hits = F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)\s*\("), F.lit(1))
    calls = lines.where(~F.col("text").rlike(r"^\s*(?:def|async|public|private|protected|function|class|if|for|while|switch|catch)\b")).select("root", "file", "line", "text", F.explode(F.array_distinct(hits)).alias("full"))
    name = F.regexp_extract("full", r"([^.]+)$", 1)
    arg = F.regexp_extract(F.expr("substring(text, locate(full, text) + length(full))"), r"^\s*\((.*)\)", 1)
    facts = calls.select("root", "file", "line", F.lit("call").alias("match_source"), name.alias("reference_name"), F.when(arg != "", arg).alias("argument"))
    deco = decorator_facts(lines).select("root", "file", "line", F.regexp_extract("reference_name", r"([^.]+)$", 1).alias("reference_name"))
    return facts.join(deco, ["root", "file", "line", "reference_name"], "left_anti")


def extends_facts(lines: DataFrame) -> DataFrame:
    """S-06: what classes extend and implement, generic arguments apart."""
    head = F.regexp_replace(F.regexp_extract("text", r"\b(?:class|interface)\s+\w+(?:<[^{]*?>)?\s+((?:extends|implements)\b[^{]*)", 1), r"<[^{]*>", "")
    names = F.filter(F.split(head, r"\s*,\s*|\s+"), lambda x: x.rlike("^[A-Z]") & ~x.isin("extends", "implements"))
    return lines.select("root", "file", "line", F.lit("extends").alias("match_source"), F.explode(names).alias("reference_name"))


def generic_argument_edges(lines: DataFrame, types: DataFrame) -> DataFrame:
    """S-24: (root, file, source, target, relation): references from a class to every known type named in the generic arguments of its header, never to itself. ``types`` (label)."""
    owner = F.regexp_extract("text", r"\b(?:class|interface)\s+(\w+)", 1)
    inside = F.regexp_extract("text", r"\b(?:extends|implements)\b[^<{]*<([^{]*)>", 1)
    refs = lines.select("root", "file", owner.alias("source"), F.explode(F.split(inside, r"[<>,\s]+")).alias("target")).where("source <> '' and target <> '' and source <> target")
    known = types.select(F.col("label").alias("target")).distinct().hint("merge")  # as many as there are classes, whatever the planner takes them for
    return refs.join(known, "target", "left_semi").withColumn("relation", F.lit("references")).select("root", "file", "source", "target", "relation").distinct()


#: Lines of a block; what a class needs beyond its block's last line is in the block twice.
BLOCK = 128


def _blocks(lines: DataFrame, seen: Column, up: int = 0, down: int = 0) -> DataFrame:
    """(root, file, block, rows): the distinct ``seen`` (structs with ``line``) of each block of ``BLOCK`` lines in order, with those of ``up`` lines before it and ``down`` lines behind it.

    Lines meet those around them in one exchange, without a join: the size of exploded lines is not known to the planner, which takes them for small and broadcasts them. A long file is many blocks. Rows without root, file or line are left out.
    """
    n = F.col("line").cast("bigint")
    whole = lines.where(F.col("root").isNotNull() & F.col("file").isNotNull() & F.col("line").isNotNull())
    near = whole.select("root", "file", seen.alias("_s"), F.explode(F.sequence(F.floor((n - down) / BLOCK), F.floor((n + up) / BLOCK))).alias("block"))
    return near.groupBy("root", "file", "block").agg(F.array_sort(F.collect_set("_s")).alias("rows"))


def _own(r: Column) -> Column:
    """Whether a row of a block is in the block itself, not before or behind it."""
    return F.floor(r["line"].cast("bigint") / BLOCK) == F.col("block")


def class_headers(lines: DataFrame, reach: int = 10) -> DataFrame:
    """S-23: (root, file, line, name, header): each class with its header, up to the opening brace and ten lines at most."""
    blocks = _blocks(lines, F.struct("line", "text"), down=reach - 1)
    at = lambda r: r["line"].cast("bigint")
    starts = F.array_distinct(F.transform(F.filter("rows", lambda r: _own(r) & r["text"].rlike(r"\b(?:class|interface)\s+\w+")), lambda r: F.struct(r["line"].alias("line"), F.regexp_extract(r["text"], r"\b(?:class|interface)\s+(\w+)", 1).alias("name"))))
    text = lambda c: F.array_join(F.transform(F.filter("rows", lambda r: (at(r) >= at(c)) & (at(r) < at(c) + reach)), lambda r: r["text"]), " ")
    found = F.transform(starts, lambda c: F.struct(c["line"].alias("line"), c["name"].alias("name"), F.substring_index(text(c), "{", 1).alias("header")))
    return blocks.select("root", "file", F.explode(found).alias("c")).select("root", "file", "c.line", "c.name", "c.header")


def has_field_of(lines: DataFrame, type_name: str) -> DataFrame:
    """S-23: (root, file) of files with a field of a type."""
    return lines.where(F.col("text").rlike(rf"(?:private|protected|readonly|final|this\.\w+\s*=\s*new)\b[^;(]*\b{type_name}\b")).select("root", "file").distinct()


def package_of(lines: DataFrame) -> DataFrame:
    """S-22: (root, file, package): the first package line of each file."""
    p = F.regexp_extract("text", r"^\s*package\s+([\w.]+)\s*;", 1)
    return lines.select("root", "file", "line", p.alias("p")).where("p <> ''").groupBy("root", "file").agg(F.min_by("p", "line").alias("package"))


def bare_name_collisions(edges: DataFrame, imports: DataFrame, packages: DataFrame, mentions: DataFrame) -> DataFrame:
    """J-09: ``edges`` (root, file, bare, target_file) of Java files that are no relationship, as they only share a bare name.

    Either the file imports the name from another package than that of the target, or it imports it from nowhere, says the name literally (``mentions``: root, file, bare) and its own package is another. What is not known rejects nothing.
    """
    imp = imports.groupBy("root", "file", "bare").agg(F.min("qualified").alias("_q"))
    own = packages.select("root", "file", F.col("package").alias("_own"))
    there = packages.select("root", F.col("file").alias("target_file"), F.col("package").alias("_p"))
    said = mentions.select("root", "file", "bare", F.lit(True).alias("_said")).distinct()
    j = edges.join(imp, ["root", "file", "bare"], "left").join(own, ["root", "file"], "left").join(there, ["root", "target_file"], "left").join(said, ["root", "file", "bare"], "left")
    q, p = F.col("_q"), F.col("_p")
    clash = F.when(q.isNotNull(), q != F.concat_ws(".", "_p", "bare")).otherwise(F.col("_said") & (F.col("_own") != p))
    return j.where(F.col("file").endswith(".java") & p.isNotNull() & F.coalesce(clash, F.lit(False))).select(edges.columns)


def annotated_classes(lines: DataFrame, annotation: str, reach: int = 10) -> DataFrame:
    """S-23: (root, file, line, name) of the classes above which an annotation stands, over blank lines, comments and other annotations and at most ``reach`` lines away."""
    text = F.trim(F.coalesce("text", F.lit("")))
    name = F.when(text.rlike(r"\b(?:class|interface)\s+\w+"), F.regexp_extract(text, r"\b(?:class|interface)\s+(\w+)", 1))
    skip = (text == "") | text.rlike(r"^(?:@|//|\*|/\*|\#)")
    told = lines.select("root", "file", "line", F.struct("line", name.alias("name"), text.rlike(rf"^@{annotation}\b").alias("hit"), (~skip).alias("stop")).alias("s")).where("s.hit or s.stop or s.name is not null")
    blocks = _blocks(told, F.col("s"), up=reach)
    at = lambda r: r["line"].cast("bigint")
    starts = F.array_distinct(F.transform(F.filter("rows", lambda r: _own(r) & r["name"].isNotNull()), lambda r: F.struct(r["line"].alias("line"), r["name"].alias("name"))))
    last = lambda c, what: F.array_max(F.transform(F.filter("rows", lambda r: r[what] & (at(r) < at(c)) & (at(r) >= at(c) - reach)), lambda r: r["line"]))
    found = F.filter(starts, lambda c: last(c, "hit") > F.coalesce(last(c, "stop"), F.lit(-1)))
    return blocks.select("root", "file", F.explode(found).alias("c")).select("root", "file", "c.line", "c.name")


def indexed_files(files: DataFrame, endings: list[str] | None = None) -> DataFrame:
    """S-01: (root, file, ext) of the files whose ending is one of source code."""
    return files.where(F.col("ext").isin(*(endings or ["py", "ts", "java"]))).select("root", "file", "ext").distinct()


def common_folders(files: DataFrame) -> DataFrame:
    """S-09: (root, folder): the longest folder that all files of a root share. It is what the first and the last path have in common, so two paths of a root are all that is looked at."""
    steps = lambda c: F.slice(F.split(c, "/"), F.lit(1), F.size(F.split(c, "/")) - 1)
    ends = files.groupBy("root").agg(F.min(steps(F.col("file"))).alias("a"), F.max(steps(F.col("file"))).alias("b"))
    least = F.least(F.size("a"), F.size("b"))
    same = F.filter(F.sequence(F.lit(0), least), lambda n: F.slice("a", F.lit(1), n) == F.slice("b", F.lit(1), n))
    return ends.select("root", F.array_join(F.slice("a", F.lit(1), F.array_max(same)), "/").alias("folder"))


def _above(path: str) -> Column:
    """A path and all folders above it."""
    steps = F.split(F.col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))


def excluded_folders(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """S-10: ``folders`` (folder) that are neither above nor below any of ``roots`` (path), and so need not be read; by equi-joins on the folders above each."""
    above = roots.select(F.explode(_above("path")).alias("folder")).distinct()
    below = folders.select("folder", F.explode(_above("folder")).alias("path")).join(roots.select("path").distinct(), "path", "left_semi").select("folder").distinct()
    return folders.select("folder").distinct().join(above, "folder", "left_anti").join(below, "folder", "left_anti")


def place_files(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """S-11: (path, root, file): each path under the first root, by ``root_ord``, that holds it; a path in none is left out. ``roots`` (path, root_ord) may be any number."""
    up = paths.select("path", F.explode(_above("path")).alias("folder")).where("folder <> path")
    hit = up.join(roots.select(F.col("path").alias("folder"), "root_ord"), "folder").groupBy("path").agg(F.min_by("folder", "root_ord").alias("root"))
    return hit.select("path", "root", F.expr("substring(path, length(root) + 2)").alias("file"))


def library_imports(imports: DataFrame, libraries: dict[str, list[str]], language: Column) -> DataFrame:
    """F-19: ``imports`` (file, target) of a known library of their language, or of a package under it, with ``library``; in its plain or its ref_ form. package.json is no source of imports. The catalogue is fixed."""
    target = F.col("target")
    under = lambda lang, n: (language == lang) & ((target == n) | F.startswith(target, F.lit(n + ("." if lang == "java" else "/"))) | (target == import_target(F.lit(n))))
    library = F.coalesce(*(F.when(under(lang, n), n) for lang, names in libraries.items() for n in names))
    return imports.withColumn("library", library).where(F.col("library").isNotNull() & ~F.col("file").rlike(r"(?:^|/)package\.json$"))


def bindings_of(lines: DataFrame, columns: list[str], text: str = "value") -> tuple[DataFrame, DataFrame]:
    """S-20: (rows, rejected lines) of lines of CSV without header: a line with another number of cells, or whose first cell is empty, is rejected and comes out as it is."""
    schema = ", ".join(f"`{c}` string" for c in columns) + ", _bad string"
    parsed = lines.where(F.trim(F.col(text)) != "").withColumn("_c", F.from_csv(F.col(text), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "escape": '"'}))
    bad = F.col("_c._bad").isNotNull() | F.col(f"_c.`{columns[0]}`").isNull()
    return parsed.where(~bad).select("_c.*").drop("_bad"), parsed.where(bad).select(F.col(text).alias("line"))


def read_bindings(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """S-20: (rows, rejected lines) of CSV files with a header, which is known by its first cell."""
    lines = spark.read.text(path)
    return bindings_of(lines.where(~F.col("value").rlike(rf'^"?{columns[0]}"?(?:,|$)')), columns)


def native_routes(lines: DataFrame) -> DataFrame:
    """S-02: (root, file, start_line, name) of routes as their frameworks write them, name as "GET /x"."""
    # How Flask and FastAPI, and annotated Java and TypeScript methods write a route.
    py = r"""^\s*@(?:app|router|\w+)\.(get|post|put|patch|delete|route)\(\s*["']([^"']*)["']"""
    java = r"""^\s*@(Get|Post|Put|Patch|Delete)(?:Mapping)?\(\s*["']([^"']*)["']"""
    pattern = F.when(F.col("file").endswith(".py"), F.lit(py)).otherwise(F.lit(java))
    verb = F.when(F.col("file").endswith(".py"), F.regexp_extract("text", py, 1)).otherwise(F.regexp_extract("text", java, 1))
    path = F.when(F.col("file").endswith(".py"), F.regexp_extract("text", py, 2)).otherwise(F.regexp_extract("text", java, 2))
    method = F.when(F.lower(verb) == "route", "GET").otherwise(F.upper(verb))
    return lines.where(F.col("file").rlike(r"\.(?:py|ts|java)$") & F.col("text").rlike("@") & F.regexp_like(F.col("text"), pattern)).select("root", "file", F.col("line").alias("start_line"), F.concat(method, F.lit(" /"), F.regexp_replace(path, "^/", "")).alias("name")).distinct()


def route_summary(routes: DataFrame) -> DataFrame:
    """A-19: routes by file."""
    return routes.groupBy("root", "file").agg(F.count("*").alias("n_routes"))


def type_references(lines: DataFrame) -> DataFrame:
    """S-05: (root, file, line, match_source, reference_name): types of fields."""
    t = F.regexp_extract("text", r"\b(?:private|protected|public|readonly)\b(?:\s+(?:static|final|readonly))*\s+([A-Z]\w*)\b(?:<[^>]*>)?\s+\w+\s*[;=]", 1)
    u = F.regexp_extract("text", r"\b(?:private|protected|public|readonly)\b[^:({]*:\s*([A-Z]\w*)", 1)
    return lines.select("root", "file", "line", F.lit("field-type").alias("match_source"), F.when(t != "", t).otherwise(u).alias("reference_name")).where("reference_name <> ''")
