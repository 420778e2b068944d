"""Command line: python -m gristmill run ROOT... --out DIR, or query NAME --data DIR --out DIR. Unknown options are refused."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession


def main(args: Sequence[str] | None = None) -> int:
    """Parse and run; 0 if all went well, 1 if a module failed."""
    p = argparse.ArgumentParser(prog="gristmill", allow_abbrev=False)
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("run", allow_abbrev=False, help="scan source trees")
    scan.add_argument("roots", nargs="+")
    scan.add_argument("--out", required=True)
    scan.add_argument("--prior", help="folder of an earlier run to merge with")
    scan.add_argument("--k8s-manifests", help="folder of deployment manifests")
    scan.add_argument("--modules", help="names with commas between them; all by default")
    one = sub.add_parser("query", allow_abbrev=False, help="run one registered query")
    one.add_argument("name")
    one.add_argument("--data", required=True, help="folder of the Parquet tables")
    one.add_argument("--out", required=True)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("gristmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "query":
        from gristmill.plans import registry

        if a.name not in registry.QUERIES:
            p.error(f"no query {a.name}")
        registry.QUERIES[a.name](spark, a.data).write.mode("overwrite").parquet(a.out)
        return 0
    from gristmill.plans.run import run

    options = {"k8s_manifests": a.k8s_manifests} if a.k8s_manifests else {}
    fate = run(spark, a.roots, a.out, a.prior, options, None if a.modules is None else [m for m in a.modules.split(",") if m])
    print(json.dumps(fate))
    return int(any(v.startswith("failed") for v in fate.values()))


if __name__ == "__main__":
    raise SystemExit(main())
