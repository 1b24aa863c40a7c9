"""Command line: the set-up, sync, run and unify jobs as one command each.

  python -m tessera.cli setup --store PATH
  python -m tessera.cli sync  --store PATH [--tables CSV] [--rules CSV] [--validations CSV] [--format csv|json]
  python -m tessera.cli run   --store PATH [--tables "a, b" | all] [--severity S] [--validation-id V]
                              [--parquet-dir DIR]
  python -m tessera.cli unify --store PATH [--parquet-dir DIR]

Tables to validate are resolved by name: a ``<name>.parquet`` dataset under
``--parquet-dir`` if given, else the session catalog.
"""

from __future__ import annotations

import argparse
import json
import sys

from tessera.session import build_session
from tessera.sources.catalog import TableResolver
from tessera.sources.ledger_store import Store
from tessera.sources.sheets import load_sheet


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="tessera")
    sub = ap.add_subparsers(dest="cmd", required=True)
    for name in ("setup", "sync", "run", "unify"):
        p = sub.add_parser(name)
        p.add_argument("--store", required=True, help="base path of config and ledger tables")
        p.add_argument("--master", default=None)
    sync = sub.choices["sync"]
    sync.add_argument("--tables")
    sync.add_argument("--rules")
    sync.add_argument("--validations")
    sync.add_argument("--format", default="csv", choices=["csv", "json"])
    run = sub.choices["run"]
    run.add_argument("--tables", default="all")
    run.add_argument("--severity")
    run.add_argument("--validation-id")
    for p in (run, sub.choices["unify"]):
        p.add_argument("--parquet-dir")
    args = ap.parse_args(argv)

    spark = build_session(args.master)
    store = Store(spark, args.store)
    if args.cmd == "setup":
        print(json.dumps({"created": store.create_tables()}))
    elif args.cmd == "sync":
        from tessera.plans.config import sync_config
        sheets = {k: (load_sheet(spark, getattr(args, k), args.format) if getattr(args, k) else None)
                  for k in ("tables", "rules", "validations")}
        report = sync_config(store, **sheets)
        summary = {k: {} for k in report}
        for k, rows in report.items():
            for r in rows:
                summary[k][r["action"]] = summary[k].get(r["action"], 0) + 1
        print(json.dumps(summary))
    elif args.cmd == "unify":
        from tessera.plans.ledger import unify_job
        print(json.dumps(unify_job(spark, store, TableResolver(spark, args.parquet_dir))))
    else:
        from tessera.plans.run import Runner
        runner = Runner(spark, store, TableResolver(spark, args.parquet_dir))
        rep = runner.run(args.tables, args.severity, args.validation_id)
        print(json.dumps({"execution_id": rep.execution_id, "status": rep.status,
                          "tables": [{"table": t.table_name, "status": t.status, "executed": t.executed,
                                      "failed": t.failed, "errors": t.errors} for t in rep.tables]}))
        return 0 if rep.status in ("SUCCESS", "SKIPPED") else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
