"""The set-up / sync / run jobs through the command line entry point."""

import json

from tessera import cli
from tessera.sources.ledger_store import EVIDENCES, Store
from tests import fixtures as fx


def test_setup_sync_run(spark, scratch_dir, capsys):
    store_path = f"{scratch_dir}/store"
    assert cli.main(["setup", "--store", store_path]) == 0
    created = json.loads(capsys.readouterr().out.strip().splitlines()[-1])["created"]
    assert len(created) == 6
    for name, df in (("tables", fx.tables_sheet(spark)), ("rules", fx.rules_sheet(spark)),
                     ("validations", fx.validations_sheet(spark))):
        df.coalesce(1).write.option("header", True).csv(f"{scratch_dir}/{name}.csv")
    assert cli.main(["sync", "--store", store_path, "--tables", f"{scratch_dir}/tables.csv",
                     "--rules", f"{scratch_dir}/rules.csv", "--validations", f"{scratch_dir}/validations.csv"]) == 0
    synced = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert synced["validations"] == {"INSERT": len(fx.VALIDATIONS_SHEET)}
    fx.run_frame(spark, "run1").write.parquet(f"{scratch_dir}/data/clientes.parquet")
    code = cli.main(["run", "--store", store_path, "--tables", "clientes", "--parquet-dir", f"{scratch_dir}/data"])
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert code == 1 and out["status"] == "FAILED" and out["tables"][0]["failed"] == 7
    assert Store(spark, store_path).read(EVIDENCES).count() == 13   # 3+1+2+2+2+1+2 (FIXTURES.md run1)
    assert cli.main(["unify", "--store", store_path]) == 0        # its staging table is absent
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"tables": 0, "appended": 0}
