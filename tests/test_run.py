"""A whole run over small trees, through the command line."""

import json

import pytest

from gristmill import __main__ as cli

ORDERS = """package shop.orders;
import shop.ledger.LedgerRepository;

@RestController
public class OrdersController {
  @GetMapping("/orders")
  public String all() { return find("x"); }
  public void later() { Thread.sleep(5); }
}
"""
LEDGER = """package shop.ledger;
import org.postgresql.Driver;

public class LedgerRepository {
  private final Store store;
  public void load() { open("y"); }
}
"""


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "shop"
    for name, text in {"src/OrdersController.java": ORDERS, "src/LedgerRepository.java": LEDGER, "test/OrdersTest.java": ORDERS, "src/application.properties": "spring.kafka.bootstrap-servers=k:9092\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    k8s = tmp_path / "k8s"
    k8s.mkdir()
    (k8s / "d.json").write_text(json.dumps({"kind": "Deployment", "metadata": {"name": "orders-controller", "namespace": "shop"}, "spec": {"template": {"spec": {"containers": [{"name": "a", "image": "x"}]}}}}))
    return root, k8s


def test_a_run_finds_units_relationships_and_what_is_missing(spark, tree, tmp_path, capsys):
    root, k8s = tree
    out = str(tmp_path / "out")
    assert cli.main(["run", str(root), "--out", out, "--k8s-manifests", str(k8s)]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"threat-signals": "written", "resilience-lens": "written"}
    units = {r.unit_id: r.kind for r in spark.read.parquet(f"{out}/units").collect()}
    assert units == {"src/OrdersController.java": "service", "src/LedgerRepository.java::LedgerRepository": "database", "src/application.properties::kafka": "topic"}
    rel = {(r.from_id, r.to_id, r.kind, r.grade) for r in spark.read.parquet(f"{out}/relationships").collect()}
    assert ("src/OrdersController.java", "src/LedgerRepository.java::LedgerRepository", "imports", "architecture") in rel and ("src/OrdersController.java", "k8s-namespace:shop", "deployed-in", "structural") in rel
    ignored = {(r.ref, r.reason) for r in spark.read.parquet(f"{out}/ignored_items").collect()}
    assert ("test/OrdersTest.java", "TEST_CODE") in ignored
    assert {r.flag[:2] for r in spark.read.json(f"{out}/silence_flags").collect()} == {"S2", "S6"}
    assert {r.file for r in spark.read.json(f"{out}/modules/threat-signals").collect()} == {"src/OrdersController.java"}
    (root / "src/OrdersController.java").write_text(ORDERS.replace("/orders", "/all").replace('@GetMapping', '  @PostMapping("/more")\n  @GetMapping'))
    again = str(tmp_path / "again")
    assert cli.main(["run", str(root), "--out", again, "--prior", out, "--modules", ""]) == 0
    fate = {r.id: r.outcome for r in spark.read.json(f"{again}/merge_report").collect()}
    assert fate["shop:src/OrdersController.java"] == "changed" and fate["shop:src/LedgerRepository.java::LedgerRepository"] == "unaffected"


def test_unknown_options_are_refused(tree):
    for args in (["run", str(tree[0]), "--out", "x", "--odd"], ["run", "--out", "x"], ["run", str(tree[0]), "-out", "x"], ["query", "nothing", "--data", "d", "--out", "o"]):
        with pytest.raises(SystemExit):
            cli.main(args)


def test_modules_of_other_versions_and_failing_ones_do_not_end_the_run(spark, tmp_path, monkeypatch):
    from gristmill.plans import run

    def broken(_):
        raise ValueError("no")

    monkeypatch.setattr(run, "MODULES", {"old": ("3", broken), "bad": ("17", broken)})
    assert run.run_modules(run.Run(spark, []), ["old", "bad", "odd"], str(tmp_path)) == {"old": "unsupported", "bad": "failed: no", "odd": "unknown"}
