import datetime as dt

import pytest

from tessera.plans.bundle_sync import Collision, playbook, query, status, sync_bundle
from tessera.sources.bundle import read_bundle
from tessera.store import Store

NOW = dt.datetime(2026, 1, 1)


def write(root, **files):
    for f in root.rglob("*.md"):
        f.unlink()
    for name, body in files.items():
        path = root / (name.replace("__", "/") + ".md")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"---\ntype: note\nengine: js\n---\n{body}")


def test_sync(spark, tmp_path):
    store, root = Store(spark, str(tmp_path / "store")), tmp_path / "alpha"
    root.mkdir()
    run = lambda name="alpha": sync_bundle(store, read_bundle(spark, str(root)), name, str(root), NOW)
    write(root, tables="dir", tables__x="```js\nrun()\n```", a1="[x](tables/x.md) [w](https://w.org) [out](ghost.md)", a2="plain")
    first = run()
    assert (first["inserted"], first["links_attempted"], first["citations_attempted"]) == (4, 1, 1)
    assert [tuple(r) for r in store.read("hierarchy").collect()] == [("tables", "tables/x")]
    again = run()
    assert (again["inserted"], again["skipped"], again["links_attempted"]) == (0, 4, 1)
    assert store.read("concept_link").count() == 1 and store.read("containment").count() == 4
    assert playbook(store, "tables/x")["program"] == "run()"
    with pytest.raises(ValueError, match="no program"):
        playbook(store, "a2")

    members = spark.createDataFrame([("p", "a2", NOW, None, NOW)], "spec_hash string, member string, valid_from timestamp_ntz, valid_to timestamp_ntz, computed_at timestamp_ntz")
    shared = store.read("containment").union(spark.createDataFrame([("beta", "tables/x")], "bundle_name string, concept_id string"))
    store.commit({"population_member": members, "containment": shared}, store.version())
    write(root, tables="dir", a1="no links now")
    third = run()
    assert (third["updated"], third["skipped"], third["released"], third["retired"], third["deleted"]) == (1, 1, 1, 1, 0)
    assert store.read("concept_link").count() == store.read("citation").count() == 0
    with pytest.raises(ValueError, match="retired"):
        playbook(store, "a2")
    with pytest.raises(Collision, match="tables"):
        run("other")
    assert {r["bundle_name"]: r["n"] for r in status(store).collect()} == {"alpha": 3}
    assert query(store, "select concept_id from {concept} where concept_id = :id", id="a1").count() == 1
