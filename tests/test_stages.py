"""Release files to catalogue, twice: the second run must change nothing."""

import json

import pandas as pd

from larder import schemas, stages
from larder.sources import tables as stored
from tests.test_ingest import releases  # noqa: F401


def identities(payloads):
    def answer(text):
        foods = json.loads(text)["foods"]
        return json.dumps({"foods": [{"i": f["i"], "base": f["d"].split(",")[0].lower() + " ,", "kind": "ingredient", "prep": None} for f in foods]})
    return pd.Series([answer(p) for p in payloads])


def names(payloads):
    def answer(text):
        base = json.loads(text)["base"]
        good = {"display_name": base.title(), "emoji": "🍗", "commonness": .5, "keywords": ["Food "], "confidence": .9}
        return "not json" if base == "milk" else json.dumps(good)
    return pd.Series([answer(p) for p in payloads])


def test_refresh_twice(spark, releases, tmp_path):  # noqa: F811
    state, catalog = stages.refresh(stages.empty_state(spark), releases, identities, names, "run-1")
    foods = {r.fdc_id: r for r in state.tables["foods"].collect()}
    assert foods[2705384].description == "Milk, not further specified"
    assert foods[2705384].description_raw == "Milk, NFS"
    assert (foods[1105073].base_name, foods[1105073].base_key, foods[1105073].prep_label) == ("bananas", "banana", "raw")
    items = {r.merged_food_id: r for r in state.tables["items"].collect()}
    assert (items[1105073].display_name, items[1105073].keywords, items[1105073].review_status) == ("Bananas", "food", "auto_approved")
    assert (items[2705384].display_name, items[2705384].review_status) == (None, "needs_review")
    counts = stored.publish(catalog, str(tmp_path / "catalog"), 1)
    assert counts["foods"] == 2 and counts["merged_foods"] == 2 and counts["index_documents"] == 2
    log = [r for a in state.audit for r in a.collect()]
    logs = str(tmp_path / "logs")
    stages.store_logs(state, logs)
    kept = stored.read_log(spark, f"{logs}/audit", schemas.AUDIT)
    assert kept.count() == len(log) and kept.filter("timestamp is null").count() == 0
    assert stored.read_log(spark, f"{logs}/cleanup", schemas.CLEANUP).count() == 1
    assert all(r.updated_at for r in state.tables["foods"].collect())
    assert {"ingest", "description", "base_name", "group_created", "display_name", "validation_error"} <= {r.field for r in log}
    assert [r.rule for c in state.cleanup for r in c.collect()] == ["abbrev:NFS"]

    again, _ = stages.refresh(stages.State(state.tables), releases, identities, names, "run-2")
    fields = [r.field for a in again.audit for r in a.collect()]
    assert set(fields) <= {"validation_error"}, fields
