"""The stages from release files to the published catalogue, over stored tables.

Each stage takes the tables it needs and gives the next versions plus audit rows. A
stage's result is written before the next one reads it, so a run may stop between any
two stages and go on from there. Tables: foods, items, preps, links, nutrients,
portions, attributes, input_foods.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder import schemas
from larder.functions import labels
from larder.operators import catalog, changes, cluster, pivot, scoring
from larder.session import materialise
from larder.sources import tables
from larder.sources.release import CHILDREN, Release, ingest

Store = Callable[[DataFrame, str], DataFrame]
TRACKED = ("description_raw", "food_category", "source_version")
CARRIED = ("data_type", "fat_g", "publication_date", "ndb_number", "food_code", "wweia_category_number",
           "start_date", "end_date", "usda_footnote")


@dataclass
class State:
    """Current tables of a run and the logs it wrote."""

    tables: dict[str, DataFrame]
    audit: list[DataFrame] = field(default_factory=list)
    cleanup: list[DataFrame] = field(default_factory=list)


def empty_state(spark: SparkSession) -> State:
    shapes = {"foods": schemas.FOODS, "items": schemas.ITEMS, "preps": schemas.PREPS,
              **{name: schema for name, (_, schema) in CHILDREN.items()}}
    return State({name: spark.createDataFrame([], schema) for name, schema in shapes.items()})


def store_logs(state: State, root: str) -> None:
    """Write what the stages logged: each stage's audit rows, and clean-up rows of known foods."""
    for n, rows in enumerate(state.audit):
        tables.append_log(schemas.conform(rows, schemas.AUDIT), f"{root}/audit", f"stage-{n}")
    for n, rows in enumerate(state.cleanup):
        known = changes.known_only(rows, state.tables["foods"])
        tables.append_log(schemas.conform(known, schemas.CLEANUP), f"{root}/cleanup", f"stage-{n}")


def load_releases(state: State, releases: list[Release], run_id: str, store: Store = materialise) -> State:
    """Bring releases into the foods and replace the child rows of every food they hold."""
    spark = state.tables["foods"].sparkSession
    frames = ingest(spark, releases)
    incoming = store(frames["foods"].withColumnRenamed("description", "description_raw"), "incoming")
    merge = changes.upsert(state.tables["foods"], incoming, "fdc_id", TRACKED, CARRIED,
                           version="source_version", run_id=run_id, hold=lambda df: store(df, "merged"))
    next_tables = dict(state.tables, foods=store(merge.snapshot, "foods"))
    for name in CHILDREN:
        next_tables[name] = store(changes.replace_children(state.tables[name], frames[name], incoming, "fdc_id"), name)
    return State(next_tables, [*state.audit, merge.audit], state.cleanup)


def expand_descriptions(state: State, run_id: str, store: Store = materialise) -> State:
    """Descriptions from the raw text, so that a second run finds nothing to change."""
    foods, raw = state.tables["foods"], F.col("description_raw")
    full = labels.expand_abbreviations(raw)
    merge = changes.rewrite(foods, "fdc_id", {
        "description": labels.guarded(raw, full), "fat_percentage": labels.fat_percentage(full),
    }, run_id=run_id, hold=lambda df: store(df, "expanded"))
    log = foods.select("fdc_id", F.inline(labels.substitutions(raw)), F.lit(run_id).alias("run_id"))
    return State(dict(state.tables, foods=store(merge.snapshot, "foods")), [*state.audit, merge.audit],
                 [*state.cleanup, log])


def flag_brands(state: State, run_id: str, store: Store = materialise) -> State:
    flagged = labels.is_branded(F.col("description_raw"), F.col("data_type"))
    merge = changes.rewrite(state.tables["foods"], "fdc_id", {"brand_flagged": flagged}, run_id=run_id,
                            hold=lambda df: store(df, "flagged"))
    return State(dict(state.tables, foods=store(merge.snapshot, "foods")), [*state.audit, merge.audit], state.cleanup)


def identify(state: State, scorer: scoring.Scorer, run_id: str, model: str | None = None,
             limit: int | None = None, store: Store = materialise) -> State:
    """Ask the scorer for the identity of every food without one; failed batches stay open."""
    t = state.tables
    asked = scoring.canon_candidates(t["foods"], t["attributes"], t["input_foods"], limit)
    batched = store(scoring.to_batches(asked, scoring.sibling_order()), "batched")
    done, _ = scoring.score(scoring.canon_requests(batched), scorer, "batch", scoring.check_canon)
    merge = scoring.apply_identities(t["foods"], scoring.canon_answers(done, batched), model, run_id,
                                     hold=lambda df: store(df, "identified"))
    return State(dict(t, foods=store(merge.snapshot, "foods")), [*state.audit, merge.audit], state.cleanup)


def group(state: State, run_id: str, store: Store = materialise) -> State:
    """Items, preparations and links; names and human decisions on items are kept."""
    t = state.tables
    got = cluster.cluster(pivot.macro_input(t["foods"], t["nutrients"]), hold=lambda df: store(df, "grouped"))
    merge = changes.merge_clusters(t["items"], got.items, run_id, hold=lambda df: store(df, "regrouped"))
    foods, _ = changes.relink(t["foods"], got.links)
    next_tables = dict(t, items=store(schemas.conform(merge.snapshot, schemas.ITEMS), "items"),
                  preps=store(schemas.conform(got.preps, schemas.PREPS), "preps"), foods=store(foods, "foods"))
    return State(next_tables, [*state.audit, merge.audit], state.cleanup)


def name_items(state: State, scorer: scoring.Scorer, run_id: str, model: str | None = None,
               limit: int | None = None, store: Store = materialise) -> State:
    """Ask for the names of open items; answers that stay unusable send the item to review."""
    t = state.tables
    asked = store(scoring.enrich_requests(
        scoring.enrich_candidates(t["items"], t["preps"], t["foods"], t["attributes"], limit)), "asked")
    done, failed = scoring.score(asked, scorer, "merged_food_id", scoring.check_group)
    values = store(scoring.naming_values(done, t["items"], t["foods"]), "names")
    named = scoring.apply_enrichment(t["items"], values, model, run_id=run_id, hold=lambda df: store(df, "named"))
    routed = scoring.route_failures(store(named.snapshot, "items"), failed, run_id)
    return State(dict(t, items=store(routed.snapshot, "items")), [*state.audit, named.audit, routed.audit], state.cleanup)


def refresh(state: State, releases: list[Release], identities: scoring.Scorer, names: scoring.Scorer,
            run_id: str, store: Store = materialise, logs: str | None = None) -> tuple[State, dict[str, DataFrame]]:
    """Every stage in order; returns the new state and the catalogue tables to publish.

    The rows logged on the way are appended under ``logs``, when it is given.
    """
    state = load_releases(state, releases, run_id, store)
    state = expand_descriptions(state, run_id, store)
    state = flag_brands(state, run_id, store)
    state = identify(state, identities, run_id, store=store)
    state = group(state, run_id, store)
    state = name_items(state, names, run_id, store=store)
    if logs:
        store_logs(state, logs)
    return state, catalog.build_catalog(state.tables, hold=store)
