"""Moving from one schema version to another: aliases, readiness, differences, cleanup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.errors import InvalidArgument
from docweave.operators import state as st
from docweave.operators.engine import Engine
from docweave.plans.schema import document_schema, schema_diff
from docweave.sources.store import index_name, parse_index

#: The gates of a cutover, in the order in which they are told.
GATES = ("alias-state", "target-index", "coverage", "doc-gap", "stale-backlog")


def classify_move(resource: str, targets: list[str], version: int) -> str:
    """in-sync, create, forward, backward or foreign: what pointing an alias at a version would be."""
    if not targets:
        return "create"
    parsed = parse_index(targets[0]) if len(targets) == 1 else None
    if parsed is None or parsed[0] != resource:
        return "foreign"
    return "in-sync" if parsed[1] == version else "forward" if parsed[1] < version else "backward"


def verify_indices(engine: Engine) -> list[str]:
    """The read versions' indices that aren't there."""
    return [index_name(r.type, r.read_version) for r in engine.config.resources if not engine.store.exists(r.type, r.read_version)]


def converge(engine: Engine, force: bool = False) -> dict[str, str]:
    """Points every alias at its read version; returns the kind of move of each.

    An alias that leads to something foreign is never touched, one that would go back only with force; all that is
    refused is raised together, after the other aliases have been moved.
    """
    moves, refused = {}, []
    for r in engine.config.resources:
        move = classify_move(r.type, engine.store.alias(r.type), r.read_version)
        moves[r.type] = move
        if move == "foreign" or (move == "backward" and not force):
            refused.append(f"{r.type}: {move}")
        elif move != "in-sync":
            engine.store.point(r.type, index_name(r.type, r.read_version))
    if refused:
        raise InvalidArgument("aliases that were not moved: " + ", ".join(refused))
    return moves


def doc_gap(engine: Engine, resource: str, target: int) -> int:
    """Documents of the target version less those of the version that is read now."""
    targets = engine.store.alias(resource)
    parsed = parse_index(targets[0]) if len(targets) == 1 else None
    return engine.store.count(resource, target) - (engine.store.count(*parsed) if parsed else 0)


def cutover_readiness(engine: Engine, resource: str, target: int, accept_gap: tuple[str, ...] = ()) -> DataFrame:
    """A row for each gate: gate, ok, detail. accept_gap names types whose gap of documents is meant to be."""
    unknown = [r for r in accept_gap if r not in engine.config.by_type]
    if unknown:
        raise InvalidArgument(f"unknown types in accept_gap: {', '.join(unknown)}")
    engine.config.resource(resource).version(target)
    move = classify_move(resource, engine.store.alias(resource), target)
    there = engine.store.exists(resource, target)
    live, uncovered = st.coverage(engine.state(), engine.edge_sets(), resource, target).first()
    gap = doc_gap(engine, resource, target)
    waiting = st.backlog(engine.state()).where(F.col("type") == resource).agg(F.coalesce(F.sum("stale"), F.lit(0))).first()[0]
    found = {
        "alias-state": (move in ("forward", "create", "in-sync"), move),
        "target-index": (there, index_name(resource, target)),
        "coverage": (uncovered == 0, f"{uncovered} of {live} rows uncovered"),
        "doc-gap": (gap >= 0 or resource in accept_gap, f"{gap:+d} documents"),
        "stale-backlog": (waiting == 0, f"{waiting} rows wait"),
    }
    return engine.spark.createDataFrame([(i, g, *found[g]) for i, g in enumerate(GATES)], "ord int, gate string, ok boolean, detail string").orderBy("ord").drop("ord")


def live_diff(engine: Engine, resource: str, version: int) -> DataFrame:
    """How the configured schema of a version differs from its index; an index that isn't there lacks everything."""
    live = engine.store.mapping(resource, version)
    wanted = document_schema(engine.config.resource(resource).version(version))
    return schema_diff(engine.spark, wanted, live if live is not None else type(wanted)([]))


def classify_indices(engine: Engine) -> dict[str, str]:
    """keep, refuse or remove for every index: of a configured version, behind an alias all the same, or neither."""
    found = {}
    for name in engine.store.indices():
        resource, version = parse_index(name)
        known = resource in engine.config.by_type and any(v.number == version for v in engine.config.by_type[resource].versions)
        found[name] = "keep" if known else "refuse" if name in engine.store.alias(resource) else "remove"
    return found


def cleanup(engine: Engine) -> list[str]:
    """Removes the indices that can go; returns their names."""
    gone = [name for name, what in classify_indices(engine).items() if what == "remove"]
    for name in gone:
        engine.store.drop(name)
    return gone
