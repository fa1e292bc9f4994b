"""Resource configurations: their shape, how they are read from YAML, and the rules they must keep."""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from docweave.errors import InvalidArgument, UnknownResource

#: The field types a document can have, by family.
FAMILIES = {
    "keyword": "string",
    "text": "fulltext",
    "long": "numeric",
    "integer": "numeric",
    "double": "numeric",
    "float": "numeric",
    "date": "temporal",
    "boolean": "boolean",
    "ip": "ip",
}
#: Top-level names of a document that no block may take.
RESERVED = ("fields", "search_primary", "search_secondary", "resource_id")
TIERS = ("", "none", "primary", "secondary")


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "keyword"
    search: str = "none"

    @property
    def family(self) -> str:
        return FAMILIES[self.type]


@dataclass(frozen=True)
class Join:
    """The child's `foreign` equals the parent's `local`, or that of the first row of the sibling `source`."""

    local: str
    foreign: str
    source: str = ""


@dataclass(frozen=True)
class Relation:
    resource: str
    join: Join
    fields: tuple[Field, ...]
    cardinality: str = "many"
    strategy: str = "denormalize"

    @property
    def many(self) -> bool:
        return self.cardinality != "one"

    @property
    def reference(self) -> bool:
        return self.strategy == "reference"

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)


@dataclass(frozen=True)
class Block:
    """An array of structs that a plan supplies; every entry belongs to the scope that scope_key names."""

    name: str
    scope_key: str
    fields: tuple[Field, ...]


@dataclass(frozen=True)
class Version:
    number: int
    fields: tuple[Field, ...] = ()
    relations: tuple[Relation, ...] = ()
    blocks: tuple[Block, ...] = ()

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def relation(self, name: str) -> Relation | None:
        return next((r for r in self.relations if r.resource == name), None)

    def block(self, name: str) -> Block | None:
        return next((b for b in self.blocks if b.name == name), None)

    @property
    def denormalized(self) -> tuple[Relation, ...]:
        """Relations whose rows are copied in, each after the sibling that its key comes from, else as declared."""
        todo, done = [r for r in self.relations if not r.reference], []
        while todo:
            ready = next((r for r in todo if not r.join.source or any(d.resource == r.join.source for d in done)), None)
            if ready is None:
                raise InvalidArgument(f"relations of version {self.number} wait for each other: {', '.join(r.resource for r in todo)}")
            todo.remove(ready)
            done.append(ready)
        return tuple(done)


@dataclass(frozen=True)
class Resource:
    type: str
    versions: tuple[Version, ...]
    read_version: int = 0

    def version(self, number: int | None = None) -> Version:
        number = number or self.read_version
        for v in self.versions:
            if v.number == number:
                return v
        raise InvalidArgument(f"resource {self.type!r} has no version {number}")

    @property
    def ascending(self) -> tuple[Version, ...]:
        return tuple(sorted(self.versions, key=lambda v: v.number))


@dataclass
class Config:
    """All resources, in declared order; an empty set is allowed here, though a file must have one."""

    resources: tuple[Resource, ...] = ()
    by_type: dict[str, Resource] = field(init=False)

    def __post_init__(self):
        self.resources = tuple(r if r.read_version or not r.versions else replace(r, read_version=min(v.number for v in r.versions)) for r in self.resources)
        self.by_type = {r.type: r for r in self.resources}
        validate(self)

    def resource(self, name: str) -> Resource:
        if name not in self.by_type:
            raise UnknownResource(f"unknown resource {name!r}")
        return self.by_type[name]


def _field(raw: dict) -> Field:
    query = raw.get("query") or {}
    search = query.get("search", "") if isinstance(query, dict) else ""
    return Field(str(raw.get("name") or ""), str(raw.get("type") or "keyword"), _tier(search))


def _tier(search) -> str:
    if search is None or search == "":
        return "none"
    if not isinstance(search, str) or search not in TIERS:
        raise InvalidArgument(f"search must be primary, secondary or none, not {search!r}")
    return search


def _relation(raw: dict) -> Relation:
    join = raw.get("join") or {}
    return Relation(
        str(raw.get("resource") or ""),
        Join(str(join.get("local") or ""), str(join.get("foreign") or ""), str(join.get("from") or "")),
        tuple(map(_field, raw.get("fields") or ())),
        str(raw.get("cardinality") or "many"),
        str(raw.get("strategy") or "denormalize"),
    )


def _block(raw: dict) -> Block:
    return Block(str(raw.get("name") or ""), str(raw.get("scopeKey") or ""), tuple(map(_field, raw.get("fields") or ())))


def load(text: str) -> Config:
    """A configuration from YAML: entries with fields, relations and nestedBlocks side by side, or all three under fields."""
    import yaml

    raw = yaml.safe_load(text) or {}
    entries = raw.get("resources") or []
    if not entries:
        raise InvalidArgument("at least one resource is required")
    versions: dict[str, list[Version]] = {}
    read: dict[str, int] = {}
    for entry in entries:
        name = entry.get("type")
        if not name:
            raise InvalidArgument("a resource entry has no type")
        number = int(entry.get("version") or 1)
        shape = entry
        if isinstance(entry.get("fields"), dict):
            if entry.get("relations") or entry.get("nestedBlocks"):
                raise InvalidArgument(f"{name!r} version {number} has relations or blocks both under fields and beside it")
            shape = entry["fields"]
        made = versions.setdefault(name, [])
        if any(v.number == number for v in made):
            raise InvalidArgument(f"{name!r} version {number} is defined more than once")
        made.append(
            Version(number, tuple(map(_field, shape.get("fields") or ())), tuple(map(_relation, shape.get("relations") or ())), tuple(map(_block, shape.get("nestedBlocks") or ())))
        )
        if entry.get("readVersion"):
            read[name] = int(entry["readVersion"])
    config = Config(tuple(Resource(name, tuple(v), read.get(name, 0)) for name, v in versions.items()))
    for resource, number in without_primary(config):
        warnings.warn(f"resource {resource!r} version {number} has no primary search field", stacklevel=2)
    return config


def without_primary(config: Config) -> list[tuple[str, int]]:
    """Versions that no primary field makes searchable: worth a warning, not an error."""
    return [
        (r.type, v.number)
        for r in config.resources
        for v in r.ascending
        if not any(f.search == "primary" for f in (*v.fields, *(f for x in v.denormalized for f in x.fields)))
    ]


def validate(config: Config) -> None:
    """Raises InvalidArgument with all the rules that are broken."""
    found: list[str] = []
    for r in config.resources:
        found += _resource_faults(r)
    if not found:
        for r in config.resources:
            for v in r.versions:
                found += [f"{r.type!r} version {v.number}: {x}" for x in _relation_faults(config, v)]
    if found:
        raise InvalidArgument("; ".join(found))


def _fields_faults(what: str, fields: Iterable[Field]) -> list[str]:
    found = []
    for f in fields:
        if not f.name:
            found.append(f"{what}: a field has no name")
        if f.type not in FAMILIES:
            found.append(f"{what}: field {f.name!r} has the unknown type {f.type!r}")
        if f.search not in TIERS:
            found.append(f"{what}: field {f.name!r} has the unknown search tier {f.search!r}")
    return found


def _resource_faults(r: Resource) -> list[str]:
    if not r.type:
        return ["a resource has no name"]
    if not r.versions:
        return [f"{r.type!r} has no version"]
    found = [f"{r.type!r}: version {v.number} isn't above 0" for v in r.versions if v.number <= 0]
    if r.read_version not in [v.number for v in r.versions]:
        found.append(f"{r.type!r}: readVersion {r.read_version} isn't configured")
    for v in r.versions:
        what = f"{r.type!r} version {v.number}"
        found += _fields_faults(what, v.fields)
        for x in v.relations:
            if not (x.resource and x.join.local and x.join.foreign):
                found.append(f"{what}: a relation needs resource, join.local and join.foreign")
            if x.cardinality not in ("one", "many"):
                found.append(f"{what}: cardinality {x.cardinality!r} is neither one nor many")
            if x.strategy not in ("denormalize", "reference"):
                found.append(f"{what}: strategy {x.strategy!r} is neither denormalize nor reference")
            if not x.fields:
                found.append(f"{what}: relation {x.resource!r} has no fields")
            if x.resource in RESERVED:
                found.append(f"{what}: relation {x.resource!r} has a reserved name")
            found += _fields_faults(f"{what}, relation {x.resource!r}", x.fields)
        names = [b.name for b in v.blocks]
        for b in v.blocks:
            if not (b.name and b.scope_key and b.fields):
                found.append(f"{what}: a block needs name, scopeKey and fields")
            if b.name in RESERVED or v.relation(b.name) or v.field(b.name) or names.count(b.name) > 1:
                found.append(f"{what}: the block name {b.name!r} is taken")
            if any(f.name == b.scope_key for f in b.fields):
                found.append(f"{what}: block {b.name!r} has a field named like its scope key")
            found += _fields_faults(f"{what}, block {b.name!r}", b.fields)
    return found


def _relation_faults(config: Config, v: Version) -> list[str]:
    found = []
    for x in v.relations:
        target = config.by_type.get(x.resource)
        if target is None:
            found.append(f"relation to the unknown resource {x.resource!r}")
            continue
        known = {f.name for tv in target.versions for f in tv.fields} | {"id"}
        found += [f"{x.resource!r} has no field {f.name!r}" for f in x.fields if f.name not in known]
        sibling = v.relation(x.join.source) if x.join.source else None
        if x.join.source and (sibling is None or sibling.reference):
            found.append(f"relation {x.resource!r} takes its key from {x.join.source!r}, which isn't a denormalised sibling")
        elif x.reference and not x.join.source and x.join.local != "id" and not v.field(x.join.local):
            found.append(f"the reference to {x.resource!r} needs {x.join.local!r} as a root field")
        elif x.reference and sibling and x.join.local != "id" and not sibling.field(x.join.local):
            found.append(f"the reference to {x.resource!r} needs {x.join.local!r} as a field of {x.join.source!r}")
    if not found:
        try:
            v.denormalized  # noqa: B018  raises on a cycle
        except InvalidArgument as e:
            found.append(str(e))
    return found
