from __future__ import annotations

import pytest

from docweave.config import Config, Field, Join, Relation, Resource, Version, load, validate, without_primary
from docweave.errors import InvalidArgument, UnknownResource
from docweave.plans.capabilities import field_capabilities
from docweave.plans.denorm import reverse_relations

FLAT = """
resources:
  - type: a
    version: 1
    fields: [{name: f, query: {search: primary}}]
    relations:
      - {resource: b, join: {local: id, foreign: a_id}, fields: [{name: g}]}
  - type: a
    version: 2
    readVersion: 2
    fields:
      fields: [{name: f, query: {search: primary}}, {name: n, type: long}]
      relations:
        - {resource: b, cardinality: one, join: {local: id, foreign: a_id}, fields: [{name: g}]}
  - type: b
    fields: [{name: g, query: {search: primary}}, {name: a_id}]
    relations:
      - {resource: a, strategy: reference, join: {local: a_id, foreign: id}, fields: [{name: f}]}
"""


def test_both_shapes():
    config = load(FLAT)
    assert [v.number for v in config.resource("a").ascending] == [1, 2]
    assert config.resource("a").read_version == 2 and config.resource("b").read_version == 1
    assert not config.resource("a").version().relation("b").many
    with pytest.raises(UnknownResource):
        config.resource("z")


@pytest.mark.parametrize(
    "text",
    [
        "resources: []",
        "resources: [{fields: []}]",
        "resources: [{type: a}, {type: a}]",
        "resources: [{type: a, readVersion: 3}]",
        "resources: [{type: a, version: -1}]",
        "resources: [{type: a, fields: [{name: x, type: geo_point}]}]",
        "resources: [{type: a, fields: [{name: x, query: {search: true}}]}]",
        "resources: [{type: a, fields: {fields: [{name: x}]}, relations: [{resource: a, join: {local: id, foreign: x}, fields: [{name: x}]}]}]",
        "resources: [{type: a, relations: [{resource: a, join: {local: id}, fields: [{name: x}]}]}]",
        "resources: [{type: a, relations: [{resource: b, join: {local: id, foreign: x}, fields: [{name: x}]}]}]",
        "resources: [{type: a, fields: [{name: x}], relations: [{resource: a, join: {local: id, foreign: x}, fields: [{name: y}]}]}]",
        "resources: [{type: a, fields: [{name: x}], relations: [{resource: a, cardinality: two, join: {local: id, foreign: x}, fields: [{name: x}]}]}]",
        "resources: [{type: a, fields: [{name: x}], relations: [{resource: a, strategy: copy, join: {local: id, foreign: x}, fields: [{name: x}]}]}]",
        "resources: [{type: a, fields: [{name: x}], relations: [{resource: a, join: {local: id, foreign: x}}]}]",
        "resources: [{type: a, fields: [{name: x}], relations: [{resource: a, join: {local: id, foreign: x, from: c}, fields: [{name: x}]}]}]",
        "resources: [{type: a, fields: [{name: x}], relations: [{resource: a, strategy: reference, join: {local: y, foreign: x}, fields: [{name: x}]}]}]",
        "resources: [{type: a, nestedBlocks: [{name: fields, scopeKey: s, fields: [{name: x}]}]}]",
        "resources: [{type: a, nestedBlocks: [{name: b, fields: [{name: x}]}]}]",
        "resources: [{type: a, nestedBlocks: [{name: b, scopeKey: x, fields: [{name: x}]}]}]",
    ],
)
def test_rules(text):
    with pytest.raises(InvalidArgument):
        load(text)


def test_cycles_of_siblings():
    rel = lambda name, source: Relation(name, Join("k", "id", source), (Field("x"),))
    make = lambda *relations: Resource("a", (Version(1, (Field("x"),), relations),), 1)
    others = tuple(Resource(n, (Version(1, (Field("x"), Field("k")),),), 1) for n in "bc")
    with pytest.raises(InvalidArgument):
        Config((make(rel("b", "c"), rel("c", "b")), *others))
    ordered = Config((make(rel("b", "c"), rel("c", "")), *others)).resource("a").version().denormalized
    assert [r.resource for r in ordered] == ["c", "b"]


def test_an_empty_set_is_fine_and_a_missing_primary_field_only_warns():
    validate(Config())
    with pytest.warns(UserWarning):
        config = load("resources: [{type: a, fields: [{name: x}]}]")
    assert without_primary(config) == [("a", 1)]


def test_capabilities_say_what_is_checked():
    rows = {(r[0], r[1], r[4]): r for r in field_capabilities(load(FLAT))}
    assert rows[("b", 1, "a.f")][6:] == (False, False, "eq,in,prefix,suffix,contains,exists")
    assert rows[("a", 2, "fields.n")][8].startswith("eq,neq,in,not_in,gt")


def test_only_a_join_of_the_parents_id_can_be_turned_round():
    assert reverse_relations(load(FLAT)) == {"b": [("a", "a_id")]}
