"""Queries that run over whole tables."""

from __future__ import annotations

from corpuskiln.plans import registry
from corpuskiln.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_materials_are_all_parts(spark):
    found = registry.QUERIES["section_material_match"](spark, SF)
    assert found.select("material_id").distinct().count() == table(spark, SF, "part").count()
    part = {r.p_partkey: r for r in table(spark, SF, "part").collect()}
    types = {}
    for r in part.values():
        types.setdefault(r.p_brand, set()).add(r.p_type)
    pairs = {(r.section_id, r.material_id) for r in found.collect()}
    assert all(((b, k) in pairs) == (r.p_type in ts) for b, ts in types.items() for k, r in part.items() if r.p_retailprice > 1000)


def test_every_user_turn_is_asked(spark):
    found = registry.QUERIES["snippet_topk"](spark, SF).select("conv_id", "turn").distinct()
    turns = table(spark, SF, "conversations").filter("role = 'user'")
    # Only turns that share no token with any item have no row.
    assert found.join(turns, ["conv_id", "turn"], "left_anti").count() == 0
    assert found.filter("turn > 0").count() > 0.9 * turns.filter("turn > 0 and text rlike '[a-z]{2}'").count()
