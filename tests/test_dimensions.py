"""Readers and codecs of dimension tables."""

import pytest
from pyspark.sql import functions as F

from millrace.sources import dimensions as dim


def test_csv_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Name,ID,Extra\n"Bolt, ""Great""",12,x\nTwo\t,7y,z\n"three\nlines",8,\n')
    rows = dim.csv_table(spark, str(tmp_path / "a.csv"), {"ID": "long", "Name": "string"}).collect()
    assert [(r.ID, r.Name) for r in rows] == [(12, 'Bolt, "Great"'), (None, "Two\t"), (8, "three\nlines")]
    with pytest.raises(ValueError, match="no column Mask"):
        dim.csv_table(spark, str(tmp_path / "a.csv"), {"Mask": "long"})


def test_lua_tables(spark):
    good = 'T = { ["enemies"] = { { ["id"] = 12, name = "Imp \\"x\\"", count = 4, clones = { { x = 1.5, y = -2, g = 3, sublevel = 1 }, [7] = { x = 2, y = 3, sublevel = 2 }, }, }, -- one\n { id = 13, name = "Ogre" } } }'
    files = spark.createDataFrame([("a", good), ("b", "T = { f() }"), ("c", "T = { enemies = {"), ("d", None)], "path string, text string")
    leaves = dim.lua_entries(files)
    assert {r.path for r in leaves.collect()} == {"a"}
    got = {(r.enemy, r.clone): (r.npc_id, r.name, r["count"], r.group, r.sublevel, r.x, r.y) for r in dim.planner_spawns(leaves).collect()}
    assert got == {(1, 1): (12, 'Imp "x"', 4, 3, 1, 1.5, -2), (1, 7): (12, 'Imp "x"', 4, None, 2, 2, 3), (2, None): (13, "Ogre", None, None, None, None, None)}


def test_codec_rules_and_sinks(spark, tmp_path):
    row = spark.range(1).select(dim.delta_ids(F.lit("a.1.z")).alias("ids"), dim.delta_ids(F.lit("a~2.1~z"), payload=True).alias("pairs")).first()
    assert row.ids == [10, 11, 46] and [(p.id, p.value) for p in row.pairs] == [(10, 2), (11, 35)]
    nested = spark.createDataFrame([(1, 5, (7, 8, 100, 900), True)], "spell_id long, unless_own long, unless_after struct<cast:long,aura:long,from:long,ms:long>, tank boolean")
    assert dim.avoidable_rules(nested).first().asDict() == {"spell_id": 1, "unless": 5, "tank": True, "after_cast": 7, "after_aura": 8, "after_from": 100, "after_ms": 900}
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    for form in ("parquet", "json", "csv"):
        dim.save(df, str(tmp_path / form), form)
        assert spark.read.option("header", True).format(form).load(str(tmp_path / form)).count() == 1
