"""FeatureCollection documents cut into byte ranges of any size."""

import json
import random

import pytest
from pyspark.sql import types as T

from segstats.sources import geojson as gj

PROPS = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
                      T.StructField("more", T.StructType([T.StructField("a", T.StringType())]))])


def features(n):
    rng = random.Random(n)
    names = ["plain", 'brace } and { in "quotes"', "back\\slash\\", "}{", "é🙂 }", "", 'ends with \\"', "\n}\t{", '"Feature"', "x" * 3000 + "}" * 40]
    out = []
    for i in range(n):
        line = [[rng.random(), rng.random()] for _ in range(rng.randint(2, 40))]
        out.append({"type": "Feature", "properties": {"id": i, "name": rng.choice(names), "more": {"a": rng.choice(["}", "{", "b"])}},
                    "geometry": {"type": "LineString", "coordinates": line}})
    return out


def check(spark, path, want):
    got = sorted(gj.read_feature_collection(spark, path, PROPS).collect(), key=lambda r: r.id)
    assert [(r.id, r.name, r.more.a, [list(c) for c in r.coordinates]) for r in got] == [
        (f["properties"]["id"], f["properties"]["name"], f["properties"]["more"]["a"], f["geometry"]["coordinates"]) for f in want]


@pytest.mark.parametrize("split", ["200", "1000", "7777", "100000"])
@pytest.mark.parametrize("form", ["compact", "indented", "script"])
def test_any_split_gives_the_same_rows(spark, tmp_path, split, form):
    want = features(60)
    doc = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "a}b"}}, "features": want, "end": {"x": {}}}
    text = json.dumps(doc, indent=1 if form == "indented" else None, ensure_ascii=form == "script")
    path = tmp_path / "layer.json"
    path.write_text(f"var layer = {text};\n" if form == "script" else text)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        n = gj._ranges(spark, str(path)).rdd.getNumPartitions()
        assert n >= min(4, path.stat().st_size // int(split))
        check(spark, str(path), want)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_several_files_and_empty_collections(spark, tmp_path):
    a, b = features(30), features(10)
    for f in b:
        f["properties"]["id"] += 1000
    for name, part in (("a", a), ("b", b), ("none", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"type": "FeatureCollection", "features": part}))
    check(spark, str(tmp_path), a + b)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "e.json").write_text('{"type": "FeatureCollection", "features": []}')
    assert gj.read_feature_collection(spark, str(tmp_path / "x"), PROPS).count() == 0
