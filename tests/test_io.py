import json

from wayloom.sources import io


def test_features_and_settings(spark, tmp_path):
    square = [[[0, 0], [2, 0], [2, 2], [0, 0]]]
    layer = {"type": "FeatureCollection", "features": [
        {"properties": {"name": "A", "size": "3"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"properties": {"name": "B"}, "geometry": {"type": "Point", "coordinates": [1.5, 2]}},
        {"properties": {}, "geometry": None},
        {"properties": {}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}},
    ]}
    (tmp_path / "l.geojson").write_text(json.dumps(layer))
    rows = io.read_features(spark, str(tmp_path / "l.geojson"), "x").collect()
    assert [r.feature_idx for r in rows] == [0, 1, 2, 3]
    assert rows[0].geometry.parts[0][0][1].x == 2.0 and rows[1].geometry.parts[0][0][0].y == 2.0
    assert rows[2].geometry.type is None and len(rows[3].geometry.parts) == 2
    (tmp_path / "m.json").write_text(json.dumps({"modes": {"foot": {"label": "On foot", "milesPerDay": 20}}, "terrainCost": {"road": 1.0}}))
    modes, costs = io.read_modes(spark, str(tmp_path / "m.json"))
    assert modes.first().offRoadPenalty == 1.0 and modes.first().impassable == [] and costs.first().cost == 1.0
    (tmp_path / "p.json").write_text(json.dumps({"places": [{"name": "Q", "lon": 1.0, "lat": 2.0}]}))
    p = io.read_places_patch(spark, str(tmp_path / "p.json")).first()
    assert (p.fid, p.type, p.size, p.confirmed) == ("custom-0", "Other", 3, 1)


def test_pages(spark, tmp_path):
    (tmp_path / "d.xml").write_text('<mediawiki><page><title>T</title><revision><text xml:space="preserve">a</text></revision><revision><text>b</text></revision></page></mediawiki>')
    assert [(r.title, r.rev_no, r.text) for r in io.read_revisions(spark, str(tmp_path / "d.xml")).orderBy("rev_no").collect()] == [("T", 0, "a"), ("T", 1, "b")]
    (tmp_path / "c" / "w").mkdir(parents=True)
    (tmp_path / "c" / "w" / "s.json").write_text(json.dumps({"found": True, "title": "S", "wikitext": "x"}))
    r = io.read_page_cache(spark, str(tmp_path / "c")).first()
    assert (r.wiki, r.slug, r.found) == ("w", "s", True)


def test_products(spark, tmp_path):
    cells = spark.createDataFrame([(x, y, (x + y) % 10) for x in range(3) for y in range(2)], "cx int, cy int, cls int")
    io.write_terrain(cells, str(tmp_path / "t"))
    assert {r.cy: bytes(r.classes) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {0: b"\0\1\2", 1: b"\1\2\3"}
    tiles = spark.createDataFrame([(2, 0, 0, b"a"), (3, 0, 1, b"b")], "z int, tx int, ty int, rgb binary")
    assert tuple(io.write_tiles(tiles, str(tmp_path / "z")).first()) == (2, 3, 2)


def test_pages_in_pieces(spark, tmp_path):
    """Elements that hold pieces of a page, in any order; revisions are written without being gathered by page."""
    (tmp_path / "d.xml").write_text(
        "<export><page><title>T</title><first>2</first><revision><text>c</text></revision><revision><text></text></revision></page>"
        "<page><title>T</title><revision><text>a</text></revision><revision><text>b</text></revision></page></export>"
    )
    read = io.read_revisions(spark, str(tmp_path / "d.xml")).orderBy("rev_no").collect()
    assert [(r.title, r.rev_no, r.text) for r in read] == [("T", 0, "a"), ("T", 1, "b"), ("T", 2, "c"), ("T", 3, "")]
    rows = [(t, n, f"<{t}> & {n}" if n % 7 else "") for t in ("T", "U & V") for n in range(50)]
    io.write_revisions(spark.createDataFrame(rows, "title string, rev_no long, text string"), str(tmp_path / "e"))
    assert sorted(map(tuple, io.read_revisions(spark, str(tmp_path / "e")).collect())) == sorted(rows)
