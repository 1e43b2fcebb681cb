"""Tiles: stamps, sorties, coverage, selection, documents."""

import json
import math

import pytest
from pyspark.sql import functions as F

from cellbasis.functions.refusals import AoiRefusal, CatalogueRefusal, PrecheckRefusal, SelectionRefusal, StampRefusal
from cellbasis.operators import catalogue
from cellbasis.sources import documents

NAMED = 'PROJCS["ETRS89_Portugal_TM06",GEOGCS["ETRS89",AUTHORITY["EPSG","4258"]],UNIT["metre",1,AUTHORITY["EPSG","9001"]]]'
TAGGED = 'PROJCS["x",GEOGCS["ETRS89",AUTHORITY["EPSG","4258"]],UNIT["metre",1,AUTHORITY["EPSG","9001"]],AUTHORITY["EPSG","3763"]]'

# a strip of five tiles, 400 wide and 250 high, in UTM; the area ends within the first and the last
AREA = (500150.0, 4600020.0, 501900.0, 4600240.0)
EVENING, NEXT_EVENING = "2023-09-11 19:30:00", "2023-09-12 19:30:00"


def strip(spark, wide=400.0, **columns):
    """The strip's tiles s0 .. s4; `columns` replaces a column's values by tile number."""
    rows = []
    for k in range(5):
        left = 500000.0 + 400.0 * k
        row = {"item_id": f"s{k}", "minx": left, "miny": 4600000.0, "maxx": left + wide, "maxy": 4600250.0, "crs_epsg": 32629, "point_count": 1_500_000, "s": EVENING}
        rows.append(tuple((row | {c: v[k] for c, v in columns.items() if k in v}).values()))
    return _frame(spark, rows)


def _frame(spark, rows):
    made = spark.createDataFrame(rows, "item_id string, minx double, miny double, maxx double, maxy double, crs_epsg int, point_count long, s string")
    return made.withColumn("stamp", F.to_timestamp("s")).drop("s")


def test_an_area_within_the_strip_takes_all_of_it(spark):
    got = catalogue.select_tiles(strip(spark), AREA)
    assert (got.covered_fraction, got.sorties, got.mixed_epochs, got.dropped) == (1.0, 1, False, [])
    assert [r.item_id for r in got.tiles.collect()] == ["s0", "s1", "s2", "s3", "s4"]
    middle = catalogue.select_tiles(strip(spark), (500410.0, 4600010.0, 500790.0, 4600030.0))
    assert [r.item_id for r in middle.tiles.collect()] == ["s1"]  # edges that only touch don't count


@pytest.mark.parametrize("wide, fraction", [(400.0, 1.0), (640.0, 1.0), (300.0, 1350 / 1750), (399.5, 1748 / 1750)])
def test_coverage_is_that_of_the_union(spark, wide, fraction):
    """Gaps between tiles count however thin; what several tiles hold counts once."""
    got = catalogue.covered_area(strip(spark, wide), AREA).first()
    assert got.fraction == pytest.approx(fraction, abs=1e-12) and got.covered == pytest.approx(fraction * 1750 * 220)


def test_of_two_flights_over_one_footprint_the_main_flight_stays(spark):
    older = _frame(spark, [("a-first", 500400.0003, 4600000.0002, 500800.0, 4600250.0, 32629, 7, NEXT_EVENING)])
    got = catalogue.select_tiles(strip(spark).unionByName(older), AREA)
    assert got.dropped == ["a-first"] and got.sorties == 1 and got.tiles.count() == 5
    twin = _frame(spark, [("r", 500400.0, 4600000.0, 500800.0, 4600250.0, 32629, 7, EVENING)])
    assert catalogue.select_tiles(strip(spark).unionByName(twin), AREA).dropped == ["s1"]  # same flight: the first name stays


REFUSED = {
    "an area without extent": (dict(), (500150.0, 4600020.0, 500150.0, 4600240.0), dict(), "empty"),
    "an area elsewhere": (dict(), (1.0, 1.0, 2.0, 2.0), dict(), "no tile"),
    "two systems": (dict(crs_epsg={3: 25829}), AREA, dict(), "several systems"),
    "no system": (dict(crs_epsg={2: None}), AREA, dict(), "name no system"),
    "two flights": (dict(s={0: NEXT_EVENING}), AREA, dict(), "sorties"),
    "a tile too narrow": (dict(maxx={2: 501100.0}), AREA, dict(), "cover"),
    "too much": (dict(), AREA, dict(max_km2=0.49), "km2"),
}


@pytest.mark.parametrize("case", REFUSED)
def test_selections_that_are_refused(spark, case):
    columns, box, options, why = REFUSED[case]
    with pytest.raises(SelectionRefusal, match=why):
        catalogue.select_tiles(strip(spark, **columns), box, **options)


def test_two_flights_can_be_allowed(spark):
    got = catalogue.select_tiles(strip(spark, s={0: NEXT_EVENING}), AREA, allow_mixed=True)
    assert got.mixed_epochs and got.sorties == 2 and got.covered_fraction == 1.0


def test_gap_is_strict(spark):
    rows = [("2024-01-01 00:00:00",), ("2024-01-01 06:00:00",), ("2024-01-01 12:00:01",)]
    frame = spark.createDataFrame(rows, "t string").select(F.lit(1).alias("k"), F.to_timestamp("t").alias("stamp"))
    assert [r.sortie for r in catalogue.sorties(frame, ["k"]).orderBy("stamp").collect()] == [0, 0, 1]
    with pytest.raises(StampRefusal):
        catalogue.sorties(frame, ["k"], gap_hours=0)


def test_stamps_need_an_offset(spark):
    good = spark.createDataFrame([("2024-07-01T22:00:00Z",), ("2024-07-02T00:00:00+02:00",)], "t string")
    assert catalogue.stamps_from_text(good, "t").select("stamp").distinct().count() == 1
    for bad in ("2024-07-01T22:00:00", "soon"):
        with pytest.raises(StampRefusal, match=bad):
            catalogue.stamps_from_text(spark.createDataFrame([(bad,)], "t string"), "t")


def test_precheck(spark):
    dense = 1_500_000 / (400 * 250)
    out = catalogue.precheck(strip(spark), 0.5, 0.4)
    assert out.count() == 5 and out.first().void_at_f == pytest.approx(math.exp(-dense * 0.25 * 0.4))
    thin = strip(spark, point_count={1: 100_000, 3: 100_000})
    with pytest.raises(PrecheckRefusal, match="s1"):
        catalogue.precheck(thin, 0.5, 0.4)
    assert catalogue.precheck(thin, 0.5, 0.4, allow_sparse=True).count() == 5
    for bad in (-0.1, 0.0, 1.0, float("inf"), float("nan")):
        with pytest.raises(PrecheckRefusal, match="ceiling"):
            catalogue.precheck(thin, 0.5, 0.4, ceiling=bad)


def test_tiles_without_an_entry_are_refused(spark):
    read = spark.createDataFrame([("s4", 1), ("unheard", 2)], "item_id string, n int")
    with pytest.raises(SelectionRefusal, match="unheard"):
        catalogue.with_catalogue(read, strip(spark))
    assert catalogue.with_catalogue(read.where("n = 1"), strip(spark)).first().point_count == 1_500_000


def test_every_system_of_a_response_is_read(spark):
    """However many texts name it: none is left without a code."""
    texts = [NAMED.replace("UNIT", f'REMARK["{k}"],UNIT') for k in range(1100)]
    got = documents.system_codes(spark.createDataFrame([(t,) for t in texts], "wkt string"))
    assert got.where("crs_epsg = 3763").count() == 1100
    with pytest.raises(CatalogueRefusal, match="no known code"):
        documents.parse_search(bodies(spark, item(), item(**{"proj:wkt2": 'PROJCS["unheard"]'})), "body", 10)


def item(**change):
    p = {"pc:count": 5, "datetime": "2024-07-01T22:00:00Z", "file:size": 9, "proj:bbox": [1.0, 2.0, 0.0, 3.0, 4.0, 9.0], "proj:wkt2": NAMED}
    p.update(change)
    return {"id": "a", "collection": "LAZ", "properties": {k: v for k, v in p.items() if v is not None}, "assets": {"data": {"href": "h"}}}


def bodies(spark, *features, **context):
    doc = {"features": list(features)} | ({"context": context} if context else {})
    return spark.createDataFrame([(json.dumps(doc),)], "body string")


def test_search_response(spark):
    got = documents.parse_search(bodies(spark, item(), item(**{"proj:bbox": [1.0, 2.0, 3.0, 4.0]})), "body", 10).collect()
    assert [(r.minx, r.miny, r.maxx, r.maxy, r.crs_epsg) for r in got] == [(1.0, 2.0, 3.0, 4.0, 3763)] * 2
    for missing in ("proj:bbox", "proj:wkt2", "pc:count", "datetime", "file:size"):
        with pytest.raises(CatalogueRefusal, match=missing):
            documents.parse_search(bodies(spark, item(**{missing: None})), "body", 10)
    with pytest.raises(CatalogueRefusal, match="cut off"):
        documents.parse_search(bodies(spark, item()), "body", 1)
    with pytest.raises(CatalogueRefusal, match="cut off"):
        documents.parse_search(bodies(spark, item(), returned=500), "body", 500)
    with pytest.raises(CatalogueRefusal, match="features"):
        documents.parse_search(spark.createDataFrame([("{}",)], "body string"), "body", 10)
    with pytest.raises(Exception, match="4 or 6"):
        documents.parse_search(bodies(spark, item(**{"proj:bbox": [1.0]})), "body", 10).collect()


def test_system_of_a_wkt_is_not_its_unit():
    assert documents.epsg_of_wkt(NAMED) == 3763 and documents.epsg_of_wkt(TAGGED) == 3763
    for bad in ('GEOGCS["ETRS89",AUTHORITY["EPSG","4258"]]', 'PROJCS["unheard",UNIT["metre",1,AUTHORITY["EPSG","9001"]]]', ""):
        with pytest.raises(CatalogueRefusal):
            documents.epsg_of_wkt(bad)


def ring(**more):
    return {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[-8.2, 41.2], [-8.1, 41.2], [-8.1, 41.3], [-8.2, 41.2]]]}} | more


def test_area_precedence():
    declared = ring(properties={"bounds": [1, 2, 3, 4], "bounds_epsg": 3763})
    assert documents.area_of_interest(json.dumps(declared), crs=32629) == (1.0, 2.0, 3.0, 4.0, 3763)
    named = documents.area_of_interest(json.dumps(ring(properties={"bounds_epsg": 3763})), crs=32629)
    assert named[4] == 3763 and named[0] < named[2]
    assert documents.area_of_interest(json.dumps(ring()), crs=32629)[4] == 32629
    own = ring(geometry={"type": "Polygon", "crs_epsg": 3763, "coordinates": [[[0, 0], [5, 0], [5, 7], [0, 0]]]})
    assert documents.area_of_interest(json.dumps(own)) == (0.0, 0.0, 5.0, 7.0, 3763)
    for bad in (ring(), ring(properties={"bounds": [1, 2, 3, 4]}), ring(properties={"bounds": [1, 2], "bounds_epsg": 3763}), ring(geometry={"type": "Point", "coordinates": [0, 0]})):
        with pytest.raises(AoiRefusal):
            documents.area_of_interest(json.dumps(bad))


def test_selection_document(spark, tmp_path):
    path = tmp_path / "selection.json"
    path.write_text(json.dumps({"bbox": [0, 0, 1, 1], "tiles": [{"item_id": "a", "point_count": 3}, {"item_id": "b", "point_count": 4}]}, indent=1))
    assert sorted(r.item_id for r in documents.selection(spark, str(path)).collect()) == ["a", "b"]
