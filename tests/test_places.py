"""The ladder of place searches: every status, and what counts before what."""

import pytest

from tillwise.operators import places as pl

REQUESTS = "query_id bigint, address string, areas array<string>, context string, store_lat double, store_lon double, allow_fallback boolean"
GAZETTEER = "place_id bigint, place_name string, address string, lot_address string, category string, lat double, lon double"
OUTAGES = "query_id bigint, kind string, reason string"


def solve(spark, requests, places, outages=()):
    rows = [(i, a, areas, None, 37.5, 127.0, allow) for i, a, areas, allow in requests]
    out = pl.resolve_ladder(spark.createDataFrame(rows, REQUESTS), spark.createDataFrame(places, GAZETTEER), spark.createDataFrame(list(outages), OUTAGES))
    return {r.query_id: (r.status, r.step, r.place_id, r.match_type, r.failure_codes) for r in out.collect()}


PLACES = [(1, "City Plaza", "Main Road 1", "Lot 1", "plaza", 37.5, 127.0), (2, "Old Hall", "Main Road 2", "Lot 2", "venue", 37.5, 127.0), (3, "New Hall", "Main Road 2", "Lot 3", "venue", 37.5, 127.0),
          (4, "Ghost Park", "Side Road 9", "Lot 9", "park", 137.5, 127.0), (5, "Seocho", "Seocho District", None, "public", 37.49, 127.01), (6, "Corner Cafe", "Side Road 3", None, "cafe", 37.5, 127.0)]


@pytest.mark.parametrize("hot", [10_000, 1])
def test_ladder(spark, monkeypatch, hot):
    """With a limit of 1 every word of more than one place is split."""
    monkeypatch.setattr(pl, "HOT", hot)
    requests = [(1, "Main  Road, 1", [], True), (2, "Lot 3", [], True), (3, "Main Road 2", [], True), (4, "City Plaza", [], True), (5, "Unknown thing", ["Seocho"], True), (6, "Unknown thing", ["Seocho"], False), (7, "Unknown thing", [], True),
                (8, "", ["Seocho"], True), (9, None, [], True), (10, "Lot 9", [], True), (11, "Old Hall, City Plaza", [], True), (12, "Corner Cafe", [], True), (13, "Unknown thing", ["Seocho"], True), (14, "City Plaza", [], True)]
    got = solve(spark, requests, PLACES, [(13, "KEYWORD", "HTTP_500"), (14, "ADDRESS", "TIMEOUT")])
    assert got[1] == ("SUCCESS", 0, 1, "EXACT_ROAD_ADDRESS", []) and got[2] == ("SUCCESS", 0, 3, "EXACT_LOT_ADDRESS", [])
    assert got[3][0] == "AMBIGUOUS"  # two places at one road address, and both halls score alike
    assert got[4] == ("SUCCESS", 1, 1, "KEYWORD", [])
    assert got[5] == ("SUCCESS", pl.AREA_STEP, 5, "ADMINISTRATIVE_AREA_FALLBACK", [])
    assert got[6][0] == got[7][0] == got[12][0] == "NOT_FOUND"
    assert got[8] == got[9] == ("FAILED", None, None, None, ["EMPTY_ADDRESS"])
    assert got[10][0] == "PROVIDER_ERROR" and got[10][4] == ["INVALID_COORDINATES"]  # its park has no valid place either
    assert got[11][:3] == ("SUCCESS", 2, 2)  # the whole name has two places, its first part one
    assert got[13] == ("PROVIDER_ERROR", None, None, None, ["HTTP_500"])  # no area: the plain search did not answer
    assert got[14][:3] == ("SUCCESS", 1, 1)


def test_empty_tables(spark):
    assert solve(spark, [], PLACES) == {}
    assert solve(spark, [(1, "Main Road 1", [], True)], []) == {1: ("NOT_FOUND", None, None, None, [])}


def test_many_asking_alike_are_matched_once(spark):
    """300 requests for 400 places whose words they share: rows grow with texts, points and places, not with their product."""
    places = [(i, "North Plaza", f"Road {i % 3} East", None, ("public", "office")[i % 2], 37.5 + (i % 4) / 100, 127.0) for i in range(400)]
    requests = [(q, "Plaza East", [], None, 37.5 + (q % 5) / 100, 127.0, True) for q in range(300)]
    searches = pl.search_steps(spark.createDataFrame(requests, REQUESTS))
    gazetteer = spark.createDataFrame(places, GAZETTEER)
    rows = pl.candidates(searches, gazetteer)
    assert rows.count() <= 5 * 2 * 4 * 2  # sites, scores, points, two places each
    got = {r.query_id: r for r in pl.match_venues(rows).collect()}
    want = pl.match_venues(searches.where("step = 1").select("query_id", "query", "area", "context", "store_lat", "store_lon").crossJoin(gazetteer.drop("lot_address")))
    sites = {r.query_id: r.site for r in searches.where("step = 1").withColumn("site", pl.asked_site()).collect()}
    for r in want.collect():
        mine = got[sites[r.query_id]]
        assert (mine.status, mine.place_id, mine.score, mine.distance_m) == (r.status, r.place_id, r.score, r.distance_m)
