"""Venue and address matching over landed gazetteer responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.core import d
from tillwise.functions.geo import haversine_m
from tillwise.functions.places import normalize_address, normalize_venue, venue_forms
from tillwise.functions.skew import salted_join
from tillwise.functions.stages import new_stage
from tillwise.functions.text import unique_tokens

# Category words, score weights and the tie margin.
PUBLIC = "광장|관광|컨벤션|전시|공원|도로|다리|공공|문화|행사|공연|plaza|convention|park|road|bridge|public|landmark|venue"
COMMERCIAL = "음식점|카페|주점|쇼핑|restaurant|cafe|bar|food|retail|shopping"
PER_TOKEN, PER_CONTEXT, AREA, PUBLIC_BONUS, NEAR_KM, TIE = 12.0, 2.0, 30.0, 8.0, 6.0, 2.0


def _judged(rows: DataFrame) -> DataFrame:
    """The rows whose place may answer, with `_base`: their score without the distance. rows(query, context, area and a place's columns)."""
    rows = rows.withColumns({
        "_words": unique_tokens(normalize_venue(F.col("query"))), "_context": unique_tokens(F.col("context")), "_area": F.lower(normalize_address(F.col("area"))),
        "_text": F.lower(normalize_address(F.concat_ws(" ", "address", "place_name", "category")))})
    hits = lambda arr: F.size(F.filter(arr, lambda t: F.col("_text").contains(t)))
    kind = F.lower("category")
    rows = rows.withColumn("overlap", hits(F.col("_words")))
    public = kind.rlike(PUBLIC)
    usable = valid_coordinates(F.col("lat"), F.col("lon")) & ~(kind.rlike(COMMERCIAL) & ~public) & (
        (F.size("_words") == 0) | (F.col("overlap") > 0))
    base = (
        F.col("overlap") * PER_TOKEN + hits(F.col("_context")) * PER_CONTEXT
        + F.when((F.col("_area") != "") & F.col("_text").contains(F.col("_area")), d(AREA)).otherwise(d(0))
        + F.when(public, d(PUBLIC_BONUS)).otherwise(d(0)))
    return rows.filter(usable).withColumn("_base", base).drop("_words", "_context", "_area", "_text", "overlap")


def match_venues(responses: DataFrame) -> DataFrame:
    """Best place per query: SUCCESS, AMBIGUOUS (first two within the tie margin) or NOT_FOUND.

    responses: one row per (query_id, place_id) the provider returned, with query, context, area,
    place_name, address, category, lat, lon, store_lat, store_lon. Only the two best rows of a
    query leave a task."""
    asked = responses.groupBy("query_id").agg(F.min("query").alias("query"), F.min("context").alias("context"), F.min("area").alias("area"))
    rows = salted_join(responses.drop("query", "context", "area"), asked, ["query_id"], F.col("place_id"))
    distance = haversine_m(F.col("store_lat"), F.col("store_lon"), F.col("lat"), F.col("lon"))
    ranked = _judged(rows).withColumns({"distance_m": distance, "score": F.col("_base") + F.greatest(d(0), NEAR_KM - distance / 1000.0)})
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "distance_m", "place_id")
    top = ranked.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= 2)
    pick = lambda n: F.max(F.when(F.col("_r") == n, F.struct("score", "place_id", "lat", "lon", "distance_m")))
    found = top.groupBy("query_id").agg(pick(1).alias("a"), pick(2).alias("b"))
    all_queries = responses.select("query_id").distinct()
    tie = F.col("b").isNotNull() & (F.col("a.score") - F.col("b.score") < TIE)
    status = F.when(F.col("a").isNull(), "NOT_FOUND").when(tie, "AMBIGUOUS").otherwise("SUCCESS")
    good = status == "SUCCESS"
    return all_queries.join(found, "query_id", "left").select(
        "query_id", status.alias("status"), F.when(good, F.col("a.place_id")).alias("place_id"), F.when(good, F.col("a.score")).alias("score"),
        F.when(good, F.col("a.distance_m")).alias("distance_m"))


def match_addresses(responses: DataFrame) -> DataFrame:
    """Exact road match if unique, else exact lot match if unique and no road matched."""
    same = lambda c: normalize_address(F.col(c)) == normalize_address(F.col("query"))
    hit = lambda c: F.coalesce(same(c), F.lit(False))
    rows = responses.groupBy("query_id").agg(
        F.count("*").alias("n"), F.count_if(hit("road_address")).alias("roads"), F.count_if(hit("lot_address")).alias("lots"),
        F.min(F.when(hit("road_address"), F.col("place_id"))).alias("road_id"), F.min(F.when(hit("lot_address"), F.col("place_id"))).alias("lot_id"))
    road = F.col("roads") == 1
    lot = (F.col("roads") == 0) & (F.col("lots") == 1)
    return rows.select(
        "query_id", F.when(road | lot, "SUCCESS").otherwise("AMBIGUOUS").alias("status"),
        F.when(road, F.col("road_id")).when(lot, F.col("lot_id")).alias("place_id"),
        F.when(road, "EXACT_ROAD_ADDRESS").when(lot, "EXACT_LOT_ADDRESS").alias("match_type"))


# Steps of the ladder: the address, search forms from FORMS on in their order, the text as it stands, the area.
ADDRESS, FORMS, PLAIN, AREA_STEP = 0, 1, 1000, 1001
#: gazetteer entries of a word that one task joins
HOT = 10_000


def search_steps(requests: DataFrame) -> DataFrame:
    """(query_id, step, query, area, context, store_lat, store_lon): the searches of each request in order.

    requests(query_id, address, areas, context, store_lat, store_lon, allow_fallback)."""
    none = F.array().cast("array<string>")
    areas = F.coalesce("areas", none)
    forms = F.transform(venue_forms(F.col("address"), areas, F.col("context")), lambda f, i: F.struct((i + FORMS).alias("step"), f.alias("query")))
    plain = F.array(F.struct(F.lit(PLAIN).alias("step"), normalize_address(F.col("address")).alias("query")))
    fall = F.when(F.col("allow_fallback") & (F.size(areas) > 0), F.array(F.struct(F.lit(AREA_STEP).alias("step"), F.array_join(areas, " ").alias("query")))).otherwise(
        F.array().cast("array<struct<step:int,query:string>>"))
    rows = requests.withColumn("s", F.explode(F.concat(forms, plain, fall)))
    return rows.select("query_id", "s.step", "s.query", F.coalesce(F.get(areas, F.lit(0)), F.lit("")).alias("area"), F.coalesce("context", F.lit("")).alias("context"), "store_lat", "store_lon")


def asked_text() -> Column:
    """What a search asks, wherever it is asked from."""
    return F.to_json(F.struct("query", "area", "context"))


def asked_site() -> Column:
    """What a search asks and from where: searches alike in this have one answer."""
    return F.to_json(F.struct("query", "area", "context", "store_lat", "store_lon"))


def contenders(searches: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(ask, place columns): for each text asked, the places that can be among the two best of a search somewhere. A text
    is matched once, however many ask it; of places that score alike and stand at one point only two can be.

    Candidates hold the rarest of the text's words (all of them where several are as rare). Words that no place has do not
    count; the other words only score. Words of more than HOT places are split: their places are spread over tasks by
    place and their texts repeated, as often as the word's count asks for."""
    text = F.lower(normalize_address(F.concat_ws(" ", "address", "place_name", "category")))
    index = gazetteer.select("place_id", F.explode(unique_tokens(text)).alias("word"))
    asks = searches.select("query", "area", "context").distinct().withColumn("ask", asked_text())
    asked = asks.select("ask", F.explode(unique_tokens(normalize_venue(F.col("query")))).alias("word"))
    index = index.join(asked.select("word").distinct(), "word", "left_semi")
    sizes = index.groupBy("word").agg(F.count("*").alias("_n"))
    known = asked.join(sizes, "word")
    fewest = known.groupBy("ask").agg(F.min("_n").alias("_least"))
    asked = known.join(fewest, "ask").where("_n = _least").select("ask", "word")
    parts = sizes.select("word", F.ceil(F.col("_n") / HOT).cast("int").alias("parts")).where("parts > 1")
    dealt = index.join(parts, "word", "left").select("word", "place_id", F.coalesce(F.pmod(F.xxhash64("place_id"), F.col("parts")).cast("int"), F.lit(0)).alias("part"))
    repeated = asked.join(parts, "word", "left").select("ask", "word", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    # the index is as large as the gazetteer: not through the driver
    pairs = repeated.join(dealt.hint("merge"), ["word", "part"]).select("ask", "place_id").distinct()
    places = gazetteer.select("place_id", "place_name", "address", "category", "lat", "lon")
    rows = _judged(salted_join(salted_join(pairs, asks, ["ask"], F.col("place_id")), places, ["place_id"], F.col("ask")))
    first = Window.partitionBy("ask", "_base", "lat", "lon").orderBy("place_id")
    return rows.withColumn("_r", F.row_number().over(first)).where("_r <= 2").select("ask", *places.columns)


def candidates(searches: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Every site of the searches with its contenders, as rows for match_venues; query_id is the site."""
    sites = searches.select("query", "area", "context", "store_lat", "store_lon").distinct()
    sites = sites.withColumns({"query_id": asked_site(), "ask": asked_text()})
    # written, as the words are counted on one side of its joins and matched on the other
    found = new_stage(contenders(searches, gazetteer), "place-contenders")
    return salted_join(sites, found, ["ask"], F.struct("store_lat", "store_lon")).drop("ask")


def resolve_ladder(requests: DataFrame, gazetteer: DataFrame, outages: DataFrame) -> DataFrame:
    """(query_id, status, step, place_id, match_type, failure_codes): where each request is, by the first search that finds
    one clear place: its exact address, its search forms in order, its text. If that last search finds nothing and
    the request allows it, the area's own place stands in. Otherwise AMBIGUOUS comes before PROVIDER_ERROR before
    NOT_FOUND; an empty address is FAILED.

    gazetteer(place_id, place_name, address, lot_address, category, lat, lon); outages(query_id, kind, reason) are searches
    (ADDRESS, KEYWORD, AREA) that the provider failed to answer."""
    text = normalize_address(F.col("address"))
    usable = requests.where(F.coalesce(text, F.lit("")) != "")
    wanted = usable.select("query_id", text.alias("wanted"))
    sides = F.explode(F.array(F.struct(F.lit("road").alias("side"), normalize_address(F.col("address")).alias("wanted")), F.struct(F.lit("lot").alias("side"), normalize_address(F.col("lot_address")).alias("wanted"))))
    exact = gazetteer.select("place_id", "lat", "lon", sides.alias("s")).select("place_id", "lat", "lon", "s.side", "s.wanted").where("wanted is not null")
    exact = salted_join(exact, wanted, ["wanted"], F.col("place_id")).groupBy("query_id").agg(
        F.count_if(F.col("side") == "road").alias("roads"), F.count_if(F.col("side") == "lot").alias("lots"),
        *[F.min(F.when(F.col("side") == side, F.struct("place_id", "lat", "lon"))).alias(side) for side in ("road", "lot")])
    road, lot = F.col("roads") == 1, (F.col("roads") == 0) & (F.col("lots") == 1)
    hit = F.when(road, F.col("road")).when(lot, F.col("lot"))
    found = usable.select("query_id").join(exact, "query_id", "left").select("query_id", hit.alias("hit"), F.coalesce(F.col("roads") + F.col("lots"), F.lit(0)).alias("n"), F.when(road, "EXACT_ROAD_ADDRESS").when(lot, "EXACT_LOT_ADDRESS").alias("match_type"))
    status = F.when(F.col("hit").isNull() & (F.col("n") > 0), "AMBIGUOUS").when(F.col("hit").isNull(), "NOT_FOUND").when(valid_coordinates(F.col("hit.lat"), F.col("hit.lon")), "SUCCESS").otherwise("PROVIDER_ERROR")
    first = found.select("query_id", F.lit(ADDRESS).alias("step"), status.alias("status"), F.col("hit.place_id").alias("place_id"), "match_type", F.when(status == "PROVIDER_ERROR", "INVALID_COORDINATES").alias("reason"))
    # written, as the forms are long expressions and several steps read the same pairs
    searches = new_stage(search_steps(usable), "place-searches")
    matched = match_venues(new_stage(candidates(searches, gazetteer), "place-candidates")).select(F.col("query_id").alias("_site"), "status", "place_id")
    rest = salted_join(searches.select("query_id", "step", asked_site().alias("_site")), matched, ["_site"], F.col("query_id"), "left")
    kind = F.when(F.col("step") == AREA_STEP, "ADMINISTRATIVE_AREA_FALLBACK").otherwise("KEYWORD")
    rest = rest.select("query_id", "step", F.coalesce("status", F.lit("NOT_FOUND")).alias("status"), "place_id", kind.alias("match_type"), F.lit(None).cast("string").alias("reason"))
    tried = first.unionByName(rest).withColumn("kind", F.when(F.col("step") == ADDRESS, "ADDRESS").when(F.col("step") == AREA_STEP, "AREA").otherwise("KEYWORD"))
    lost = outages.groupBy(F.col("query_id").alias("_lost"), F.col("kind").alias("_kind")).agg(F.min("reason").alias("_why"))
    tried = tried.join(lost, (F.col("query_id") == F.col("_lost")) & (F.col("kind") == F.col("_kind")), "left")
    down = F.col("_lost").isNotNull()
    tried = tried.withColumns({"status": F.when(down, "PROVIDER_ERROR").otherwise(F.col("status")), "reason": F.when(down, F.col("_why")).otherwise(F.col("reason")), "place_id": F.when(~down, F.col("place_id"))})
    tried = new_stage(tried.select("query_id", "step", "status", "place_id", "match_type", "reason"), "place-tried")
    out = requests.select("query_id").join(resolve_places(tried), "query_id", "left")
    return out.select("query_id", F.coalesce("status", F.lit("FAILED")).alias("status"), "step", "place_id", "match_type",
                      F.when(F.col("status").isNull(), F.array(F.lit("EMPTY_ADDRESS"))).otherwise(F.col("failure_codes")).alias("failure_codes"))


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def resolve_places(tried: DataFrame) -> DataFrame:
    """tried(query_id, step, status, place_id, match_type, reason) to one row a query: the first success by step; the area
    step counts only where the plain text was NOT_FOUND."""
    plain = tried.where(F.col("step") == PLAIN).groupBy("query_id").agg(F.min("status").alias("_plain"))
    rows = tried.join(plain, "query_id", "left").where((F.col("step") != AREA_STEP) | (F.col("_plain") == "NOT_FOUND"))
    ok = F.col("status") == "SUCCESS"
    # what came after the first success was never asked
    rows = rows.groupBy("query_id").agg(
        F.min_by(F.when(ok, F.struct("step", "place_id", "match_type")), F.when(ok, F.col("step"))).alias("hit"), F.max(F.col("status") == "AMBIGUOUS").alias("ambiguous"),
        F.max(F.col("status") == "PROVIDER_ERROR").alias("broken"), F.array_sort(F.collect_set("reason")).alias("failure_codes"))
    status = F.when(F.col("hit").isNotNull(), "SUCCESS").when(F.col("ambiguous"), "AMBIGUOUS").when(F.col("broken"), "PROVIDER_ERROR").otherwise("NOT_FOUND")
    none = F.array().cast("array<string>")
    return rows.select("query_id", status.alias("status"), "hit.step", "hit.place_id", "hit.match_type", F.when(status == "PROVIDER_ERROR", F.col("failure_codes")).otherwise(none).alias("failure_codes"))
