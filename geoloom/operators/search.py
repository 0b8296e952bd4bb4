"""Text search over buildings: postings, exact and substring search, ranking, and the closest X to Y.

buildings: building_id, lat, lon, street, house_number, shop_name, address. queries: query_id, text and a viewport
(sw_lat, sw_lon, ne_lat, ne_lon).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import haversine, in_box
from ..functions.text import normalize_address, parse_closest, tokens
from ..plans.tables import settled


def postings(buildings: DataFrame) -> DataFrame:
    """(token, building_id), distinct: the words of each field by itself, the house number in digits."""
    fields = F.array("address", "shop_name", "street", F.col("house_number").cast("string"))
    words = buildings.select("building_id", F.explode(fields).alias("field"))
    return words.select(F.explode(tokens(normalize_address(F.col("field")))).alias("token"), "building_id").distinct()


def vocabulary(posting: DataFrame) -> DataFrame:
    return posting.select("token").distinct()


def grams(words: DataFrame, column: str = "token") -> DataFrame:
    """words with each distinct run (gram) of one to three characters in them: what substring search joins on."""
    chars = F.length(column)
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.least(chars, F.lit(3))),
            lambda n: F.transform(F.sequence(F.lit(1), chars - n + 1), lambda i: F.substring(F.col(column), i, n)),
        )
    )
    return words.where(chars > 0).select("*", F.explode(F.array_distinct(runs)).alias("gram"))


@dataclass
class Index:
    """What searches read, built once: postings (token, building_id), grams (token, gram) of the vocabulary, and the number
    of words (n) that each gram is in."""

    postings: DataFrame
    grams: DataFrame
    gram_counts: DataFrame


def build_index(buildings: DataFrame) -> Index:
    posting = postings(buildings)
    runs = grams(vocabulary(posting))
    return Index(posting, runs, runs.groupBy("gram").agg(F.count("*").alias("n")))


def get_buildings(posting: DataFrame, token: str) -> DataFrame:
    return posting.where(F.col("token") == token).select("building_id")


def query_tokens(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", tokens(normalize_address(F.col("text"))).alias("words"))


def _all_tokens(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """hits (query_id, token, building_id) that have every token of wanted (query_id, token)."""
    need = wanted.groupBy("query_id").agg(F.countDistinct("token").alias("need"))
    got = hits.distinct().groupBy("query_id", "building_id").agg(F.count("*").alias("got"))
    return got.join(need, "query_id").where("got = need").select("query_id", "building_id")


def search_exact(queries: DataFrame, posting: DataFrame) -> DataFrame:
    """(query_id, building_id): buildings with every word of the query. No words, no buildings."""
    wanted = query_tokens(queries).select("query_id", F.explode("words").alias("token")).distinct()
    return _all_tokens(wanted.join(posting, "token").select("query_id", "token", "building_id"), wanted)


def containing_tokens(wanted: DataFrame, index: Index) -> DataFrame:
    """(query_id, token, building_id): buildings with a word that contains the token. Words and tokens meet in the rarest
    of the token's runs of three characters (of the whole token, if it is shorter), so the join has equal keys and a
    common run matters only to tokens that have no other."""
    size = F.least(F.length("token"), F.lit(3))
    parts = F.transform(F.sequence(F.lit(1), F.length("token") - size + 1), lambda i: F.substring(F.col("token"), i, size))
    asked = wanted.select("token").distinct().where(F.length("token") > 0).select("token", F.explode(F.array_distinct(parts)).alias("gram"))
    counted = asked.join(index.gram_counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    rarest = counted.groupBy("token").agg(F.min(F.struct("n", "gram")).alias("g")).select("token", "g.gram")
    words = index.grams.withColumnRenamed("token", "word")
    found = words.join(rarest, "gram").where(F.contains("word", "token")).select("token", "word")
    hits = wanted.join(found, "token").join(index.postings.withColumnRenamed("token", "word"), "word")
    return hits.select("query_id", "token", "building_id").distinct()


def search_tokens(lists: DataFrame, index: Index) -> DataFrame:
    """(query_id, building_id) for lists (query_id, words): every word is contained in a word of the building."""
    wanted = lists.select("query_id", F.explode("words").alias("token")).distinct()
    return _all_tokens(containing_tokens(wanted, index), wanted)


def search_two_sided(queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, side, building_id): the buildings of both sides (`from`, `to`) of a query."""
    parsed = query_tokens(queries).select("query_id", parse_closest(F.col("words")).alias("p"))
    sides = parsed.select("query_id", F.explode(F.array(
        F.struct(F.lit("from").alias("side"), F.col("p.from_tokens").alias("words")), F.struct(F.lit("to").alias("side"), F.col("p.to_tokens").alias("words"))
    )).alias("s"))
    keyed = sides.select(F.struct("query_id", F.col("s.side").alias("side")).alias("query_id"), "s.words")
    return search_tokens(keyed, index).select("query_id.query_id", "query_id.side", "building_id")


def rank(query: Column) -> Column:
    """The integer rank of a building for a query (its columns and the viewport's beside each other)."""
    dlat, dlon = F.col("lat") - (F.col("sw_lat") + F.col("ne_lat")) * 0.5, F.col("lon") - (F.col("sw_lon") + F.col("ne_lon")) * 0.5
    seen = F.when(in_box(*(F.col(c) for c in ("lat", "lon", "sw_lat", "sw_lon", "ne_lat", "ne_lon"))), 200).otherwise(0)
    near = (F.lit(150.0) * (F.lit(1.0) / (F.lit(1.0) + F.sqrt(dlat * dlat + dlon * dlon)))).cast("int")
    none = F.lit("")
    glued = F.concat("address", F.coalesce("shop_name", none), F.coalesce("street", none), F.coalesce(F.col("house_number").cast("string"), none))
    qlen, alen = F.octet_length(normalize_address(query)), F.octet_length(normalize_address(glued))
    ratio = F.least(qlen.cast("double") / F.nullif(alen, F.lit(0)).cast("double"), F.lit(1.0))
    return seen + near + F.coalesce((F.lit(200.0) * ratio).cast("int"), F.lit(0))


def display_address() -> Column:
    shop = F.coalesce(F.concat("shop_name", F.lit(", ")), F.lit(""))
    return F.concat(F.col("address"), shop, F.coalesce("street", F.lit("")))


def ranked(found: DataFrame, queries: DataFrame, buildings: DataFrame) -> DataFrame:
    """found (query_id, building_id) with rank, display address, place and house number; order: rank falling, id rising."""
    both = found.join(queries, "query_id").join(buildings, "building_id")
    return both.select("query_id", "building_id", rank(F.col("text")).alias("rank"), display_address().alias("label"), "house_number", "lat", "lon")


def search_inverted(queries: DataFrame, buildings: DataFrame, index: Index | None = None) -> DataFrame:
    """Ranked buildings that have every word of the query; `closest` and `to` are words like others."""
    return ranked(search_exact(queries, index.postings if index else postings(buildings)), queries, buildings)


def closest_to(sides: DataFrame) -> DataFrame:
    """sides (query_id, side, building_id, rank, lat, lon): for queries with both sides, the `from` building nearest in
    metres to the best-ranked `to` building (ties: smaller id)."""
    best = sides.where("side = 'to'").groupBy("query_id").agg(F.max(F.struct("rank", (-F.col("building_id")).alias("at"), "lat", "lon")).alias("a"))
    away = haversine(F.col("lat"), F.col("lon"), F.col("a.lat"), F.col("a.lon"))
    near = sides.where("side = 'from'").join(best, "query_id").groupBy("query_id").agg(F.min(F.struct(away.alias("distance"), "building_id")).alias("b"))
    return near.select("query_id", F.col("b.building_id").alias("building_id"))


def search_substring(queries: DataFrame, buildings: DataFrame, index: Index | None = None) -> DataFrame:
    """Ranked buildings in whose words all words of the query are contained, or the one that is closest: its rank is 0.

    A `closest X to Y` whose Y is found nowhere gives the plain ranked X."""
    found = settled(search_two_sided(queries, index or build_index(buildings)))
    sides = settled(ranked(found, queries, buildings).join(found, ["query_id", "building_id"]))  # read three times
    near = closest_to(sides)
    plain = sides.where("side = 'from'").join(near.select("query_id"), "query_id", "left_anti").drop("side")
    one = sides.where("side = 'from'").join(near, ["query_id", "building_id"]).withColumn("rank", F.lit(0)).drop("side")
    return plain.unionByName(one)


def search(queries: DataFrame, buildings: DataFrame, index: Index | None = None) -> DataFrame:
    """queries with `exact` (boolean): each goes to exact or substring search; blank texts are skipped."""
    asked = queries.where(F.trim("text") != "")
    index = index or build_index(buildings)
    exact = search_inverted(asked.where("exact").drop("exact"), buildings, index)
    return exact.unionByName(search_substring(asked.where("not exact").drop("exact"), buildings, index))
