"""Readers of map data, tiles, manifests, places, boundaries and weather, with their checks as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..session import bounded

# The fields of the formats.
OVERPASS = "struct<elements:array<struct<type:string,id:bigint,tags:map<string,string>,nodes:array<bigint>,geometry:array<struct<lat:double,lon:double>>>>>"
TILE = "struct<schema:int,id:string,w:array<string>,b:array<string>>"
PLACES = "struct<schema:int,places:array<struct<id:string,name:string,aliases:array<string>,address:string,kind:string,lat:double,lon:double>>>"
MANIFEST = (
    "struct<schema:int,releaseId:string,zoom:int,coverage:struct<south:double,west:double,north:double,east:double>,"
    "source:struct<schema:int,fileName:string,bytes:bigint,sha256:string,observedModifiedAt:string,downloadUrl:string,downloadedAt:string>,generator:struct<schema:int,script:string>,"
    "artifacts:struct<places:struct<path:string,bytes:bigint,sha256:string>,boundary:struct<path:string,bytes:bigint,sha256:string>>,"
    "tiles:array<struct<id:string,bounds:struct<south:double,west:double,north:double,east:double>,bytes:bigint,sha256:string>>,"
    "walkingPolicy:struct<schema:int,excludedWayIds:array<bigint>,blockedNodeIds:array<bigint>,fallbackWayIds:array<bigint>,directions:array<array<bigint>>>>")
#: Patterns, names and limits of a manifest.
SHA256, RELEASE, TILE_ID, FILE_NAME = "^[a-f0-9]{64}$", "^[a-f0-9]{24}$", r"^\d{1,2}-\d{1,8}-\d{1,8}$", "^[a-zA-Z0-9._-]{1,120}$"
SCRIPT, PLACES_PATH, BOUNDARY_PATH = "scripts/build-seoul-tiles.mjs", "places.json", "boundary.json"
MOST_ARTIFACT, MOST_MANIFEST, MOST_POLICY, MOST_TILE, MOST_TILES, MOST_URL, MOST_DATE, MOST_ZOOM = 12_000_000, 1_000_000, 20_000, 2_000_000, 2_000, 2_000, 40, 22
WEATHER = "observedAt string, temperatureC double, apparentTemperatureC double, uvIndex double, isDay boolean, weatherCode int"
#: Most bytes of an artifact, elements of a file, points and tags of an element; kinds of places.
MOST_BYTES, MOST_ELEMENTS, MOST_POINTS, MOST_TAGS = 5_000_000, 10_000, 1_000, 100
KINDS = ["station", "cafe", "food", "medical", "education", "store", "office", "park", "landmark", "building", "address"]
#: Location accuracy in metres beyond which a fix is too vague.
VAGUE_M = 100.0


def read_whole(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(path, bytes, sha256, text, status) of whole files; the hash is of the content before it is parsed.

    A file over the size cap keeps its row, with status TOO_LARGE and without hash and text; it isn't read.
    """
    files = spark.read.format("binaryFile").load(path)
    fine = files.where(F.col("length") <= most).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"), F.lit("OK").alias("status"))
    over = files.where(F.col("length") > most).select("path", F.col("length").alias("bytes"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("text"), F.lit("TOO_LARGE").alias("status"))
    return fine.unionByName(over)


def verified(files: DataFrame, declared: DataFrame) -> DataFrame:
    """Files whose hash is the declared one (name, sha256)."""
    return files.join(declared, (F.element_at(F.split("path", "/"), -1) == declared["name"]) & (files["sha256"] == declared["sha256"]), "left_semi")


def overpass_status(files: DataFrame) -> DataFrame:
    """(path, status) of map extracts: OK, TOO_LARGE, UNREADABLE (no list of elements), or TOO_MANY_ELEMENTS."""
    n = F.size(F.from_json("text", OVERPASS)["elements"])
    bad = F.when(F.coalesce(n, F.lit(-1)) < 0, "UNREADABLE").when(n > MOST_ELEMENTS, "TOO_MANY_ELEMENTS")
    return files.select("path", F.when(F.col("status") != "OK", F.col("status")).otherwise(F.coalesce(bad, F.lit("OK"))).alias("status"))


def overpass(files: DataFrame) -> DataFrame:
    """Elements of map extracts whose overpass_status is OK, with valid = whether the element is within the limits."""
    parsed = files.select(F.from_json("text", OVERPASS).alias("d")).where(F.size("d.elements") <= MOST_ELEMENTS)
    e = parsed.select(F.explode("d.elements").alias("e")).select("e.*")
    points_ok = F.forall("geometry", lambda p: p["lat"].between(-90, 90) & p["lon"].between(-180, 180))
    ok = (F.col("type") == "way") & F.col("id").isNotNull() & (F.size("geometry") <= MOST_POINTS) & points_ok & (F.coalesce(F.size("tags"), F.lit(0)) <= MOST_TAGS)
    return e.withColumn("valid", F.coalesce(ok, F.lit(False)))


def compact_tiles(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ways (tile_id, id, flags, nodes, coords) and buildings (tile_id, id, height, levels, coords) of schema-2 tiles, in microdegrees."""
    t = files.select(F.from_json("text", TILE).alias("t")).where("t.schema = 2")

    def rows(column):
        return t.select(F.col("t.id").alias("tile_id"), F.explode(f"t.{column}").alias("r")).select("tile_id", F.from_json("r", "array<string>").alias("r"))

    field = lambda i: F.get("r", F.lit(i))
    longs = lambda i: F.from_json(field(i), "array<bigint>")
    ways = rows("w").select("tile_id", field(0).cast("long").alias("id"), field(1).cast("int").alias("flags"), longs(2).alias("nodes"), longs(3).alias("coords"))
    number = lambda i: field(i).try_cast("double")
    buildings = rows("b").select("tile_id", field(0).cast("long").alias("id"), number(1).alias("height"), number(2).alias("levels"), longs(3).alias("coords"))
    return ways, buildings


def points(coords: Column) -> Column:
    """Array of (lat, lon) degrees from alternating microdegrees."""
    return F.transform(F.sequence(F.lit(0), (F.size(coords) / 2).cast("int") - 1), lambda i: F.struct((F.get(coords, 2 * i) / 1e6).alias("lat"), (F.get(coords, 2 * i + 1) / 1e6).alias("lon")))


def expand_ways(ways: DataFrame, excluded: DataFrame, fallback: DataFrame) -> DataFrame:
    """Ways without the excluded ones, with the fallback policy or-ed in, as booleans and points. Policy tables are counted before they are broadcast."""
    marked = ways.join(bounded(excluded.withColumnRenamed("way_id", "id")), "id", "left_anti").join(bounded(fallback.select(F.col("way_id").alias("id"), F.lit(True).alias("_f"))), "id", "left")
    bit = lambda b: F.col("flags").bitwiseAND(b) > 0
    return marked.select("tile_id", "id", bit(1).alias("covered"), bit(2).alias("steps"), (bit(4) | F.coalesce("_f", F.lit(False))).alias("fallback"), "nodes", points(F.col("coords")).alias("points"))


def manifest(files: DataFrame) -> DataFrame:
    """Manifests as columns; those over the size cap, or whose text doesn't parse, have nulls."""
    text = F.when(F.octet_length("text") <= MOST_MANIFEST, F.col("text"))
    return files.select("path", F.from_json(text, MANIFEST).alias("m"), F.json_object_keys(F.get_json_object(text, "$.source")).alias("source_keys")).select("path", "m.*", "source_keys")


def _box_ok(box: Column) -> Column:
    """Finite, within the world, south below north and west of east; comparisons with nulls and NaN are false."""
    return (box["south"] >= -90) & (box["north"] <= 90) & (box["west"] >= -180) & (box["east"] <= 180) & (box["south"] < box["north"]) & (box["west"] < box["east"])


def _rising(values: Column) -> Column:
    """At most MOST_POLICY positive numbers, each more than the one before."""
    return (F.size(values) <= MOST_POLICY) & F.forall(values, lambda x: x > 0) & (values == F.array_sort(F.array_distinct(values)))


def _date_ok(text: Column) -> Column:
    return (F.length(text) <= MOST_DATE) & F.try_to_timestamp(text).isNotNull()


def manifest_rules(m: DataFrame) -> dict[str, Column]:
    """Every rule of a manifest by name: true where it holds, null or false where it doesn't."""
    source, policy, directions = F.col("source"), F.col("walkingPolicy"), F.col("walkingPolicy.directions")
    artifact = lambda a, path: (a["path"] == path) & a["bytes"].between(1, MOST_ARTIFACT) & a["sha256"].rlike(SHA256)
    has = lambda key: F.array_contains("source_keys", key) if "source_keys" in m.columns else F.lit(True)
    ids = F.transform("tiles", lambda t: t["id"])
    each = lambda rule: F.forall("tiles", rule)
    return {
        "schema": F.col("schema") == 3, "release_id": F.col("releaseId").rlike(RELEASE), "zoom": F.col("zoom").between(0, MOST_ZOOM), "coverage": _box_ok(F.col("coverage")),
        "source_schema": source["schema"] == 1, "source_file": source["fileName"].rlike(FILE_NAME), "source_bytes": source["bytes"] > 0, "source_hash": source["sha256"].rlike(SHA256), "source_modified": _date_ok(source["observedModifiedAt"]),
        "source_url": has("downloadUrl") & (source["downloadUrl"].isNull() | ((F.length(source["downloadUrl"]) <= MOST_URL) & F.startswith(source["downloadUrl"], F.lit("https://")))),
        "source_downloaded": has("downloadedAt") & (source["downloadedAt"].isNull() | _date_ok(source["downloadedAt"])),
        "generator_schema": F.col("generator.schema") == 3, "generator_script": F.col("generator.script") == SCRIPT,
        "places": artifact(F.col("artifacts.places"), PLACES_PATH), "boundary": artifact(F.col("artifacts.boundary"), BOUNDARY_PATH),
        "policy_schema": policy["schema"] == 1, "excluded_ways": _rising(policy["excludedWayIds"]), "blocked_nodes": _rising(policy["blockedNodeIds"]), "fallback_ways": _rising(policy["fallbackWayIds"]),
        "directions": F.forall(directions, lambda d: (F.size(d) == 2) & F.get(d, F.lit(1)).isin(1, -1)) & _rising(F.transform(directions, lambda d: F.get(d, F.lit(0)))),
        "n_tiles": F.size("tiles").between(1, MOST_TILES), "tile_ids": each(lambda t: t["id"].rlike(TILE_ID)) & (ids == F.array_sort(F.array_distinct(ids))),
        "tile_bounds": each(lambda t: _box_ok(t["bounds"])), "tile_bytes": each(lambda t: t["bytes"].between(1, MOST_TILE)), "tile_hashes": each(lambda t: t["sha256"].rlike(SHA256)),
    }


def manifest_ok(m: DataFrame) -> DataFrame:
    """Adds broken, the names of the rules that don't hold, and valid, whether there are none."""
    rules = manifest_rules(m)
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items())))
    return m.withColumn("broken", broken).withColumn("valid", F.size("broken") == 0)


def places(files: DataFrame) -> DataFrame:
    """Valid places in file order (seq): a known kind, coordinates, a name."""
    rows = files.select(F.from_json("text", PLACES).alias("p")).where("p.schema = 2").select(F.posexplode("p.places").alias("seq", "p")).select("seq", "p.*")
    return rows.where(F.col("id").rlike(r"^osm-(node|way)-\d+$") & F.col("kind").isin(KINDS) & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def boundary_rings(geojson: Column) -> Column:
    """array<polygon<ring<[lon, lat]>>> of a Polygon or MultiPolygon; anything else is an error."""
    kind = F.get_json_object(geojson, "$.type")
    coordinates = F.get_json_object(geojson, "$.coordinates")
    return F.when(kind == "Polygon", F.array(F.from_json(coordinates, "array<array<array<double>>>"))).when(kind == "MultiPolygon", F.from_json(coordinates, "array<array<array<array<double>>>>")).otherwise(F.raise_error(F.lit("unsupported boundary")))


def weather_place(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Coordinates as the weather is asked for: to two places, so that neighbours share an answer."""
    return F.round(lat, 2), F.round(lon, 2)


def weather_ok(w: DataFrame) -> DataFrame:
    """Adds valid: temperatures, UV index and weather code within their ranges, and day or night known."""
    ok = F.col("temperatureC").between(-60, 60) & F.col("apparentTemperatureC").between(-80, 80) & F.col("uvIndex").between(0, 30) & F.col("isDay").isNotNull() & F.col("weatherCode").between(0, 99)
    return w.withColumn("valid", F.coalesce(ok, F.lit(False)))


def fix_status(lat: Column, lon: Column, accuracy: Column, inside: Column) -> Column:
    """What a location fix is good for: OK, or why not."""
    bad = lat.isNull() | lon.isNull() | accuracy.isNull() | F.isnan(lat) | F.isnan(lon) | F.isnan(accuracy) | ~lat.between(-90, 90) | ~lon.between(-180, 180) | (accuracy < 0)
    return F.when(bad, "LOCATION_UNAVAILABLE").when(accuracy > VAGUE_M, "LOCATION_LOW_ACCURACY").when(~inside, "OUTSIDE_SEOUL").otherwise("OK")


#: Places that are there before any are loaded.
DEFAULT_PLACES = [("gangnam-11", "강남역 11번 출구", 37.4995, 127.0284), ("yeoksam", "역삼역", 37.5007, 127.0364)]


def merge_places(defaults: DataFrame, loaded: DataFrame) -> DataFrame:
    """Both lists, by id: the last one's content at the first one's position (seq)."""
    both = defaults.withColumn("_from", F.lit(0)).unionByName(loaded.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("id", "seq", "_from")]
    order = F.struct("_from", "seq")
    return both.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("c"), F.min(order).alias("_at")).select("id", "c.*", "_at")


def default_places(spark: SparkSession) -> DataFrame:
    rows = [(k, n, [], "station", lat, lon, i) for i, (k, n, lat, lon) in enumerate(DEFAULT_PLACES)]
    return spark.createDataFrame(rows, "id string, name string, aliases array<string>, kind string, lat double, lon double, seq int")
