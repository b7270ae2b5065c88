"""Granule tables: search, metadata, ids and band links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..relational import first_k_per_key, join_lookup

# Band name per product and asset suffix.
BAND_ASSETS = {
    "HLSS30": {"blue": "B02", "green": "B03", "red": "B04", "nir": "B8A", "swir1": "B11", "fmask": "Fmask"},
    "HLSL30": {"blue": "B02", "green": "B03", "red": "B04", "nir": "B05", "swir1": "B06", "fmask": "Fmask"},
}

REQUIRED_BANDS = ("blue", "green", "red", "nir", "swir1", "fmask")

METADATA_SCHEMA = T.StructType([T.StructField("umm", T.StructType([
    T.StructField("GranuleUR", T.StringType()),
    T.StructField("TemporalExtent", T.StructType([T.StructField("RangeDateTime", T.StructType([
        T.StructField("BeginningDateTime", T.StringType())]))])),
    T.StructField("AdditionalAttributes", T.ArrayType(T.StructType([
        T.StructField("Name", T.StringType()), T.StructField("Values", T.ArrayType(T.StringType()))])))]))])


def granule_search(granules: DataFrame, bbox: tuple[float, float, float, float], start: str, end: str,
                   products: Sequence[str] = ("HLSS30", "HLSL30"), max_results: int | None = None) -> DataFrame:
    """Granules overlapping a box in a period; where a caller names ``max_results``, the first ones per product in time order."""
    min_lon, min_lat, max_lon, max_lat = bbox
    found = granules.filter(
        (F.col("min_lon") <= max_lon) & (F.col("max_lon") >= min_lon)
        & (F.col("min_lat") <= max_lat) & (F.col("max_lat") >= min_lat)
        & F.col("begin_ts").between(F.lit(start).cast("timestamp_ntz"),
                                    F.lit(end).cast("timestamp_ntz"))
        & F.col("product").isin(list(products)))
    return found if max_results is None else first_k_per_key(found, ["product"], [F.col("begin_ts"), F.col("granule_id")], max_results)


def search_areas(granules: DataFrame, areas: DataFrame, cell: float = 1.0, days: int = 32,
                 products: Sequence[str] = ("HLSS30", "HLSL30")) -> DataFrame:
    """(area_id, granule columns) of every granule that overlaps an area's box in its period; one row per pair.

    ``areas`` has ``area_id``, the box (min_lon, max_lon, min_lat, max_lat) and ``start`` and ``end`` times, all inclusive. Both
    sides go to the cells of space (``cell`` degrees) and time (``days``) that they reach, and meet by an equi-join on the cell. A
    pair that shares several cells is kept in one only, that of the lower left corner of what the boxes share. Areas go out by a
    checked broadcast, else the join is salted. ``cell`` and ``days`` should be about as large as the boxes and periods: smaller ones copy
    more, larger ones test more pairs. Rows without bounds or time, and boxes or periods whose end lies before their start, match nothing.
    """
    cell_of = lambda c: F.floor(F.col(c) / F.lit(cell)).cast("bigint")
    bucket = lambda c: F.floor(F.unix_date(F.col(c).cast("date")) / F.lit(days)).cast("bigint")
    bounds = ("min_lon", "max_lon", "min_lat", "max_lat")
    ordered = (F.col("min_lon") <= F.col("max_lon")) & (F.col("min_lat") <= F.col("max_lat"))
    reach = lambda df, a, b, name: df.withColumn(name, F.explode(F.sequence(a, b)))

    def cells(df: DataFrame) -> DataFrame:
        return reach(reach(df.filter(ordered), cell_of("min_lon"), cell_of("max_lon"), "_cx"), cell_of("min_lat"), cell_of("max_lat"), "_cy")
    wanted = areas.filter("start <= end").withColumns({"_start": F.col("start").cast("timestamp_ntz"), "_end": F.col("end").cast("timestamp_ntz")})
    wanted = reach(cells(wanted), bucket("_start"), bucket("_end"), "_ct")
    wanted = wanted.select("area_id", "_cx", "_cy", "_ct", "_start", "_end", *[F.col(b).alias(f"_{b}") for b in bounds])
    found = cells(granules.filter(F.col("product").isin(list(products)) & F.col("begin_ts").isNotNull())).withColumn("_ct", bucket("begin_ts"))
    met = ((F.col("min_lon") <= F.col("_max_lon")) & (F.col("max_lon") >= F.col("_min_lon")) & (F.col("min_lat") <= F.col("_max_lat"))
           & (F.col("max_lat") >= F.col("_min_lat")) & F.col("begin_ts").between(F.col("_start"), F.col("_end")))
    corner = lambda c: F.floor(F.greatest(F.col(f"min_{c}"), F.col(f"_min_{c}")) / F.lit(cell))
    once = (F.col("_cx") == corner("lon")) & (F.col("_cy") == corner("lat"))
    return join_lookup(found, wanted, ["_cx", "_cy", "_ct"]).filter(met & once).select("area_id", *granules.columns)


def granule_metadata(raw: DataFrame, column: str = "metadata") -> DataFrame:
    """Flatten the nested JSON: id, begin time, and the cloud cover kept as the second additional attribute."""
    m = raw.withColumn("_m", F.from_json(column, METADATA_SCHEMA)["umm"])
    return m.withColumns({
        "granule_id": F.col("_m.GranuleUR"),
        "begin_ts": F.to_timestamp(F.col("_m.TemporalExtent.RangeDateTime.BeginningDateTime"), "yyyy-MM-dd'T'HH:mm:ss.SSSX")
        .cast("timestamp_ntz"),
        "cloud_cover": F.get(F.get("_m.AdditionalAttributes", F.lit(1))["Values"], F.lit(0)).cast("double"),
    }).drop("_m")


def cloud_filter(granules: DataFrame, max_cloud: float | None = None) -> DataFrame:
    """Strictly below ``max_cloud``; unset or 0 means no filter."""
    return granules.filter(F.col("cloud_cover") < max_cloud) if max_cloud else granules


def product_of(granule_id: str | Column) -> Column:
    """Product of an id, either as one word (HLSS30) or in the dotted form (HLS.S30)."""
    g = F.col(granule_id) if isinstance(granule_id, str) else granule_id
    return F.when(g.contains("HLSS30") | g.contains("HLS.S30"), F.lit("HLSS30")).otherwise(F.lit("HLSL30"))


def date_of(granule_id: str | Column) -> Column:
    """Date of the ``YYYYDDDT......`` part; NULL where there is none."""
    stamp = F.regexp_extract(granule_id, r"(?:^|\.)(\d{4}\d{3}T[^.]{6})(?:\.|$)", 1)
    first = F.make_date(F.substring(stamp, 1, 4).try_cast("int"), F.lit(1), F.lit(1))
    return F.date_add(first, F.substring(stamp, 5, 3).try_cast("int") - 1)


def granule_parse(granules: DataFrame, column: str = "granule_id") -> DataFrame:
    return granules.withColumns({"product": product_of(column), "obs_date": date_of(column)})


def granule_rejects(granules: DataFrame, column: str = "granule_id") -> DataFrame:
    """Granules whose id has no date part."""
    return granules.filter(date_of(column).isNull())


def band_links(granules: DataFrame, links: str = "links") -> DataFrame:
    """One row per granule and band: the first link whose file carries the product's asset suffix for the band."""
    suffixes = F.create_map(*[F.lit(v) for product, assets in BAND_ASSETS.items()
                              for band, suffix in assets.items() for v in (f"{product}/{suffix}", band)])
    linked = granules.select("granule_id", "product", F.posexplode(links).alias("position", "link"))
    name = F.substring_index("link", "/", -1)
    suffix = F.when(F.contains(name, F.lit(".")), F.substring_index(F.substring_index(name, ".", -2), ".", 1))
    band = F.try_element_at(suffixes, F.concat_ws("/", "product", suffix))
    return (linked.withColumn("band", band).filter(F.col("band").isNotNull())
            .groupBy("granule_id", "band").agg(F.min_by("link", "position").alias("link")))


def missing_bands(granules: DataFrame, links: DataFrame, required: Sequence[str] = REQUIRED_BANDS) -> DataFrame:
    """Required bands that a granule lacks, one row each; a granule without any recognised link lacks them all."""
    wanted = F.array(*[F.lit(b) for b in required])
    found = links.filter(F.col("band").isin(list(required))).select("granule_id", "band")
    blank = granules.select("granule_id", F.lit(None).cast("string").alias("band"))
    have = blank.unionByName(found).groupBy("granule_id").agg(F.collect_set("band").alias("_have"))
    return have.select("granule_id", F.explode(F.array_except(wanted, "_have")).alias("band"))


def complete_granules(links: DataFrame, required: Sequence[str] = REQUIRED_BANDS) -> DataFrame:
    """Granules that have every required band."""
    have = links.filter(F.col("band").isin(list(required))).groupBy("granule_id").agg(F.collect_set("band").alias("_have"))
    return have.filter(F.size("_have") == len(required)).select("granule_id")
