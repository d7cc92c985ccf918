"""Names, identifiers and categories as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize_id(s: Column) -> Column:
    return F.translate(s, "/\\\0", "___")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def day(ts: Column) -> Column:
    return F.substring(ts.cast("string"), 1, 10)


def category(feature: Column) -> Column:
    """Category of a feature by its name; what is written first wins."""
    return (
        F.when(feature.startswith("wc_class_"), "Land Cover")
        .when(feature.isin("latitude", "longitude"), "Location")
        .when(feature.contains("_annual_"), "Climate")
        .when(feature.isin("elev", "slope", "aspect"), "Topography")
        .when(feature.startswith("bio_"), "Bioclimatic")
        .when(feature.startswith("soil_") | feature.startswith("wrb_"), "Soil")
        .when(feature.startswith("patch_"), "Satellite (Raw)")
        .when(feature.startswith("pca_") | feature.startswith("umap_"), "Satellite")
        .otherwise("Other")
    )


def block_of(feature: Column) -> Column:
    return (
        F.when(feature.startswith("patch_") | feature.startswith("pca_") | feature.startswith("umap_"), "Satellite (SSL)")
        .when(feature.isin("latitude", "longitude"), "Coordinates")
        .when(feature.startswith("soil_") | feature.startswith("wc_class") | feature.contains("wrb"), "Soil / land cover")
        .otherwise("Climate")
    )
