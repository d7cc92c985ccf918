"""Spark-native operators for geolocated samples: joins, rasters, folds, models and reports."""
