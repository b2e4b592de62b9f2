"""parallaxis: a PySpark-native analytics engine for georeferenced image pairs."""
