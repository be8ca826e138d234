"""tamarack: a Spark-native analytics engine for recipe-style catalogs and their texts."""
