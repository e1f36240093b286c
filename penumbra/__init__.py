"""Spark-first analytics for shade-aware walking: maps, tiles, shadows, routes, places and streams."""
