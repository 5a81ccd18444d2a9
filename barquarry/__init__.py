"""barquarry: price-by-volume analytics over long bar tables, planned by Spark."""
