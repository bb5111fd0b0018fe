"""Security-event analytics as lazy Spark DataFrame transformations."""
