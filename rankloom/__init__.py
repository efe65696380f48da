"""rankloom: search, crawl and log analytics as Spark DataFrame transformations."""
