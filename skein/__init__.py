"""skein: a Spark-first analytics engine for web-crawl data."""
