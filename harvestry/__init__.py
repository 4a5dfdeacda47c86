"""harvestry: Spark jobs that turn web pages and text corpora into clean tables."""
