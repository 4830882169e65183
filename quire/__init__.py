"""Document analytics on Spark: declarative plans over documents, pages, blocks and translations."""
