"""geoweave: geospatial and knowledge-graph analytics on Spark DataFrames."""
