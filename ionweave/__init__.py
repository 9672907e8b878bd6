"""ionweave: spectral retrieval and ranking evaluation on Spark DataFrames."""
