"""parallax: comparing performance records of two populations, on Spark DataFrames."""
