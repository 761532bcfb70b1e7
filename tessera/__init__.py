"""tessera: an array and table analytics engine whose plans are Spark DataFrames."""
