"""Analytics over large catalogues of code and text assets, on Spark DataFrames."""
