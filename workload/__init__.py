"""The registered queries: each takes (spark, directory of the driver's tables) and returns a DataFrame."""
