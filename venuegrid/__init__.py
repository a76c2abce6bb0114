"""venuegrid: listing-market analytics as Spark DataFrame operators.

One row per venue goes in; cleaned listings, derived features, label rows,
market summaries, tests, scores and dense locations come out. Every operator
takes DataFrames plus parameters and returns a DataFrame.
"""
