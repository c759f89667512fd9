"""Feature, scorecard and text analytics on Spark DataFrames."""
