"""momentlake: interval, time-series and ranking operators on Spark DataFrames."""
