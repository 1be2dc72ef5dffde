"""Customer-support analytics as Spark jobs.

Every operator takes DataFrames and returns a DataFrame, so it can be used with
``df.transform`` and combined in one lazy plan.
"""
