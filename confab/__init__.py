"""confab: sessionized conversation analytics and corpus preparation on Spark DataFrames."""
