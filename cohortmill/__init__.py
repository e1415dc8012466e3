"""Customer analytics on Spark DataFrames: staging, identity, marts, segments, data checks and sinks."""
