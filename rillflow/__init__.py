"""rillflow: named-step dataflow pipelines on Spark DataFrames and Structured Streaming."""
