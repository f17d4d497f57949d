"""The folds of loomtide.operators on Structured Streaming."""
