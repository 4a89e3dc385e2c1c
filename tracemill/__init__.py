"""Analytics over multi-turn tool-call transcripts, composed from Spark DataFrames."""
