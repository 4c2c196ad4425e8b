"""Analytics over evolving document corpora, as functions from DataFrames to DataFrames."""
