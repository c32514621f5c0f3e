"""tidebars: event-time price-bar analytics on Spark DataFrames."""

__all__ = ["session"]
