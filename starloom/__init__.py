"""Rating prediction and feature engineering on Spark DataFrames."""

from starloom.schema import RatingColumns

__all__ = ["RatingColumns"]
