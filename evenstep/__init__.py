"""Regular time series on Spark: cleaning, quality, features, windows, scaling, forecasts and scores."""
