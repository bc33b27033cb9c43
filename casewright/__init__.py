"""Security-telemetry analytics as Spark DataFrames: normalise, detect, correlate, reconstruct, report."""
