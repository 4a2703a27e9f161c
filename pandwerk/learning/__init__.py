"""Preparation, training, tuning and inspection of floor-count regressors on Spark ML."""
