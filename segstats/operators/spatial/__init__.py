"""Spatial operators on edge tables: weights, Moran's I, local G*, lags, geometry."""
