"""slicelake: object lifecycle events turned into governed table slices, on Spark."""
