"""Column expressions (JVM-side) and driver-side special functions."""
