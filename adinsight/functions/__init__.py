"""Column library: every function maps Columns to a Column, JVM-side."""
