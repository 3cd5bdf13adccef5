"""Column functions: text, arrays, JSON, numbers. All are JVM expressions."""
