"""Column expressions: pure, JVM-side building blocks."""
