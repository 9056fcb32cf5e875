"""Column expressions; everything here stays inside JVM code generation."""
