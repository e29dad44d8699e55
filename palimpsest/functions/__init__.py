"""Column expressions: each takes and returns ``Column`` objects and stays inside the JVM."""
