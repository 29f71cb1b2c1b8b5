"""Column expressions.  Everything here is evaluated inside the JVM."""
