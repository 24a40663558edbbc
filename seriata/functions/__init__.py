"""Column expressions shared by the operators; all stay on the JVM side."""
