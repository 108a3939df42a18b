"""Column expressions shared by the layers; all of them run inside the JVM."""
