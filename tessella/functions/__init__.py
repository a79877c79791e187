"""Column functions on vectors (arrays of doubles). All are built-in expressions: nothing leaves the JVM."""
