"""Column expressions. All are JVM-side unless their docstring says otherwise."""
