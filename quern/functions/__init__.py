"""Column expressions: everything here stays inside the JVM unless a module says otherwise."""
