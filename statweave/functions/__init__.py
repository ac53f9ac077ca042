"""Scalar functions as column expressions; all run in the JVM except where the docstring says otherwise."""
