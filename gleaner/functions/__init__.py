"""Column functions: expressions that Spark compiles, unless a docstring says otherwise."""
