"""Column functions: every one returns a ``Column`` built from Spark builtins,
so decoding and scoring stay inside whole-stage codegen (no Python UDFs)."""
