"""Column expressions (all JVM-side built-ins, so they stay inside whole-stage codegen)."""
