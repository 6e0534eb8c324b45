"""Column-expression building blocks (JVM-side, whole-stage-codegen friendly)."""
