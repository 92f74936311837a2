"""Column-expression helpers: windows, coercion, labels, priority, display."""
