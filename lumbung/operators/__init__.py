"""Part of lumbung."""
