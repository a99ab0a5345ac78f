"""Column functions: scalar rules as built-in expressions, text chains as Arrow UDFs."""
