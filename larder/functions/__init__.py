"""Column functions: text, labels, numbers, dates, arrays and JSON."""
