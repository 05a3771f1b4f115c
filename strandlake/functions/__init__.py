"""Column functions: keys, strands, sequences and record rendering."""
