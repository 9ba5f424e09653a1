"""Column functions and the shell tokenizer."""
