"""Training-data operators.  Nothing outside this folder imports it, save the guarded hook of the entry module."""
