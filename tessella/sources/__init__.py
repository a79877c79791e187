"""Readers and writers: text matrices, dictionaries, labels, bases, optional formats, and tables published once."""
