"""What a reader says of a file that it can't use."""


class ReadError(Exception):
    """Its text is meant for the user."""
