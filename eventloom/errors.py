"""Errors that callers may want to tell apart."""


class MissingTargetError(ValueError):
    """A file has no target folder, so no operation can be planned for it."""

    def __init__(self, message: str = "a media file has no target path"):
        super().__init__(message)


class MissingColumnError(KeyError):
    """A table lacks a column that an operator needs."""

    def __init__(self, column: str):
        super().__init__(column)
        self.column = column

    def __str__(self) -> str:
        return f"missing column: {self.column}"


class CatalogueConflict(RuntimeError):
    """Another writer has made this version of a catalogue meanwhile; read again and merge."""

    def __init__(self, folder: str, version: int):
        super().__init__(f"{folder}: version {version} exists already")
        self.version = version
