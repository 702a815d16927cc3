"""What goes wrong by the user's doing."""


class EngineError(ValueError):
    """A statement that can't be carried out."""


class UnknownTable(EngineError):
    pass


class UnknownColumn(EngineError):
    pass


class ConstraintError(EngineError):
    """Rows break a declared constraint; nothing of the statement has taken effect."""

    def __init__(self, table: str, broken: dict[str, int]) -> None:
        super().__init__(f"{table}: " + ", ".join(f"{name} ({n} rows)" for name, n in broken.items()))
        self.broken = broken
