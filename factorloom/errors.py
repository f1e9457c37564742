"""Errors by phase: compiling expressions, binding a plan to tables, evaluating it."""


class FactorError(ValueError):
    """Common base."""


class CompileError(FactorError):
    """The request can't become a plan."""


class EmptyRequest(CompileError):
    pass


class InvalidExpression(CompileError):
    def __init__(self, expr: str, reason: str):
        super().__init__(f"invalid expression {expr!r}: {reason}")
        self.expr, self.reason = expr, reason


class UnknownOperator(CompileError):
    def __init__(self, name: str):
        super().__init__(f"unknown operator {name!r}")
        self.name = name


class InvalidArity(CompileError):
    def __init__(self, name: str, expected: int, actual: int):
        super().__init__(f"operator {name!r} takes {expected} arguments, got {actual}")
        self.name, self.expected, self.actual = name, expected, actual


class BindError(FactorError):
    """The plan doesn't fit the tables."""


class MissingField(BindError):
    def __init__(self, field: str):
        super().__init__(f"required field {field!r} is in no source")
        self.field = field


class EmptyUniverse(BindError):
    def __init__(self):
        super().__init__("the universe has no instruments")


class EngineError(FactorError):
    """The plan can't be evaluated, or not yet."""


class UnsupportedField(EngineError):
    def __init__(self, source: str, field: str):
        super().__init__(f"source {source!r} has no field {field!r}")
        self.source, self.field = source, field


class PayloadMismatch(EngineError):
    pass


class UnknownInstrument(EngineError):
    pass


class InvalidParameter(EngineError):
    pass


class NonMonotonicAdvance(EngineError):
    def __init__(self, current: int, last: int):
        super().__init__(f"advance to {current} after {last}")
        self.current, self.last = current, last


class NotReady(EngineError):
    def __init__(self, ts: int):
        super().__init__(f"not every instrument has data up to {ts}")
        self.ts = ts


class NotLoaded(EngineError):
    def __init__(self):
        super().__init__("no plan is loaded")
