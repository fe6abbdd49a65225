"""Errors of the graph engine, by stage."""

from contextlib import contextmanager


class GraphError(Exception):
    """Any error of the engine; also integrity errors of the graph itself."""


class CypherSyntaxError(GraphError):
    pass


class SemanticError(GraphError):
    pass


class CypherTypeError(GraphError):
    pass


class CypherArithmeticError(GraphError):
    """Division by zero, or a number out of range."""


class UnboundVariable(SemanticError):
    pass


class MissingParameter(GraphError):
    pass


class ResourceLimit(GraphError):
    pass


class Cancelled(GraphError):
    pass


class QueryTimeout(GraphError):
    pass


@contextmanager
def runtime_errors():
    """Errors that Spark raises while rows are made, as errors of the engine."""
    from pyspark.errors import ArithmeticException, SparkRuntimeException

    try:
        yield
    except ArithmeticException as e:
        raise CypherArithmeticError(str(e).split("\n")[0]) from None
    except SparkRuntimeException as e:
        if e.getCondition() != "USER_RAISED_EXCEPTION":
            raise
        raise CypherTypeError(str(e).split("\n")[0]) from None
