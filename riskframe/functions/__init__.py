"""Column-expression builders (no data access, no Python UDFs)."""

from riskframe.functions.features import *  # noqa: F401,F403
