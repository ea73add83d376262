"""Every registered query."""

from brisa.plans.registry import COVERS, ORACLE, QUERIES  # noqa: F401
from brisa.plans import (queries_cleaning, queries_forecast, queries_functions, queries_joins,  # noqa: F401
                         queries_learning, queries_serving, queries_statistics, queries_survival)
