"""Text guardrails on Spark: policies in, verdict columns out."""

import sys

from pyspark import cloudpickle

from .operators.scan import Models, scan, validate_input, validate_output
from .policy import Policy, load_policy, shipped_policies

__all__ = ["Models", "Policy", "load_policy", "scan", "shipped_policies", "validate_input",
           "validate_output"]

# Python functions travel to the executors with their code, so these need not
# have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
