"""tablepact: data-contract validation as Spark jobs.

A contract document becomes a ``contract_rules`` table; rules compile to
Column expressions evaluated in one fused aggregate per slice plus grouped
passes for frequencies and uniqueness.  Every output is a DataFrame.
"""

from tablepact.plans.validation import Validation, validate
from tablepact.sources.contracts import contract_header, contract_lint, contract_rules, contracts_frame

__all__ = [
    "Validation",
    "contract_header",
    "contract_lint",
    "contract_rules",
    "contracts_frame",
    "validate",
]
