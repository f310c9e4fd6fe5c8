"""Every query over the reference tables, and its SQL twin."""

from .oracles import ORACLES
from .queries import QUERIES

FLAGSHIP = "lexical_topk_as_principal"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
