"""Hierarchical document indexing, retrieval and evaluation on Spark."""

from quire.plans.build import index_documents
from quire.plans.options import Options
from quire.plans.reasoner import Reasoner, RuleReasoner
from quire.operators.markdown import nodes as markdown_nodes
from quire.operators.search import search_nodes

__all__ = ["Options", "Reasoner", "RuleReasoner", "index_documents", "markdown_nodes", "search_nodes"]
