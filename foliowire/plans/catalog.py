"""Imports every query module, which fills the registry."""

from foliowire.plans.registry import QUERIES, SQL  # noqa: F401
from foliowire.plans import sources_and_storage  # noqa: F401
from foliowire.plans import text_and_scores  # noqa: F401
from foliowire.plans import prices_and_studies  # noqa: F401
from foliowire.plans import matching_and_similarity  # noqa: F401
from foliowire.plans import evaluation, suitability  # noqa: F401
from foliowire.plans import streams  # noqa: F401
from foliowire.plans import variant_runs  # noqa: F401
