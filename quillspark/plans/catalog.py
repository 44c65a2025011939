"""All registered queries."""

from quillspark.plans import pages, relational, textual  # noqa: F401
from quillspark.plans.registry import QUERIES, SQL  # noqa: F401
