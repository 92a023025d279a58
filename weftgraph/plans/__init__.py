"""Named queries over the driver's tables."""

from weftgraph.plans import chunks, core, questions, scenarios  # noqa: F401  registers its queries
