"""Every registered query; importing the package fills the registry."""

from planeweave.plans import registry  # noqa: F401
from planeweave.plans import value_queries, stats_queries  # noqa: F401, E402
from planeweave.plans import threshold_queries  # noqa: F401, E402
from planeweave.plans import table_queries  # noqa: F401, E402
from planeweave.plans import neighbourhood_queries  # noqa: F401, E402
from planeweave.plans import object_queries  # noqa: F401, E402
from planeweave.plans import roi_queries  # noqa: F401, E402
from planeweave.plans import display_queries  # noqa: F401, E402
from planeweave.plans import dataset_queries  # noqa: F401, E402
