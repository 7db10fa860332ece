"""Column functions (``Column -> Column``), all built-in Spark expressions."""

from recentlake.functions.columns import *  # noqa: F401,F403
from recentlake.functions import columns as columns  # noqa: F401
