"""tessera: keyed time-series panel analytics on Spark.

A panel is a DataFrame with one row per (key, time step), e.g. one row per
monitoring station and hour.  Every operator is a ``DataFrame -> DataFrame``
function (use with ``df.transform``) or a Spark ML stage; no operator pulls
data to the driver.
"""

from tessera.config import PanelSpec

__all__ = ["PanelSpec"]
__version__ = "0.1.0"
