"""contactlift: choose which customers to contact when every contact has a known gain or cost.

A PySpark-native library: feature packs, exact repeatable sampling, profit metrics, distributed
running sums and MLlib model jobs, all expressed as DataFrame plans.
"""

__version__ = "0.1.0"
