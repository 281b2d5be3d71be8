"""PySpark engine for market-day panels: long tables of price and quantity per market, commodity and day.

Operators are lazy ``DataFrame -> DataFrame`` functions. The panel key is (date, market_id, commodity), so a
(commodity, market_id) series holds at most one row per calendar day; windows partitioned that way are bounded.
"""

import sys

from pyspark import cloudpickle

# Ship the small numpy kernels inside the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
