"""skein: retrieval analytics and corpus preparation as Spark DataFrame jobs.

Functions of this package travel to executors by value, so a cluster needs the
package on the driver only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
