"""tenderlake: tender-corpus retrieval and analytics as Spark DataFrame jobs.

Every public function takes and returns DataFrames; nothing is collected
to the driver in the core paths.
"""

__version__ = "0.1.0"
