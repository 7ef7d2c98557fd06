"""citegraph: citation and reference-network analytics as Spark DataFrame operators.

Every public operator is a plain function ``DataFrame(s) -> DataFrame``; nothing
is collected to the driver except scalars (row counts, partition offsets) and
tiny model weights.
"""

__version__ = "0.1.0"
