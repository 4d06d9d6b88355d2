"""Spark jobs for sweep measurements and layer-stack tolerance analysis.

Every operator takes DataFrames, key columns and parameters and returns a
DataFrame.  Sub-packages:

* ``sources``   - sweep files, optical tables, reports, lookups, CSV sinks
* ``functions`` - column expressions: rounding, formatting, thin-film optics
* ``operators`` - keyed operators: readout, rollups, sweeps, statistics, fits
* ``plans``     - end-to-end jobs and the registered queries
* ``streaming`` - the sweep readout on a file stream
"""

__version__ = "0.1.0"
