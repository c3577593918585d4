"""Before-and-after studies of timestamped texts as Spark jobs.

Sub-packages
------------
functions   column expressions (text views, privacy, time, lexicon, patterns, intervals)
sources     readers, post schema, validation, sinks
operators   rule cascade, sampling, scorers, tables and tests, bootstrap, regression, topics
plans       prepare -> score -> analyze, and the pattern check
"""

import sys

from pyspark import cloudpickle

# tasks get the functions of this package by value, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
