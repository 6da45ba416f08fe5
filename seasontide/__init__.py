"""Spark-native event-timing forecast and evaluation.

Every operator is a plain ``DataFrame -> DataFrame`` function, usable with
``df.transform``.  Sub-packages:

``functions``  column expressions and skew-safe building blocks
``sources``    readers, writers and schemas
``operators``  events, spatial, features, frames, models, termination, evaluation, audits
``plans``      the registered queries over the driver tables, with their SQL oracles
"""

from seasontide.config import Settings

__all__ = ["Settings"]
