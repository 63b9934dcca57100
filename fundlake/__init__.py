"""fundlake: channel marketing-fund analytics on Spark.

Layers (all lazy DataFrame plans, one plan per query):

* ``sources``   typed readers for the driver tables and domain derivation,
                plus file formats (csv / json / text / binary / workbook).
* ``functions`` column-expression helpers (fiscal calendar, money, keys, text).
* ``operators`` reusable relational operators (quality rules, history,
                windows, matched-control lift, workflow, governance, corpus, rules).
* ``plans``     silver, gold, metric registry and certified questions.
* ``streaming`` Structured Streaming jobs (ingest, windows, state).
"""

from fundlake.session import get_spark, checkpoint_root  # noqa: F401

__all__ = ["get_spark", "checkpoint_root"]
