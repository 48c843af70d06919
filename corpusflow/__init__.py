"""corpusflow: bilingual corpus preparation as Spark DataFrame jobs.

Every public function is ``DataFrame -> DataFrame`` or ``Column -> Column``.
Sub-packages:

* ``functions``  scalar text functions (normalise, URL strip, whitelists, counts, hashes)
* ``sources``    snapshot read/write, ingest, JSON-lines shard expansion
* ``streaming``  bounded streaming ingest (``Trigger.AvailableNow``)
* ``operators``  pair schema, filters, dedup, language ID, sampling, BPE, examples, metrics
* ``plans``      the user-facing jobs composed from operators
"""

from corpusflow.session import get_spark, shared_dir

__all__ = ["get_spark", "shared_dir"]
